"""Records merged from many sightings, and where each was seen; every step is a minimum, so the order of rows and partitions does not matter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def survivors(rows: DataFrame, keys: list[str], order: list[str], priority: str, levels: list[int], fields: list[str]) -> DataFrame:
    """One record by key out of its sightings: keys, priority, fields.  The result of folding them in ``order``, without gathering them.

    In the fold a sighting of a higher priority than all before takes over and keeps old values
    only where it has none; any other fills what is missing.  So a field comes from the last
    sighting that took over and has it, else from the first that has it.  What took over is, for
    each level, its first sighting, if none of a higher level was earlier: one minimum by level
    and one by field.
    """
    at = F.struct(*order)
    first = [F.min(F.when(F.col(priority) == p, F.struct(at.alias("at"), *fields))).alias(f"_first{p}") for p in levels]
    filled = [F.min(F.when(F.col(f).isNotNull(), F.struct(at.alias("at"), F.col(f).alias("v")))).alias(f"_fill_{f}") for f in fields]
    merged = rows.groupBy(*keys).agg(F.max(priority).alias("_priority"), *first, *filled)

    def took_over(p: int) -> Column:
        later = [F.col(f"_first{q}").isNull() | (F.col(f"_first{q}.at") > F.col(f"_first{p}.at")) for q in levels if q > p]
        return reduce(lambda a, b: a & b, later, F.col(f"_first{p}").isNotNull())

    value = lambda f: F.coalesce(*[F.when(took_over(p), F.col(f"_first{p}.{f}")) for p in sorted(levels, reverse=True)], F.col(f"_fill_{f}.v"))
    return merged.select(*keys, F.col("_priority").alias(priority), *[value(f).alias(f) for f in fields])


def seen_on(rows: DataFrame, keys: list[str], order: list[str], url: str, rank: str) -> DataFrame:
    """Where a record was seen: keys, url, order (a struct) and rank of the first sighting on each url."""
    first = F.min(F.struct(F.struct(*order).alias("at"), F.col(rank).alias("rank")))
    return rows.where(F.col(url).isNotNull()).groupBy(*keys, url).agg(first.alias("_x")).select(*keys, url, F.col("_x.at").alias("at"), F.col("_x.rank").alias("rank"))


def united(rows: DataFrame, keys: list[str], order: list[str], url: str, rank: str, fields: list[str]) -> DataFrame:
    """One record by key: the fields of its first sighting, and of all sightings the number of different pages, the first page, and the rank on the first page that tells one."""
    record = rows.groupBy(*keys).agg(F.min(F.struct(F.struct(*order).alias("at"), *fields)).alias("_r")).select(*keys, *[F.col(f"_r.{f}").alias(f) for f in fields])
    pages = seen_on(rows, keys, order, url, rank)
    told = F.min(F.when(F.col("rank").isNotNull(), F.struct("at", "rank")))["rank"]
    about = pages.groupBy(*keys).agg(F.count("*").alias("pages"), F.min(F.struct("at", url))[url].alias("first_page"), told.alias("first_rank"))
    return record.join(about, keys, "left").withColumn("pages", F.coalesce("pages", F.lit(0).cast("long")))
