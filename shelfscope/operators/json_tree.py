"""JSON values as tables of nodes, and differences of two reports path by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 12


def walk(rows: DataFrame, keys: list[str], json_col: str, identity: tuple[str, ...] = (), depth: int = DEPTH) -> DataFrame:
    """All nodes of JSON texts down to ``depth``: keys, path, level, kind, value (of leaves, as text; null for null and for what has parts).

    A path is made of /name and /[place]; an item of a list that is an object with one of the
    ``identity`` names has /[its value] instead, so that lists can be matched whatever their order.
    One step takes all nodes of a level apart at once, within the row of their text; texts that are no
    JSON have no nodes.
    """
    return rows.select(*keys, F.inline(nodes(F.col(json_col), identity, depth)))


def nodes(json: Column, identity: tuple[str, ...] = (), depth: int = DEPTH) -> Column:
    """The nodes of a JSON text as array of struct(path, level, kind, value), level by level."""

    def parts(n: Column) -> Column:
        named = lambda v, k: F.coalesce(*[F.try_variant_get(v, f"$.{name}", "string") for name in identity], k.cast("string")) if identity else k.cast("string")
        place = lambda v, k: F.when(v.try_cast("map<string,variant>").isNotNull(), named(v, k)).otherwise(k.cast("string"))
        fields = F.transform(F.map_entries(n["v"].try_cast("map<string,variant>")), lambda e: F.struct(F.concat(n["path"], F.lit("/"), e["key"]).alias("path"), e["value"].alias("v")))
        items = F.transform(n["v"].try_cast("array<variant>"), lambda v, k: F.struct(F.concat(n["path"], F.lit("/["), place(v, k), F.lit("]")).alias("path"), v.alias("v")))
        return F.coalesce(fields, items, F.array().cast("array<struct<path:string,v:variant>>"))

    def node(n: Column, level: Column) -> Column:
        schema = F.schema_of_variant(n["v"])
        leaf = F.when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean").when(schema == "VOID", "null").otherwise("number")
        kind = F.when(n["v"].try_cast("map<string,variant>").isNotNull(), "object").when(n["v"].try_cast("array<variant>").isNotNull(), "array")
        return F.struct(n["path"].alias("path"), level.alias("level"), F.coalesce(kind, leaf).alias("kind"), F.when(kind.isNull(), n["v"].try_cast("string")).alias("value"))

    step = lambda found, level: F.when(F.size(found["todo"]) == 0, found).otherwise(F.struct(F.flatten(F.transform(found["todo"], parts)).alias("todo"), F.concat(found["done"], F.transform(found["todo"], lambda n: node(n, level))).alias("done")))
    whole = F.filter(F.array(F.struct(F.lit("").alias("path"), F.try_parse_json(json).alias("v"))), lambda n: n["v"].isNotNull())
    nothing = F.array().cast("array<struct<path:string,level:int,kind:string,value:string>>")
    return F.reduce(F.sequence(F.lit(0), F.lit(depth)), F.struct(whole.alias("todo"), nothing.alias("done")), step, lambda found: found["done"])


def report_changes(old: DataFrame, new: DataFrame, keys: list[str], json_col: str, identity: tuple[str, ...]) -> DataFrame:
    """pair_changes() of the reports of two tables by their keys."""
    both = old.select(*keys, F.col(json_col).alias("old")).join(new.select(*keys, F.col(json_col).alias("new")), keys, "full_outer")
    return pair_changes(both, keys, identity)


def pair_changes(pairs: DataFrame, keys: list[str], identity: tuple[str, ...]) -> DataFrame:
    """What differs between two reports, old and new, of a row: keys, path, change (added, removed or changed), old, new.

    Leaves are matched by path; numbers that are equal as numbers and texts that differ in case or
    white space only are no change.  Of several leaves at one path the first text counts.
    """
    both = pairs.select(*keys, F.inline(F.array(F.struct(F.lit(False).alias("is_new"), F.col("old").alias("report")), F.struct(F.lit(True).alias("is_new"), F.col("new").alias("report")))))
    leaves = both.select(*keys, "is_new", F.inline(nodes(F.col("report"), identity))).where("kind not in ('object', 'array')")
    side = lambda name, test: (F.min(F.when(test, F.col("value"))).alias(name), F.bool_or(test).alias(f"in_{name}"))
    found = leaves.groupBy(*keys, "path").agg(*side("old", ~F.col("is_new")), *side("new", F.col("is_new")))
    change = F.when(~F.col("in_old"), "added").when(~F.col("in_new"), "removed").when(~same(F.col("old"), F.col("new")), "changed")
    return found.select(*keys, "path", change.alias("change"), "old", "new").where("change is not null")


def same(a: Column, b: Column) -> Column:
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) < 1e-9).otherwise(same_text(a, b))


def same_text(a: Column, b: Column) -> Column:
    """Whether texts differ in case or white space only, or not at all."""
    flat = lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))
    return a.eqNullSafe(b) | F.coalesce(flat(a) == flat(b), F.lit(False))
