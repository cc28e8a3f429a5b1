"""Sites, products, snapshots and pages as DataFrames over the base tables.

A supplier is a site (supplier 0 the owner's, all others competitors'), a (supplier, part) pair a
product of it, and its newest line item tells price, discount and stock.  The same views exist as
SQL (CATALOG_SQL, SNAPSHOT_SQL) for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def rnd(value: Column, digits: int) -> Column:
    """Half-up rounding written out: engines disagree on how round() treats halves that binary fractions only come near."""
    scale = float(10**digits)
    return F.floor(value.cast("double") * scale + 0.5).cast("double") / scale


def rnd_sql(value: str, digits: int) -> str:
    return f"(floor(({value}) * {10**digits} + 0.5) / {10**digits})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows by a key over all tasks, for what is costly by row: a narrow table is one file, and would be one task's work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _newest() -> Column:
    """The line item that tells a product's state; max of a struct combines before the shuffle, where a window would sort all rows."""
    return F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"))


def _state(newest: str = "x") -> list[Column]:
    price = rnd(F.col(f"{newest}.l_extendedprice") / F.col(f"{newest}.l_quantity"), 2)
    discount = F.col(f"{newest}.l_discount")
    return [
        price.alias("price"),
        (discount > 0).alias("on_sale"),
        rnd(discount * 100, 1).alias("discount_percent"),
        F.when(F.col(f"{newest}.l_returnflag") != "R", F.col(f"{newest}.l_linestatus") == "O").alias("in_stock"),
        F.col(f"{newest}.l_linenumber").alias("rank"),
    ]


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per site and product: site, product, name, category, vendor, size, list_price, price, on_sale, discount_percent, in_stock, rank."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(_newest().alias("x"))
    part = table(spark, sf_dir, "part")
    return lines.join(part, lines.l_partkey == part.p_partkey).select(
        F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("product"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_brand").alias("vendor"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("list_price"), *_state()
    )


def priced(spark: SparkSession, sf_dir: str, part: DataFrame | None = None) -> DataFrame:
    """site, product, price, rank of catalog(), and the columns of ``part`` (product first; by default its name, category, vendor), with the rows of a site in one task.

    Lines carry only what tells price and rank, and are dealt out by product before they are grouped,
    so that they meet their part where they lie, also where parts are too many to be sent around.
    """
    if part is None:
        part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_brand").alias("vendor"))
    newest = ("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", *newest).repartition("l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.max(F.struct(*newest)).alias("x"))
    rows = lines.join(part, lines.l_partkey == part.product)
    return rows.select(F.col("l_suppkey").alias("site"), "product", rnd(F.col("x.l_extendedprice") / F.col("x.l_quantity"), 2).alias("price"), F.col("x.l_linenumber").alias("rank"), *part.columns[1:]).repartition("site")


CATALOG_SQL = """catalog AS (
    SELECT l_suppkey AS site, l_partkey AS product, p_name AS name, p_type AS category, p_brand AS vendor, p_size AS size, p_retailprice AS list_price,
           floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price, l_discount > 0 AS on_sale, floor(l_discount * 100 * 10 + 0.5) / 10 AS discount_percent,
           CASE WHEN l_returnflag <> 'R' THEN l_linestatus = 'O' END AS in_stock, l_linenumber AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_returnflag DESC, l_linestatus DESC) AS n FROM lineitem)
    JOIN part ON p_partkey = l_partkey WHERE n = 1
)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as it was in each year: site, product, year and the state by that year's newest line item."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey", F.year("l_shipdate").alias("year")).agg(_newest().alias("x"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("category"))
    return lines.join(part, lines.l_partkey == part.p_partkey).select(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("product"), "year", "name", "category", *_state())


SNAPSHOT_SQL = """snapshots AS (
    SELECT l_suppkey AS site, l_partkey AS product, year, p_name AS name, p_type AS category,
           floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price, l_discount > 0 AS on_sale, floor(l_discount * 100 * 10 + 0.5) / 10 AS discount_percent,
           CASE WHEN l_returnflag <> 'R' THEN l_linestatus = 'O' END AS in_stock, l_linenumber AS rank
    FROM (SELECT *, year(l_shipdate) AS year, row_number() OVER (PARTITION BY l_suppkey, l_partkey, year(l_shipdate) ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_returnflag DESC, l_linestatus DESC) AS n FROM lineitem)
    JOIN part ON p_partkey = l_partkey WHERE n = 1
)"""


def medians(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Exact medians by group (keys, name): counts by distinct value and their running sum, so no group is gathered."""
    by = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    n = by.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    upto = by.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys).orderBy(value))).join(n, keys)
    at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col(value)))
    return upto.groupBy(*keys).agg(((at(F.floor((F.col("_n") + 1) / 2)) + at(F.floor(F.col("_n") / 2) + 1)) / 2).alias(name))


def mean(value: str, digits: int) -> Column:
    """A mean over decimals, so that the order of summing does not matter."""
    total = F.sum(F.col(value).cast("decimal(18,4)")).cast("double")
    return rnd(F.try_divide(total, F.count(value).cast("double")), digits)


def mean_sql(value: str, digits: int) -> str:
    return rnd_sql(f"CAST(sum(CAST({value} AS DECIMAL(18,4))) AS DOUBLE) / nullif(count({value}), 0)", digits)


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """A share rounded to four places; 0 of nothing."""
    return F.coalesce(rnd(F.try_divide(part.cast("double"), whole.cast("double")), digits), F.lit(0.0))


def rate_sql(part: str, whole: str, digits: int = 4) -> str:
    return f"coalesce({rnd_sql(f'CAST({part} AS DOUBLE) / nullif({whole}, 0)', digits)}, 0.0)"
