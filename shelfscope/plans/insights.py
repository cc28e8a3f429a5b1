"""Ranked insights and recommendations, a filtered select per rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.catalog import CATALOG_SQL, catalog, medians

_STATS_SQL = f"""{CATALOG_SQL}, s AS (SELECT site, count(*) AS n, count(DISTINCT category || vendor) AS concepts, median(price) AS med, CAST(count(*) FILTER (WHERE on_sale) AS DOUBLE) / count(*) AS sale, CAST(count(*) FILTER (WHERE in_stock) AS DOUBLE) / nullif(count(in_stock), 0) AS stock FROM catalog GROUP BY site),
p AS (SELECT c.site, c.n AS n, o.n AS own_n, c.concepts AS concepts, o.concepts AS own_concepts, (o.med - c.med) / c.med * 100 AS gap, c.sale - o.sale AS sale_gap, o.stock - c.stock AS stock_gap FROM s c JOIN (SELECT * FROM s WHERE site = 0) o ON c.site <> 0),
i AS (SELECT site, 'price_high' AS rule, 1 AS ord, 70 AS importance, 'high' AS severity FROM p WHERE gap >= 10 UNION ALL SELECT site, 'price_low', 2, 60, 'medium' FROM p WHERE gap <= -10 UNION ALL SELECT site, 'assortment_gap', 3, 65, 'high' FROM p WHERE own_concepts - concepts >= 3 OR concepts - own_concepts >= 3
UNION ALL SELECT site, 'promo_pressure', 4, 55, 'medium' FROM p WHERE sale_gap >= 0.02 UNION ALL SELECT site, 'stock_gap', 5, 50, 'medium' FROM p WHERE stock_gap >= 0.05 OR stock_gap <= -0.05 UNION ALL SELECT site, 'catalog_breadth', 6, 40, 'low' FROM p WHERE n > own_n)"""


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over one row per competitor: an array of findings, exploded once."""
    share = lambda part, whole: F.try_divide(part.cast("double"), whole.cast("double"))
    rows = catalog(spark, sf_dir)
    s = rows.groupBy("site").agg(F.count("*").alias("n"), F.count_distinct(F.concat("category", "vendor")).alias("concepts"), share(F.count_if("on_sale"), F.count("*")).alias("sale"), share(F.count_if("in_stock"), F.count("in_stock")).alias("stock"))
    s = s.join(medians(rows, ["site"], "price", "med"), "site", "left")
    own = F.broadcast(s.where("site = 0").select(*(F.col(c).alias(f"own_{c}") for c in ("n", "concepts", "med", "sale", "stock"))))  # one row
    p = s.where("site <> 0").join(own)
    gap = (F.col("own_med") - F.col("med")) / F.col("med") * 100
    stock = F.col("own_stock") - F.col("stock")
    rules = [
        (gap >= 10, "price_high", 70, "high"), (gap <= -10, "price_low", 60, "medium"), (F.abs(F.col("own_concepts") - F.col("concepts")) >= 3, "assortment_gap", 65, "high"),
        (F.col("sale") - F.col("own_sale") >= 0.02, "promo_pressure", 55, "medium"), ((stock >= 0.05) | (stock <= -0.05), "stock_gap", 50, "medium"), (F.col("n") > F.col("own_n"), "catalog_breadth", 40, "low"),
    ]
    found = F.array(*(F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(n).alias("ord"), F.lit(weight).alias("importance"), F.lit(severity).alias("severity"))) for n, (test, rule, weight, severity) in enumerate(rules, 1)))
    return p.select("site", F.explode(F.array_compact(found)).alias("x")).select("site", "x.*")


@query(f"""WITH {_STATS_SQL} SELECT site, rule, severity, row_number() OVER (PARTITION BY site ORDER BY importance + CASE severity WHEN 'high' THEN 30 WHEN 'medium' THEN 18 ELSE 8 END DESC, ord) AS rank FROM i""")
def insights_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insights of each competitor by importance and severity, earlier rules first."""
    weight = F.col("importance") + F.when(F.col("severity") == "high", 30).when(F.col("severity") == "medium", 18).otherwise(8)
    return insights(spark, sf_dir).select("site", "rule", "severity", F.row_number().over(Window.partitionBy("site").orderBy(weight.desc(), "ord")).alias("rank"))


@query(f"""WITH {_STATS_SQL}, g AS (SELECT rule, max(importance) AS importance, count(*) AS competitors FROM i GROUP BY rule) SELECT *, row_number() OVER (ORDER BY importance DESC, rule) AS rank FROM g""")
def recommendations_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recommendation per rule that holds anywhere."""
    g = insights(spark, sf_dir).groupBy("rule").agg(F.max("importance").alias("importance"), F.count("*").alias("competitors"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "rule")))  # a row per rule
