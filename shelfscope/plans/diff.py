"""Change detection between two snapshots, one full outer join and an array of findings per pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.catalog import SNAPSHOT_SQL, rnd, snapshots

PREVIOUS, CURRENT = 1998, 1999

_PAIRS_SQL = f"""{SNAPSHOT_SQL}, p AS (SELECT * FROM snapshots WHERE year = {PREVIOUS}), c AS (SELECT * FROM snapshots WHERE year = {CURRENT}),
pairs AS (SELECT coalesce(p.site, c.site) AS site, coalesce(p.product, c.product) AS product, p.site IS NOT NULL AS had, c.site IS NOT NULL AS has, coalesce(p.category, c.category) AS category,
    p.price AS old_price, c.price AS new_price, p.on_sale AS old_sale, c.on_sale AS new_sale, p.in_stock AS old_stock, c.in_stock AS new_stock, p.rank AS old_rank, c.rank AS new_rank
    FROM p FULL JOIN c ON p.site = c.site AND p.product = c.product)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both states of every product that either snapshot has."""
    both = snapshots(spark, sf_dir).where(F.col("year").isin(PREVIOUS, CURRENT))

    def side(year: int, prefix: str) -> DataFrame:
        return both.where(F.col("year") == year).select("site", "product", F.lit(True).alias(f"{prefix}_there"), F.col("category").alias(f"{prefix}_category"), *(F.col(a).alias(f"{prefix}_{b}") for a, b in (("price", "price"), ("on_sale", "sale"), ("in_stock", "stock"), ("rank", "rank"))))

    joined = side(PREVIOUS, "old").join(side(CURRENT, "new"), ["site", "product"], "full_outer")
    return joined.withColumns({"had": F.coalesce("old_there", F.lit(False)), "has": F.coalesce("new_there", F.lit(False)), "category": F.coalesce("old_category", "new_category")})


def _percent() -> Column:
    return rnd((F.col("new_price") - F.col("old_price")) / F.col("old_price") * 100, 2)


_PERCENT_SQL = "(floor(((new_price - old_price) / old_price * 100) * 100 + 0.5) / 100)"


@query(f"WITH {_PAIRS_SQL} SELECT site, product, CASE WHEN has THEN 'new_product' ELSE 'removed_product' END AS type FROM pairs WHERE had <> has")
def diff_new_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that came and went."""
    return pairs(spark, sf_dir).where("had <> has").select("site", "product", F.when(F.col("has"), "new_product").otherwise("removed_product").alias("type"))


@query(f"WITH {_PAIRS_SQL} SELECT site, product, old_price, new_price, {_PERCENT_SQL} AS percent FROM pairs WHERE old_price > 0 AND new_price > 0 AND abs({_PERCENT_SQL}) >= 5")
def diff_price_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices that moved by 5 % or more."""
    rows = pairs(spark, sf_dir).where("old_price > 0 and new_price > 0").withColumn("percent", _percent())
    return rows.where(F.abs("percent") >= 5).select("site", "product", "old_price", "new_price", "percent")


@query(f"""WITH {_PAIRS_SQL} SELECT site, product, CASE WHEN new_sale THEN 'sale_started' ELSE 'sale_ended' END AS type FROM pairs WHERE had AND has AND old_sale <> new_sale
UNION ALL SELECT site, product, CASE WHEN new_stock THEN 'back_in_stock' ELSE 'out_of_stock' END FROM pairs WHERE old_stock IS NOT NULL AND new_stock IS NOT NULL AND old_stock <> new_stock""")
def diff_sale_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales that began or ended and stock that changed, where both sides are known."""
    sale = F.when(F.col("old_sale") != F.col("new_sale"), F.when(F.col("new_sale"), "sale_started").otherwise("sale_ended"))
    stock = F.when(F.col("old_stock") != F.col("new_stock"), F.when(F.col("new_stock"), "back_in_stock").otherwise("out_of_stock"))
    return pairs(spark, sf_dir).select("site", "product", F.explode(F.array_compact(F.array(sale, stock))).alias("type"))


@query(f"WITH {_PAIRS_SQL} SELECT site, product, old_rank - new_rank AS delta, CASE WHEN abs(old_rank - new_rank) >= 10 THEN 'high' ELSE 'medium' END AS severity FROM pairs WHERE abs(old_rank - new_rank) >= 3")
def diff_rank_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks that moved by three places or more."""
    rows = pairs(spark, sf_dir).withColumn("delta", F.col("old_rank") - F.col("new_rank")).where(F.abs("delta") >= 3)
    return rows.select("site", "product", "delta", F.when(F.abs("delta") >= 10, "high").otherwise("medium").alias("severity"))


@query(f"""WITH {SNAPSHOT_SQL}, g AS (SELECT site, category, year, count(*) AS n, min(price) AS floor_price FROM snapshots WHERE year IN ({PREVIOUS}, {CURRENT}) GROUP BY ALL)
SELECT p.site, p.category, c.n - p.n AS size_change, CASE WHEN abs(c.n - p.n) >= 5 THEN 'high' ELSE 'medium' END AS size_severity, p.floor_price AS old_floor, c.floor_price AS new_floor
FROM g p JOIN g c ON p.site = c.site AND p.category = c.category AND p.year = {PREVIOUS} AND c.year = {CURRENT} WHERE c.n <> p.n OR p.floor_price <> c.floor_price""")
def diff_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections whose size or price floor changed.  Both years come from one aggregation."""
    both = snapshots(spark, sf_dir).where(F.col("year").isin(PREVIOUS, CURRENT))
    old, new = F.col("year") == PREVIOUS, F.col("year") == CURRENT
    g = both.groupBy("site", "category").agg(F.count_if(old).alias("p"), F.count_if(new).alias("c"), F.min(F.when(old, F.col("price"))).alias("old_floor"), F.min(F.when(new, F.col("price"))).alias("new_floor"))
    g = g.where("p > 0 and c > 0 and (p <> c or old_floor <> new_floor)").withColumn("size_change", F.col("c") - F.col("p"))
    return g.select("site", "category", "size_change", F.when(F.abs("size_change") >= 5, "high").otherwise("medium").alias("size_severity"), "old_floor", "new_floor")


@query(f"""WITH {SNAPSHOT_SQL}, g AS (SELECT site, lower(name) AS plan, year, min(price) AS amount FROM snapshots WHERE year IN ({PREVIOUS}, {CURRENT}) GROUP BY ALL), p AS (SELECT * FROM g WHERE year = {PREVIOUS}), c AS (SELECT * FROM g WHERE year = {CURRENT})
SELECT coalesce(p.site, c.site) AS site, coalesce(p.plan, c.plan) AS plan, CASE WHEN p.site IS NULL THEN 'plan_added' WHEN c.site IS NULL THEN 'plan_removed' ELSE 'plan_price_change' END AS type,
CASE WHEN p.site IS NULL OR c.site IS NULL OR abs((c.amount - p.amount) / p.amount * 100) >= 20 THEN 'critical' ELSE 'high' END AS severity
FROM p FULL JOIN c ON p.site = c.site AND p.plan = c.plan WHERE p.amount IS DISTINCT FROM c.amount""")
def diff_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans (products by name, whatever the case) added, removed or repriced."""
    both = snapshots(spark, sf_dir).where(F.col("year").isin(PREVIOUS, CURRENT))
    g = both.groupBy("site", F.lower("name").alias("plan")).agg(F.min(F.when(F.col("year") == PREVIOUS, F.col("price"))).alias("p"), F.min(F.when(F.col("year") == CURRENT, F.col("price"))).alias("c"))
    g = g.where(~F.col("p").eqNullSafe(F.col("c")))
    kind = F.when(F.col("p").isNull(), "plan_added").when(F.col("c").isNull(), "plan_removed").otherwise("plan_price_change")
    hard = F.col("p").isNull() | F.col("c").isNull() | (F.abs((F.col("c") - F.col("p")) / F.col("p") * 100) >= 20)
    return g.select("site", "plan", kind.alias("type"), F.when(hard, "critical").otherwise("high").alias("severity"))


@query(f"""WITH {SNAPSHOT_SQL}, g AS (SELECT site, name, bool_or(year = {PREVIOUS}) AS p, bool_or(year = {CURRENT}) AS c FROM snapshots WHERE year IN ({PREVIOUS}, {CURRENT}) GROUP BY site, name),
r AS (SELECT *, row_number() OVER (PARTITION BY site, c ORDER BY name) AS n FROM g WHERE p <> c)
SELECT site, coalesce(string_agg(name, ',' ORDER BY name) FILTER (c AND n <= 10), '') AS added, coalesce(string_agg(name, ',' ORDER BY name) FILTER (p AND n <= 10), '') AS removed FROM r GROUP BY site""")
def diff_nav_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels added and removed, ten at most of each."""
    both = snapshots(spark, sf_dir).where(F.col("year").isin(PREVIOUS, CURRENT))
    flags = both.groupBy("site", "name").agg(F.bool_or(F.col("year") == PREVIOUS).alias("p"), F.bool_or(F.col("year") == CURRENT).alias("c")).where("p <> c")
    first = flags.withColumn("n", F.row_number().over(Window.partitionBy("site", "c").orderBy("name"))).where("n <= 10")
    told = lambda side: F.array_join(F.array_sort(F.collect_list(F.when(F.col(side), F.col("name")))), ",")
    return first.groupBy("site").agg(told("c").alias("added"), told("p").alias("removed"))


@query(f"""WITH {SNAPSHOT_SQL}, g AS (SELECT site, year, count(*) FILTER (WHERE on_sale) > 10 AS sale, count(*) FILTER (WHERE in_stock) > 10 AS stock, max(price) > 90000 AS luxury FROM snapshots WHERE year IN ({PREVIOUS}, {CURRENT}) GROUP BY ALL),
f AS (SELECT site, year, unnest(['sale', 'stock', 'luxury']) AS feature, unnest([sale, stock, luxury]) AS on_ FROM g)
SELECT coalesce(p.site, c.site) AS site, coalesce(p.feature, c.feature) AS feature, coalesce(c.on_, false) AS is_on FROM (SELECT * FROM f WHERE year = {PREVIOUS}) p FULL JOIN (SELECT * FROM f WHERE year = {CURRENT}) c ON p.site = c.site AND p.feature = c.feature WHERE coalesce(p.on_, false) <> coalesce(c.on_, false)""")
def diff_feature_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a site that were switched, a missing one counting as off."""
    both = snapshots(spark, sf_dir).where(F.col("year").isin(PREVIOUS, CURRENT))

    def flags(year: int) -> Column:
        own = F.col("year") == year
        return F.map_from_arrays(F.array(*map(F.lit, ("sale", "stock", "luxury"))), F.array(F.count_if(own & F.col("on_sale")) > 10, F.count_if(own & F.col("in_stock")) > 10, F.coalesce(F.max(F.when(own, F.col("price"))) > 90000, F.lit(False))))

    rows = both.groupBy("site").agg(flags(PREVIOUS).alias("p"), flags(CURRENT).alias("c")).select("site", "p", F.explode("c").alias("feature", "is_on"))
    return rows.where(F.col("is_on") != F.col("p")[F.col("feature")]).select("site", "feature", "is_on")


_CHANGES_SQL = f"""{_PAIRS_SQL}, changes AS (
    SELECT site, product, CASE WHEN has THEN 'new_product' ELSE 'removed_product' END AS type, CASE WHEN has THEN 'high' ELSE 'medium' END AS severity FROM pairs WHERE had <> has
    UNION ALL SELECT site, product, 'price_change', CASE WHEN abs({_PERCENT_SQL}) >= 15 THEN 'high' ELSE 'medium' END FROM pairs WHERE old_price > 0 AND new_price > 0 AND abs({_PERCENT_SQL}) >= 5
    UNION ALL SELECT site, product, CASE WHEN new_sale THEN 'sale_started' ELSE 'sale_ended' END, 'high' FROM pairs WHERE had AND has AND old_sale <> new_sale
    UNION ALL SELECT site, product, CASE WHEN new_stock THEN 'back_in_stock' ELSE 'out_of_stock' END, CASE WHEN new_stock THEN 'medium' ELSE 'high' END FROM pairs WHERE old_stock <> new_stock
    UNION ALL SELECT site, product, 'rank_change', CASE WHEN abs(old_rank - new_rank) >= 10 THEN 'high' ELSE 'medium' END FROM pairs WHERE abs(old_rank - new_rank) >= 3)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings: site, product, type, severity.  One pass over the joined pairs, no union of scans."""
    find = lambda when, kind, severity: F.when(when, F.struct(kind.alias("type"), severity.alias("severity")))
    percent, moved = _percent(), F.abs(F.col("old_rank") - F.col("new_rank"))
    priced = (F.col("old_price") > 0) & (F.col("new_price") > 0)
    found = F.array(
        find(F.col("had") != F.col("has"), F.when(F.col("has"), "new_product").otherwise("removed_product"), F.when(F.col("has"), "high").otherwise("medium")),
        find(priced & (F.abs(percent) >= 5), F.lit("price_change"), F.when(F.abs(percent) >= 15, "high").otherwise("medium")),
        find(F.col("old_sale") != F.col("new_sale"), F.when(F.col("new_sale"), "sale_started").otherwise("sale_ended"), F.lit("high")),
        find(F.col("old_stock") != F.col("new_stock"), F.when(F.col("new_stock"), "back_in_stock").otherwise("out_of_stock"), F.when(F.col("new_stock"), "medium").otherwise("high")),
        find(moved >= 3, F.lit("rank_change"), F.when(moved >= 10, "high").otherwise("medium")),
    )
    return pairs(spark, sf_dir).select("site", "product", F.explode(F.array_compact(found)).alias("x")).select("site", "product", "x.type", "x.severity")


@query(f"WITH {_CHANGES_SQL} SELECT * FROM changes")
def diff_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of every product."""
    return changes(spark, sf_dir)


@query(f"""WITH {_CHANGES_SQL}, lost AS (SELECT site, count(*) FILTER (WHERE NOT has) > 0.4 * count(*) FILTER (WHERE had) AS unstable FROM pairs GROUP BY site)
SELECT site, product, type, CASE WHEN unstable AND type IN ('removed_product', 'out_of_stock', 'rank_change') THEN 'low' ELSE severity END AS severity, unstable AND type IN ('removed_product', 'out_of_stock', 'rank_change') AS unreliable FROM changes JOIN lost USING (site)""")
def diff_dampening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a site lost over 40 % of its products the crawl is doubted: some findings become low and unreliable."""
    lost = pairs(spark, sf_dir).groupBy("site").agg((F.count_if(~F.col("has")) > F.lit(0.4) * F.count_if("had")).alias("unstable"))
    doubt = F.col("unstable") & F.col("type").isin("removed_product", "out_of_stock", "rank_change")
    return changes(spark, sf_dir).join(lost, "site").select("site", "product", "type", F.when(doubt, "low").otherwise(F.col("severity")).alias("severity"), doubt.alias("unreliable"))


@query(f"WITH {_CHANGES_SQL} SELECT site, type, count(*) AS changes, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium FROM changes GROUP BY site, type")
def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes by site, type and severity."""
    return changes(spark, sf_dir).groupBy("site", "type").agg(F.count("*").alias("changes"), F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"))


_POINTS_SQL = "CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 75 WHEN 'medium' THEN 45 ELSE 15 END"


def points() -> Column:
    return F.when(F.col("severity") == "critical", 100).when(F.col("severity") == "high", 75).when(F.col("severity") == "medium", 45).otherwise(15)


@query(f"""WITH {_CHANGES_SQL}, s AS (SELECT site, {_POINTS_SQL} AS p, row_number() OVER (PARTITION BY site ORDER BY {_POINTS_SQL} DESC) AS n, count(*) OVER (PARTITION BY site) AS all_ FROM changes)
SELECT site, least(100, floor(CAST(sum(p) AS DOUBLE) / count(*) + least(15, max(all_) * 0.5) + 0.5)) AS score FROM s WHERE n <= 5 GROUP BY site""")
def change_score_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the five gravest changes and a bonus for their number.  Counts by severity suffice; no list is gathered."""
    n = changes(spark, sf_dir).withColumn("p", points()).groupBy("site").agg(F.count("*").alias("all"), *(F.count_if(F.col("p") == p).alias(f"n{p}") for p in (100, 75, 45, 15)))
    total, left = F.lit(0), F.least(F.lit(5), F.col("all"))
    whole = left
    for p in (100, 75, 45, 15):
        take = F.least(left, F.col(f"n{p}"))
        total, left = total + take * p, left - take
    return n.select("site", F.least(F.lit(100.0), F.floor(total.cast("double") / whole + F.least(F.lit(15.0), F.col("all") * 0.5) + 0.5).cast("double")).alias("score"))


@query(f"WITH {_CHANGES_SQL} SELECT site, least(100.0, round_even(CAST(sum({_POINTS_SQL}) AS DOUBLE) / count(*), 0)) AS score FROM changes GROUP BY site")
def change_score_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other engine's score: the plain mean, rounded half to even."""
    return changes(spark, sf_dir).groupBy("site").agg(F.least(F.lit(100.0), F.bround(F.sum(points()).cast("double") / F.count("*"), 0)).alias("score"))


@query(f"""WITH {_CHANGES_SQL}, s AS (SELECT site, max({_POINTS_SQL}) AS top, count(*) AS n FROM changes GROUP BY site)
SELECT site, CASE WHEN top >= 90 THEN 'critical' WHEN top >= 65 THEN 'high' WHEN top >= 30 THEN 'medium' ELSE 'low' END AS severity, top >= 65 AND n >= 3 AS should_send FROM s""")
def severity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site's gravest severity and whether it is worth a report."""
    s = changes(spark, sf_dir).groupBy("site").agg(F.max(points()).alias("top"), F.count("*").alias("n"))
    bucket = F.when(F.col("top") >= 90, "critical").when(F.col("top") >= 65, "high").when(F.col("top") >= 30, "medium").otherwise("low")
    return s.select("site", bucket.alias("severity"), ((F.col("top") >= 65) & (F.col("n") >= 3)).alias("should_send"))
