"""Comparison views: one row, or a few, per site."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.catalog import CATALOG_SQL, catalog, mean, medians, mean_sql, rate, rate_sql, rnd, table




@query(f"""WITH {CATALOG_SQL}
SELECT site, count(*) AS products, {rate_sql('count(price)', 'count(*)', 3)} AS price_coverage, min(price) AS min_price, max(price) AS max_price, {mean_sql('price', 2)} AS avg_price,
       count(*) FILTER (WHERE on_sale) AS on_sale, max(discount_percent) AS max_discount, count(*) FILTER (WHERE in_stock) AS in_stock, count(*) FILTER (WHERE NOT in_stock) AS out_of_stock,
       count(DISTINCT category) AS categories, count(DISTINCT vendor) AS vendors
FROM catalog GROUP BY site""")
def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, price range, sales and stock of every site's catalog."""
    return catalog(spark, sf_dir).groupBy("site").agg(
        F.count("*").alias("products"), rate(F.count("price"), F.count("*"), 3).alias("price_coverage"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), mean("price", 2).alias("avg_price"),
        F.count_if("on_sale").alias("on_sale"), F.max("discount_percent").alias("max_discount"), F.count_if("in_stock").alias("in_stock"), F.count_if(~F.col("in_stock")).alias("out_of_stock"),
        F.count_distinct("category").alias("categories"), F.count_distinct("vendor").alias("vendors"),
    )


@query(f"""WITH {CATALOG_SQL}
SELECT category, site, count(*) AS products, min(price) AS min_price, max(price) AS max_price, {mean_sql('price', 2)} AS avg_price, (floor((median(price)) * 100 + 0.5) / 100) AS median_price, count(*) FILTER (WHERE on_sale) AS on_sale
FROM catalog GROUP BY category, site""")
def category_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each site covers each category."""
    rows = catalog(spark, sf_dir)
    g = rows.groupBy("category", "site").agg(F.count("*").alias("products"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), mean("price", 2).alias("avg_price"), F.count_if("on_sale").alias("on_sale"))
    return g.join(medians(rows, ["category", "site"], "price", "m"), ["category", "site"], "left").withColumn("median_price", rnd(F.col("m"), 2)).drop("m")


_CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(f"WITH {CATALOG_SQL} SELECT site, " + ", ".join(f"count(*) FILTER (WHERE category = '{c}') AS {c.lower()}" for c in _CATEGORIES) + " FROM catalog GROUP BY site")
def category_coverage_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products per site, one column per category."""
    wide = catalog(spark, sf_dir).groupBy("site").pivot("category", _CATEGORIES).count()
    return wide.select("site", *(F.coalesce(c, F.lit(0)).cast("long").alias(c.lower()) for c in _CATEGORIES))


#: Vendors stand for fine categories here: a site has some of them only.
@query(f"""WITH {CATALOG_SQL}, c AS (SELECT DISTINCT site, category || '/' || vendor AS concept FROM catalog),
own AS (SELECT concept FROM c WHERE site = 0)
SELECT concept, count(DISTINCT site) AS competitors FROM c WHERE site <> 0 AND concept NOT IN (SELECT concept FROM own) GROUP BY concept""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What competitors have and the owner has not."""
    have = catalog(spark, sf_dir).select("site", F.concat_ws("/", "category", "vendor").alias("concept")).distinct()
    own = have.where("site = 0").select("concept")
    return have.where("site <> 0").join(own, "concept", "left_anti").groupBy("concept").agg(F.count_distinct("site").alias("competitors"))


@query(f"""WITH {CATALOG_SQL}, c AS (SELECT DISTINCT site, product || '/' || rank || '/' || CAST(discount_percent AS INTEGER) AS concept FROM catalog)
SELECT concept, min(site) AS site FROM c GROUP BY concept HAVING count(*) = 1""")
def exclusive_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What only one site has: a product at a place of the listing with a discount."""
    have = catalog(spark, sf_dir).select("site", F.concat_ws("/", "product", "rank", F.col("discount_percent").cast("int")).alias("concept")).distinct()
    return have.groupBy("concept").agg(F.min("site").alias("site"), F.count("*").alias("n")).where("n = 1").drop("n")


@query(f"""WITH {CATALOG_SQL}
SELECT site, count(*) FILTER (WHERE on_sale) AS on_sale, {rate_sql('count(*) FILTER (WHERE on_sale)', 'count(price)')} AS sale_rate,
       (floor((CAST(sum(CASE WHEN on_sale THEN CAST(discount_percent AS DECIMAL(18,4)) END) AS DOUBLE) / nullif(count(*) FILTER (WHERE on_sale), 0)) * 10 + 0.5) / 10) AS avg_discount, max(discount_percent) AS max_discount
FROM catalog GROUP BY site""")
def sale_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of priced products on sale, mean discount of those, and the deepest."""
    total = F.sum(F.when(F.col("on_sale"), F.col("discount_percent").cast("decimal(18,4)"))).cast("double")
    return catalog(spark, sf_dir).groupBy("site").agg(F.count_if("on_sale").alias("on_sale"), rate(F.count_if("on_sale"), F.count("price")).alias("sale_rate"), rnd(F.try_divide(total, F.count_if("on_sale").cast("double")), 1).alias("avg_discount"), F.max("discount_percent").alias("max_discount"))


@query(f"""WITH {CATALOG_SQL} SELECT site, product, discount_percent, rk FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY coalesce(discount_percent, 0) DESC, product) AS rk FROM catalog) WHERE rk <= 10""")
def deepest_discounts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten deepest discounts of each site."""
    order = Window.partitionBy("site").orderBy(F.coalesce("discount_percent", F.lit(0)).desc(), "product")
    return catalog(spark, sf_dir).withColumn("rk", F.row_number().over(order)).where("rk <= 10").select("site", "product", "discount_percent", "rk")


@query("""SELECT source AS site, count(*) AS documents, (floor((CAST(count(text) AS DOUBLE) / greatest(count(*), 1)) * 10000 + 0.5) / 10000) AS text_rate, CAST(sum(length(text)) AS BIGINT) AS characters,
       (floor((CAST(sum(length(text)) AS DOUBLE) / greatest(count(*), 1)) * 100 + 0.5) / 100) AS avg_characters, (floor((CAST(count(*) FILTER (WHERE contains(text, chr(10))) AS DOUBLE) / greatest(count(*), 1)) * 10000 + 0.5) / 10000) AS multi_line_rate
FROM documents GROUP BY source""")
def content_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much and how structured the text of each source is."""
    n = F.greatest(F.count("*"), F.lit(1)).cast("double")
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("site")).agg(
        F.count("*").alias("documents"), rnd(F.count("text") / n, 4).alias("text_rate"), F.sum(F.length("text").cast("long")).alias("characters"),
        rnd(F.sum(F.length("text").cast("long")).cast("double") / n, 2).alias("avg_characters"), rnd(F.count_if(F.contains("text", F.lit("\n"))) / n, 4).alias("multi_line_rate"),
    )


@query(f"""WITH {CATALOG_SQL}, s AS (SELECT site, min(price) AS min_price, max(price) AS max_price, {mean_sql('price', 2)} AS avg_price, count(price) AS priced FROM catalog WHERE price > 0 GROUP BY site),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY price, product) AS low, row_number() OVER (PARTITION BY site ORDER BY price DESC, product) AS high FROM catalog WHERE price > 0)
SELECT s.*, (SELECT string_agg(product, ',' ORDER BY low) FROM r WHERE r.site = s.site AND low <= 10) AS lowest, (SELECT string_agg(product, ',' ORDER BY high) FROM r WHERE r.site = s.site AND high <= 10) AS highest FROM s""")
def price_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price range and mean of each site with its ten cheapest and ten dearest products."""
    priced = catalog(spark, sf_dir).where("price > 0")
    stats = priced.groupBy("site").agg(F.min("price").alias("min_price"), F.max("price").alias("max_price"), mean("price", 2).alias("avg_price"), F.count("price").alias("priced"))
    by = Window.partitionBy("site")

    def ten(name: str, order: F.Column) -> DataFrame:
        """The ends of one side only, so that the window's limit is applied before the shuffle."""
        first = priced.select("site", "product", F.row_number().over(by.orderBy(order, "product")).alias("n")).where("n <= 10")
        items = F.transform(F.sort_array(F.collect_list(F.struct("n", "product"))), lambda x: x["product"].cast("string"))
        return first.groupBy("site").agg(F.array_join(items, ",").alias(name))

    ends = ten("lowest", F.asc("price")).join(ten("highest", F.desc("price")), "site")
    return stats.join(ends, "site")


@query(f"""WITH {CATALOG_SQL} SELECT site, product, price, 'low' AS side, rk FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY price, product) AS rk FROM catalog WHERE price > 0) WHERE rk <= 10
UNION ALL SELECT site, product, price, 'high', rk FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY price DESC, product) AS rk FROM catalog WHERE price > 0) WHERE rk <= 10""")
def price_extremes_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten lowest and ten highest prices of each site."""
    priced, by = catalog(spark, sf_dir).where("price > 0").select("site", "product", "price"), Window.partitionBy("site")
    low = priced.withColumns({"side": F.lit("low"), "rk": F.row_number().over(by.orderBy("price", "product"))}).where("rk <= 10")
    high = priced.withColumns({"side": F.lit("high"), "rk": F.row_number().over(by.orderBy(F.desc("price"), "product"))}).where("rk <= 10")
    return low.unionByName(high)


@query(f"""WITH {CATALOG_SQL} SELECT site, count(*) AS products, count(*) FILTER (WHERE in_stock) AS in_stock, count(*) FILTER (WHERE NOT in_stock) AS out_of_stock, count(*) FILTER (WHERE in_stock IS NULL) AS unknown,
       {rate_sql('count(in_stock)', 'count(*)')} AS known_rate, (floor((CAST(count(*) FILTER (WHERE in_stock) AS DOUBLE) / nullif(count(in_stock), 0)) * 10000 + 0.5) / 10000) AS in_stock_rate FROM catalog GROUP BY site""")
def inventory_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock per site; rates are over products of known stock."""
    return catalog(spark, sf_dir).groupBy("site").agg(F.count("*").alias("products"), F.count_if("in_stock").alias("in_stock"), F.count_if(~F.col("in_stock")).alias("out_of_stock"), F.count_if(F.col("in_stock").isNull()).alias("unknown"), rate(F.count("in_stock"), F.count("*")).alias("known_rate"), rnd(F.try_divide(F.count_if("in_stock").cast("double"), F.count("in_stock").cast("double")), 4).alias("in_stock_rate"))


@query(f"""WITH {CATALOG_SQL} SELECT category, (floor((CAST(count(*) FILTER (WHERE in_stock) AS DOUBLE) / nullif(count(in_stock), 0)) * 10000 + 0.5) / 10000) AS in_stock_rate, {rate_sql('count(in_stock)', 'count(*)')} AS coverage FROM catalog GROUP BY category""")
def in_stock_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known-only stock rate and its coverage by category."""
    return catalog(spark, sf_dir).groupBy("category").agg(rnd(F.try_divide(F.count_if("in_stock").cast("double"), F.count("in_stock").cast("double")), 4).alias("in_stock_rate"), rate(F.count("in_stock"), F.count("*")).alias("coverage"))


@query(f"""WITH {CATALOG_SQL} SELECT site, category, n, rk FROM (SELECT site, category, count(*) AS n, row_number() OVER (PARTITION BY site ORDER BY count(*) DESC, category) AS rk FROM catalog GROUP BY site, category) WHERE rk <= 3""")
def merchandising(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest categories of each site."""
    n = catalog(spark, sf_dir).groupBy("site", "category").agg(F.count("*").alias("n"))
    return n.withColumn("rk", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("n"), "category"))).where("rk <= 3")


@query(f"""WITH {CATALOG_SQL}, n AS (SELECT site, count(DISTINCT category || '/' || vendor) AS concepts FROM catalog GROUP BY site)
SELECT n.site, n.concepts, n.concepts - o.concepts AS versus_owner FROM n CROSS JOIN (SELECT concepts FROM n WHERE site = 0) o""")
def market_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct concepts of each site and the difference to the owner's."""
    n = catalog(spark, sf_dir).groupBy("site").agg(F.count_distinct(F.concat_ws("/", "category", "vendor")).alias("concepts"))
    own = n.where("site = 0").select(F.col("concepts").alias("own"))  # one row
    return n.join(F.broadcast(own)).select("site", "concepts", (F.col("concepts") - F.col("own")).alias("versus_owner"))


@query(f"""WITH {CATALOG_SQL} SELECT site, {rate_sql('count(price)', 'count(*)')} AS price_rate, {rate_sql('count(in_stock)', 'count(*)')} AS stock_rate, {rate_sql('count(name)', 'count(*)')} AS name_rate, {rate_sql('count(DISTINCT name)', 'count(*)')} AS distinct_names FROM catalog GROUP BY site""")
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How complete each site's rows are."""
    n = F.count("*")
    return catalog(spark, sf_dir).groupBy("site").agg(rate(F.count("price"), n).alias("price_rate"), rate(F.count("in_stock"), n).alias("stock_rate"), rate(F.count("name"), n).alias("name_rate"), rate(F.count_distinct("name"), n).alias("distinct_names"))


@query(f"""WITH {CATALOG_SQL}, c AS (SELECT site, count(*) AS products, count(DISTINCT category) AS collections FROM catalog GROUP BY site)
SELECT s_suppkey AS site, s_name AS domain, CASE WHEN s_suppkey = 0 THEN 'Owner' ELSE 'Competitor' END AS role, n_name AS country, coalesce(products, 0) AS products, coalesce(collections, 0) AS collections
FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN c ON c.site = s_suppkey""")
def site_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every site with its role, country and counters, also sites without products."""
    counts = catalog(spark, sf_dir).groupBy(F.col("site").alias("s_suppkey")).agg(F.count("*").alias("products"), F.count_distinct("category").alias("collections"))
    sites = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left").join(counts, "s_suppkey", "left")
    return sites.select(F.col("s_suppkey").alias("site"), F.col("s_name").alias("domain"), F.when(F.col("s_suppkey") == 0, "Owner").otherwise("Competitor").alias("role"), F.col("n_name").alias("country"), F.coalesce("products", F.lit(0)).alias("products"), F.coalesce("collections", F.lit(0)).alias("collections"))


@query(f"""WITH {CATALOG_SQL} SELECT vendor, count(price) AS n, min(price) AS low, max(price) AS high, {mean_sql('price', 2)} AS mean, (floor((median(price)) * 100 + 0.5) / 100) AS median FROM catalog GROUP BY vendor""")
def price_stats_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, range, mean and exact median of prices by vendor."""
    rows = catalog(spark, sf_dir)
    g = rows.groupBy("vendor").agg(F.count("price").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"), mean("price", 2).alias("mean"))
    return g.join(medians(rows, ["vendor"], "price", "m"), "vendor", "left").withColumn("median", rnd(F.col("m"), 2)).drop("m")


@query(f"""WITH {CATALOG_SQL}, p AS (SELECT site, category, price, row_number() OVER (PARTITION BY site, category ORDER BY price, product) AS i, count(*) OVER (PARTITION BY site, category) AS n, product FROM catalog WHERE price > 0),
q AS (SELECT site, category, max(n) AS n, max(CASE WHEN i = greatest(1, round_even(n * 0.25, 0)) THEN price END) AS q1, max(CASE WHEN i = greatest(1, round_even(n * 0.5, 0)) THEN price END) AS q2, max(CASE WHEN i = greatest(1, round_even(n * 0.75, 0)) THEN price END) AS q3 FROM p GROUP BY site, category)
SELECT p.site, p.product, p.category, p.price, CASE WHEN p.price <= q1 THEN 'entry' WHEN p.price <= q2 THEN 'mid' WHEN p.price <= q3 THEN 'upper' ELSE 'premium' END AS band FROM p JOIN q USING (site, category) WHERE q.n >= 4""")
def price_band_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price bands by nearest-rank quartiles within a site's category."""
    priced = catalog(spark, sf_dir).where("price > 0").select("site", "product", "category", "price")
    # Counts by distinct price and their running sum; no group's prices are gathered.
    by = priced.groupBy("site", "category", "price").agg(F.count("*").alias("c"))
    n = by.groupBy("site", "category").agg(F.sum("c").alias("n")).where("n >= 4")
    upto = by.withColumn("upto", F.sum("c").over(Window.partitionBy("site", "category").orderBy("price"))).join(n, ["site", "category"])
    at = lambda q: F.min(F.when(F.col("upto") >= F.greatest(F.lit(1.0), F.bround(F.col("n") * F.lit(q), 0)), F.col("price")))
    cuts = upto.groupBy("site", "category").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    band = F.when(F.col("price") <= F.col("q1"), "entry").when(F.col("price") <= F.col("q2"), "mid").when(F.col("price") <= F.col("q3"), "upper").otherwise("premium")
    return priced.join(cuts, ["site", "category"]).select("site", "product", "category", "price", band.alias("band"))


@query(f"""WITH {CATALOG_SQL}, m AS (SELECT site, vendor, count(*) AS n, row_number() OVER (PARTITION BY site ORDER BY count(*) DESC, vendor) AS rk FROM catalog GROUP BY site, vendor)
SELECT c.site, c.product, c.vendor AS old_value, m.vendor AS new_value FROM catalog c JOIN m ON m.site = c.site AND m.rk = 1 WHERE c.vendor <> m.vendor""")
def currency_mode_restamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site's most frequent value overwrites what differs from it (vendors stand for currencies)."""
    rows = catalog(spark, sf_dir).select("site", "product", "vendor")
    mode = rows.groupBy("site", "vendor").agg(F.count("*").alias("n")).groupBy("site").agg(F.min(F.struct((-F.col("n")).alias("n"), "vendor")).alias("m")).select("site", F.col("m.vendor").alias("new_value"))
    return rows.join(mode, "site").where("vendor <> new_value").select("site", "product", F.col("vendor").alias("old_value"), "new_value")


@query(f"""WITH {CATALOG_SQL}, w AS (SELECT vendor, category AS term, 1.0 AS w FROM catalog UNION ALL SELECT vendor, unnest(string_split(name, ' ')), 0.3 FROM catalog),
s AS (SELECT vendor, term, (floor((CAST(sum(CAST(w AS DECIMAL(18,4))) AS DOUBLE)) * 100 + 0.5) / 100) AS weight FROM w GROUP BY vendor, term)
SELECT vendor, term, weight, rk FROM (SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY weight DESC, term) AS rk FROM s WHERE weight >= 1.5) WHERE rk <= 5""")
def dominant_types_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted histogram of types and name words: the five heaviest of each vendor."""
    rows = catalog(spark, sf_dir)
    terms = rows.select("vendor", F.col("category").alias("term"), F.lit(1.0).alias("w")).unionByName(rows.select("vendor", F.explode(F.split("name", " ")).alias("term"), F.lit(0.3).alias("w")))
    heavy = terms.groupBy("vendor", "term").agg(rnd(F.sum(F.col("w").cast("decimal(18,4)")).cast("double"), 2).alias("weight")).where("weight >= 1.5")
    return heavy.withColumn("rk", F.row_number().over(Window.partitionBy("vendor").orderBy(F.desc("weight"), "term"))).where("rk <= 5")


@query(f"""WITH {CATALOG_SQL}, m AS (SELECT vendor, category, count(*) AS n, row_number() OVER (PARTITION BY vendor ORDER BY count(*) DESC, category) AS rk FROM catalog GROUP BY vendor, category)
SELECT c.site, count(*) FILTER (WHERE c.category <> m.category) AS mismatches, (floor((CAST(count(*) FILTER (WHERE c.category <> m.category) AS DOUBLE) / count(*)) * 10000 + 0.5) / 10000) AS mismatch_rate FROM catalog c JOIN m ON m.vendor = c.vendor AND m.rk = 1 GROUP BY c.site HAVING CAST(count(*) FILTER (WHERE c.category <> m.category) AS DOUBLE) / count(*) > 0.15""")
def category_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of whose products over 15 % are not of their vendor's main category."""
    rows = catalog(spark, sf_dir).select("site", "vendor", "category")
    main = rows.groupBy("vendor", "category").agg(F.count("*").alias("n")).groupBy("vendor").agg(F.min(F.struct((-F.col("n")).alias("n"), "category")).alias("m")).select("vendor", F.col("m.category").alias("main"))
    off = F.count_if(F.col("category") != F.col("main"))
    return rows.join(main, "vendor").groupBy("site").agg(off.alias("mismatches"), rnd(off.cast("double") / F.count("*"), 4).alias("mismatch_rate"), (off.cast("double") / F.count("*")).alias("r")).where("r > 0.15").drop("r")


@query(f"""WITH {CATALOG_SQL}, p AS (SELECT site, product, category, lower(category) || ' ' || name AS name FROM catalog), t AS (SELECT site, category, unnest(list_distinct(string_split(name, ' '))) AS term FROM p), n AS (SELECT site, category, count(*) AS n FROM p GROUP BY site, category HAVING count(*) >= 4)
SELECT t.site, t.category, term, count(*) AS df FROM t JOIN n ON n.site = t.site AND n.category = t.category GROUP BY t.site, t.category, term, n.n HAVING count(*) >= greatest(3, floor(0.34 * n.n))""")
def brand_tokens_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in at least a third of the names of a site's collection (and three of them), which tell nothing apart; collections of four names or more."""
    names = catalog(spark, sf_dir).select("site", "category", F.concat_ws(" ", F.lower("category"), "name").alias("name"))
    n = names.groupBy("site", "category").agg(F.count("*").alias("n")).where("n >= 4")
    df = names.select("site", "category", F.explode(F.array_distinct(F.split("name", " "))).alias("term")).groupBy("site", "category", "term").agg(F.count("*").alias("df"))
    return df.join(n, ["site", "category"]).where("df >= greatest(3, floor(0.34 * n))").select("site", "category", "term", "df")


@query(f"""WITH {CATALOG_SQL}, w AS (SELECT site, string_split(name, ' ') AS ws FROM catalog), t AS (SELECT site, unnest(ws) AS term FROM w UNION ALL SELECT site, ws[1] || ' ' || ws[2] FROM w WHERE len(ws) > 1)
SELECT site, term, count(*) AS n FROM t GROUP BY site, term HAVING count(*) >= 2""")
def repeated_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and word pairs of names that a site repeats."""
    words = F.split("name", " ")
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))).otherwise(F.array().cast("array<string>"))
    terms = catalog(spark, sf_dir).select("site", F.explode(F.concat(words, pairs)).alias("term"))
    return terms.groupBy("site", "term").agg(F.count("*").alias("n")).where("n >= 2")


@query(f"""WITH {CATALOG_SQL}, x AS (SELECT site, count(*) AS products, CAST(sum(CAST(price AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS price, CAST(count(*) FILTER (WHERE on_sale) AS DOUBLE) / count(*) AS sale, CAST(count(*) FILTER (WHERE in_stock) AS DOUBLE) / count(*) AS stock FROM catalog GROUP BY site), m AS (SELECT max(products) AS products, max(price) AS price, max(sale) AS sale, max(stock) AS stock FROM x)
SELECT site, least(100, greatest(0, (floor((100.0 * x.products / nullif(m.products, 0)) * 1 + 0.5) / 1))) AS breadth, least(100, greatest(0, (floor((100 * x.price / nullif(m.price, 0)) * 1 + 0.5) / 1))) AS price, least(100, greatest(0, (floor((100 * x.sale / nullif(m.sale, 0)) * 1 + 0.5) / 1))) AS promotion, least(100, greatest(0, (floor((100 * x.stock / nullif(m.stock, 0)) * 1 + 0.5) / 1))) AS stock FROM x, m""")
def radar_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from 0 to 100 relative to the best site."""
    n = F.count("*").cast("double")
    x = catalog(spark, sf_dir).groupBy("site").agg(F.count("*").alias("breadth"), (F.sum(F.col("price").cast("decimal(18,4)")).cast("double") / n).alias("price"), (F.count_if("on_sale") / n).alias("promotion"), (F.count_if("in_stock") / n).alias("stock"))
    names = ["breadth", "price", "promotion", "stock"]
    best = x.agg(*(F.max(c).alias(f"best_{c}") for c in names))  # one row
    score = lambda c: F.least(F.lit(100.0), F.greatest(F.lit(0.0), rnd(F.try_divide(F.lit(100.0) * F.col(c), F.col(f"best_{c}").cast("double")), 0)))
    return x.join(F.broadcast(best)).select("site", *(score(c).alias(c) for c in names))


@query(f"""WITH {CATALOG_SQL} SELECT site, {rate_sql('count(in_stock)', 'count(*)')} AS coverage FROM catalog GROUP BY site""")
def availability_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a site's products whose stock is known at all."""
    return catalog(spark, sf_dir).groupBy("site").agg(rate(F.count("in_stock"), F.count("*")).alias("coverage"))
