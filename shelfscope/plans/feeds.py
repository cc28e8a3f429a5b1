"""Feeds and files: documents made of the parts, written, read back, brought into one form and changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources import feeds
from ..sources.catalog import table
from ..sources.files import Table, append_lines, export_csv, read_documents, read_urls, shared_folder

#: A document by part (eight kinds; every twentieth is cut off), in SQL.
_K = "cast(p_partkey AS string)"
_PRODUCT = f"""CASE p_partkey % 8
WHEN 0 THEN '"name": " ' || p_name || ' ", "handle": "h' || {_K} || '", "productUrl": "https://s.example/p/' || {_K} || '/#x", "price": {{"currency": "EUR", "current": ' || cast(p_retailprice AS string) || '}}, "availability": "In stock", "description": {{"html": "<p>About ' || p_name || '</p>"}}, "category": "summer-sale", "tags": ["a", "b"], "variants": [{{"id": "1", "title": "S", "price": "9,5", "available": true}}, {{"id": "2"}}], "related": [' || repeat('{{"name": "r", "url": "/r/"}},', 11) || '{{"name": "last"}}]'
WHEN 1 THEN '"title": "' || p_name || '", "url": "https://s.example/p/' || {_K} || '", "price": {{"priceTextRaw": "Rs. 1,499", "compareAt": "2,000"}}, "category": "' || repeat('long words ', 9) || '"'
WHEN 2 THEN '"name": "' || p_name || '", "currentPrice": "' || cast(p_size AS string) || '.5", "comparePrice": "1", "currency": "USD", "stock": {{"label": "Sold out", "inStock": false}}'
WHEN 3 THEN '"name": "' || p_name || '", "productUrl": "https://s.example/c/all/", "price": {{"current": 88}}, "allPrices": ["$88", "$110", "x"]'
WHEN 4 THEN '"name": "' || p_name || ' (opens in a new window)", "price": {{"amount": "0"}}, "availability": "Sold out", "shortDescription": "' || repeat('word ', 500) || '"'
WHEN 5 THEN '"name": "' || p_name || '", "availability": "unavailable", "price": {{"text": "from 3 GBP"}}'
WHEN 6 THEN '"name": "Shop now", "url": "https://s.example/c/x"'
ELSE '"handle": "only"' END""".replace("{{", "{").replace("}}", "}")
_LINE = f"CASE WHEN p_partkey % 20 = 13 THEN '{{\"page\": {{\"url\"' ELSE '{{\"page\": {{\"url\": \"https://s.example/' || CASE p_partkey % 8 WHEN 3 THEN 'c/all' ELSE 'p/' || {_K} END || '\", \"pageType\": \"' || CASE p_partkey % 8 WHEN 3 THEN 'collection' ELSE 'product' END || '\"}}, \"product\": {{' || {_PRODUCT} || '}}}}' END"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line of JSON by part."""
    return table(spark, sf_dir, "part").select(F.expr(_LINE).alias("value"))


def _written(spark: SparkSession, sf_dir: str) -> str:
    path = shared_folder(spark, "feed")
    documents(spark, sf_dir).write.text(path)
    return path


@query("""SELECT CASE WHEN p_partkey % 20 = 13 THEN NULL ELSE CASE WHEN p_partkey % 8 = 3 THEN 'collection' ELSE 'product' END END AS page_type, count(*) AS documents, count(*) FILTER (WHERE p_partkey % 20 = 13) AS warnings FROM part GROUP BY 1""")
def feed_scan_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of JSON documents: those that are valid by kind of page, and a warning for each that is not."""
    rows, bad = read_documents(spark, _written(spark, sf_dir), feeds.SCHEMA)
    good = rows.groupBy(F.col("page.pageType").alias("page_type")).agg(F.count("*").alias("documents"), F.lit(0).cast("long").alias("warnings"))
    return good.unionByName(bad.groupBy(F.lit(None).cast("string").alias("page_type")).agg(F.count("*").alias("documents"), F.count("text").alias("warnings")))


@query("""WITH p AS (SELECT *, p_partkey % 8 AS k FROM part WHERE p_partkey % 20 <> 13)
SELECT p_name AS name, CASE WHEN k = 0 THEN 'h' || p_partkey END AS handle, CASE WHEN k IN (0, 1) THEN 'https://s.example/p/' || p_partkey END AS url,
       CASE k WHEN 0 THEN 'EUR' WHEN 1 THEN 'PKR' WHEN 2 THEN 'USD' WHEN 5 THEN 'GBP' END AS currency, CASE k WHEN 0 THEN floor(p_retailprice * 100 + 0.5) / 100 WHEN 1 THEN 1499.0 WHEN 2 THEN p_size + 0.5 WHEN 3 THEN 88.0 WHEN 4 THEN 0.0 WHEN 5 THEN 3.0 END AS current,
       CASE k WHEN 1 THEN 2000.0 WHEN 2 THEN 1.0 WHEN 3 THEN 110.0 END AS compare_at, k IN (1, 3) AS on_sale, CASE k WHEN 1 THEN 25.1 WHEN 3 THEN 20.0 END AS discount_percent,
       CASE k WHEN 0 THEN 'In stock' WHEN 2 THEN 'Sold out' WHEN 4 THEN 'Sold out' WHEN 5 THEN 'unavailable' END AS label, CASE k WHEN 0 THEN true WHEN 2 THEN false WHEN 4 THEN false WHEN 5 THEN true END AS in_stock,
       CASE k WHEN 0 THEN length('About ' || p_name) WHEN 4 THEN 2000 END AS description_length, CASE k WHEN 0 THEN 'Summer Sale' END AS category, CASE k WHEN 0 THEN 2 ELSE 0 END AS variants, CASE k WHEN 0 THEN 2 ELSE 0 END AS tags, CASE k WHEN 0 THEN 10 END AS related
FROM p WHERE k < 6""")
def canonical_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds in one form: names, urls, prices with sale and discount, stock, description, category, variants, related products."""
    rows, _ = read_documents(spark, _written(spark, sf_dir), feeds.SCHEMA)
    full = feeds.canonical_products(rows)
    cards = [F.coalesce(F.size(c), F.lit(0)).alias(c) for c in ("variants", "tags")]
    return full.select("name", "handle", "url", "price.currency", "price.current", "price.compare_at", "price.on_sale", "price.discount_percent", "stock.label", "stock.in_stock", F.length("description").alias("description_length"), "category", *cards, F.size("related").alias("related"))


@query("""WITH p AS (SELECT *, p_partkey % 8 AS k FROM part WHERE p_partkey % 20 <> 13)
SELECT p_name AS name, CASE k WHEN 0 THEN 2 ELSE 0 END AS variant_count, CAST(NULL AS BOOLEAN) AS in_stock, CASE k WHEN 0 THEN 'in_stock' WHEN 2 THEN 'out_of_stock' WHEN 4 THEN 'out_of_stock' WHEN 5 THEN 'out_of_stock' ELSE 'unknown' END AS status, count(*) AS n FROM p WHERE k < 6 GROUP BY ALL""")
def product_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short form for listings, and the analyzers' own reading of stock texts, which takes "unavailable" for what it says."""
    rows, _ = read_documents(spark, _written(spark, sf_dir), feeds.SCHEMA)
    full = feeds.canonical_products(rows)
    cards = feeds.card_products(full.withColumn("status", feeds.stock_status(F.col("stock.label"))).select("*")).select("name", "variant_count", "in_stock")
    status = full.select("name", F.coalesce(F.size("variants"), F.lit(0)).alias("variant_count"), feeds.stock_status(F.col("stock.label")).alias("status"))
    held = cards.groupBy("name", "variant_count", "in_stock").agg(F.count("*").alias("cards"))
    return status.groupBy("name", "variant_count", "status").agg(F.count("*").alias("n")).join(held, ["name", "variant_count"]).select("name", "variant_count", "in_stock", "status", "n")


@query("""SELECT 'https://s.example/p/' || p_brand AS url, max(CASE WHEN p_partkey % 4 = 1 THEN 'product' END) AS kind FROM part WHERE p_partkey % 5 <> 4 GROUP BY 1""")
def url_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls out of plain lines, JSON objects and JSON texts, comments and blank lines aside, each once."""
    part = table(spark, sf_dir, "part")
    url = F.concat(F.lit("https://s.example/p/"), "p_brand")
    line = F.when(F.col("p_partkey") % 5 == 4, F.when(F.col("p_partkey") % 2 == 0, F.lit("  ")).otherwise(F.concat(F.lit("# "), url)))
    line = line.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit('{"url": "'), url, F.lit('", "type": "product"}'))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit('"'), url, F.lit('"'))).otherwise(F.concat(F.lit("  "), url, F.lit(" ")))
    path = shared_folder(spark, "urls")
    part.select(line.alias("value")).write.text(path)
    return read_urls(spark.read.text(path))


@query("""SELECT user_id, count(*) AS lines, max(ts)::VARCHAR AS newest FROM events GROUP BY user_id""")
def history_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of JSON lines that every cycle appends to, read as a whole; events of even and odd hours are two cycles."""
    events = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), F.col("event_type").alias("status"))
    path = shared_folder(spark, "history")
    for turn in (0, 1):
        append_lines(events.where(F.substring("at", 12, 2).cast("int") % 2 == turn), path)
    rows = spark.read.schema("user_id long, at string, status string").json(path)
    newest = F.regexp_replace(F.regexp_replace(F.max("at"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return rows.groupBy("user_id").agg(F.count("*").alias("lines"), newest.alias("newest"))


@query("""SELECT o_custkey AS customer, date_trunc('month', o_orderdate)::DATE::VARCHAR AS period, count(*) AS orders, max(o_orderkey) AS newest FROM orders GROUP BY ALL""")
def upserted_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports keyed by customer and period: a stale version is there, the new one comes twice, and each key has one row."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.date_format(F.trunc(F.to_date("o_orderdate"), "month"), "yyyy-MM-dd").alias("period"), "o_orderkey")
    fresh = orders.groupBy("customer", "period").agg(F.count("*").alias("orders"), F.max("o_orderkey").alias("newest"))
    stale = fresh.where("customer % 3 = 0").withColumns({"orders": F.lit(0).cast("long"), "newest": F.lit(-1).cast("long")})
    reports = Table(spark, shared_folder(spark, "reports")).create(stale)
    for _ in range(2):
        reports.upsert(fresh, ["customer", "period"], "newest")
    return reports.read()


@query("""WITH c AS (SELECT c_custkey AS site, c_mktsegment AS workspace FROM customer), o AS (SELECT o_orderkey AS page, o_custkey AS site, CASE WHEN o_totalprice > 150000 THEN 'paused' ELSE o_orderstatus END AS status FROM orders WHERE o_custkey IN (SELECT site FROM c WHERE workspace <> 'BUILDING'))
SELECT status, count(*) AS pages, count(DISTINCT site) AS sites FROM o GROUP BY status""")
def cascade_and_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workspace goes with its sites and their pages; of the pages that stay the dear ones are paused."""
    sites = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site"), F.col("c_mktsegment").alias("workspace"))
    pages = Table(spark, shared_folder(spark, "pages")).create(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_custkey").alias("site"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")))
    pages.delete(sites.where("workspace = 'BUILDING'").select("site")).update(F.col("price") > 150000, status=F.lit("paused"))
    return pages.read().groupBy("status").agg(F.count("*").alias("pages"), F.count_distinct("site").alias("sites"))


@query("""SELECT p_partkey::VARCHAR AS part, 'say "' || p_name || '", ok' AS name, p_brand || '; ' || p_type AS labels, CASE WHEN p_size > 25 THEN 'Yes' ELSE 'No' END AS large FROM part""")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV with lists, booleans, quotes and commas, written and read back as texts."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.concat(F.lit('say "'), "p_name", F.lit('", ok')).alias("name"), F.array("p_brand", "p_type").alias("labels"), (F.col("p_size") > 25).alias("large"))
    path = shared_folder(spark, "csv")
    export_csv(rows, path)
    return spark.read.option("header", True).option("escape", '"').schema("part string, name string, labels string, large string").csv(path)


@query("""WITH s AS (SELECT p_partkey AS part, least(p_size, 12) AS last FROM part), g AS (SELECT part, unnest(generate_series(2, last)) AS page FROM s WHERE last >= 2)
SELECT part, page, CASE WHEN page % 3 = 0 THEN 'https://s.example/c?page=' || page || '&view=all' ELSE 'https://s.example/c?page=' || page END AS url FROM g""")
def pager_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages 2 up to the largest found, twelve at most: the links found where there are, and made where they lack."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.least(F.col("p_size"), F.lit(12)).alias("last")).where("last >= 2")
    pages = part.select("part", F.explode(F.sequence(F.lit(2), "last")).alias("page"))
    found = pages.where("page % 3 = 0").select("part", "page", F.concat(F.lit("https://s.example/c?page="), "page", F.lit("&view=all")).alias("link"))
    return pages.join(found, ["part", "page"], "left").select("part", F.col("page").cast("long").alias("page"), F.coalesce("link", F.concat(F.lit("https://s.example/c?page="), "page")).alias("url"))


@query("""WITH s AS (SELECT p_partkey AS part, p_partkey % 3 AS k, p_size FROM part) SELECT part, CASE k WHEN 0 THEN 'sitemap' WHEN 1 THEN 'robots' ELSE 'feed' END AS source, CASE k WHEN 0 THEN least(p_size + 15, 60) WHEN 1 THEN 5 ELSE 10 END AS n, CASE k WHEN 0 THEN 'https://s.example/' || 1 WHEN 1 THEN 'https://s.example/sitemap1.xml' ELSE 'https://s.example/f1' END AS first FROM s""")
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls of a sitemap (60 at most), else the sitemaps that robots.txt names (5), else the links of a feed (10)."""
    k, n = F.col("p_partkey") % 3, F.col("p_size") + 15
    lines = lambda form: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.format_string(form, i)), "\n")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.when(k == 0, lines("<url><loc> https://s.example/%d </loc></url>")).when(k == 1, lines("Sitemap: https://s.example/sitemap%d.xml")).otherwise(lines("<item><title>t</title><link>https://s.example/f%d</link></item>")).alias("x"))
    every = lambda p: F.regexp_extract_all("x", F.lit(p), F.lit(1))
    locs, maps, items = every(r"<loc>\s*(\S+?)\s*</loc>"), every(r"(?im)^sitemap:\s*(\S+)"), every(r"<link>\s*(\S+?)\s*</link>")
    chosen = F.when(F.size(locs) > 0, F.struct(F.lit("sitemap").alias("source"), F.slice(locs, 1, 60).alias("urls"))).when(F.size(maps) > 0, F.struct(F.lit("robots").alias("source"), F.slice(maps, 1, 5).alias("urls"))).otherwise(F.struct(F.lit("feed").alias("source"), F.slice(items, 1, 10).alias("urls")))
    return rows.select("part", chosen.alias("c")).select("part", "c.source", F.size("c.urls").alias("n"), F.get("c.urls", F.lit(0)).alias("first"))


@query("""WITH h AS (SELECT DISTINCT p_brand, p_name FROM part) SELECT p_brand AS site, p_name AS handle FROM h QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_name) <= 10""")
def sampled_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten different handles of a site, the sample that depth is read from."""
    from pyspark.sql import Window

    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("site"), F.col("p_name").alias("handle")).distinct()
    return names.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("handle"))).where("n <= 10").drop("n")
