"""Identity, deduplication and survivorship of products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.elements import held
from ..operators.provenance import survivors, united
from ..registry import query
from ..sources.catalog import CATALOG_SQL, catalog, rnd, table

_FIELDS_SQL = "CASE WHEN product % 3 <> 1 THEN 'https://www.Site' || site || '.example/p/' || product || '/' END AS url, CASE WHEN product % 2 = 0 THEN replace(name, ' ', '-') END AS handle, CASE WHEN product % 5 <> 0 THEN CAST(product AS VARCHAR) END AS id"


@query(f"""WITH {CATALOG_SQL}, f AS (SELECT site, product, name, {_FIELDS_SQL} FROM catalog)
SELECT site, product, coalesce('url::' || regexp_replace(lower(url), '/+$', ''), 'handle::' || lower(handle), 'id::' || id, 'name::' || lower(name)) AS identity FROM f""")
def product_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product's key: its url, else its handle, id or name, each with a prefix."""
    rows = catalog(spark, sf_dir)
    url = F.when(F.col("product") % 3 != 1, F.concat(F.lit("https://www.Site"), F.col("site"), F.lit(".example/p/"), F.col("product"), F.lit("/")))
    handle = F.when(F.col("product") % 2 == 0, F.replace("name", F.lit(" "), F.lit("-")))
    number = F.when(F.col("product") % 5 != 0, F.col("product").cast("string"))
    tag = lambda prefix, value: F.concat(F.lit(f"{prefix}::"), value)
    return rows.select("site", "product", F.coalesce(tag("url", F.regexp_replace(F.lower(url), "/+$", "")), tag("handle", F.lower(handle)), tag("id", number), tag("name", F.lower("name"))).alias("identity"))


@query("""SELECT l_suppkey AS site, l_partkey AS product, l_orderkey AS first_order FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate, l_orderkey) AS n FROM lineitem) WHERE n = 1""")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first arrival of each key; min of a struct combines before the shuffle."""
    first = F.min(F.struct("l_shipdate", "l_orderkey"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("product")).agg(first.alias("x")).select("site", "product", F.col("x.l_orderkey").alias("first_order"))


def fold_survivors(arrivals: Column, fields: list[str]) -> Column:
    """Fold arrivals (ordered structs with priority and fields) into one record.

    A higher priority takes over and keeps the old values only where it has none; any other
    arrival fills what is missing.  The fold depends on the order; it is not an argmax by priority.
    """

    def step(old: Column, new: Column) -> Column:
        wins = new["priority"] > old["priority"]
        return F.struct(F.greatest(old["priority"], new["priority"]).alias("priority"), *(F.when(wins, F.coalesce(new[f], old[f])).otherwise(F.coalesce(old[f], new[f])).alias(f) for f in fields))

    return F.aggregate(F.slice(arrivals, 2, F.size(arrivals)), F.element_at(arrivals, 1), step)


@query("""WITH a AS (SELECT l_suppkey AS site, l_partkey AS product, list({'priority': CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END, 'price': CASE WHEN l_tax > 0.02 THEN l_extendedprice END, 'discount': CASE WHEN l_discount > 0.05 THEN l_discount END} ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_returnflag, l_tax, l_discount) AS xs FROM lineitem GROUP BY ALL),
f AS (SELECT site, product, list_reduce(xs, lambda o, n: {'priority': greatest(o.priority, n.priority), 'price': CASE WHEN n.priority > o.priority THEN coalesce(n.price, o.price) ELSE coalesce(o.price, n.price) END, 'discount': CASE WHEN n.priority > o.priority THEN coalesce(n.discount, o.discount) ELSE coalesce(o.discount, n.discount) END}) AS x FROM a)
SELECT site, product, x.priority AS priority, x.price AS price, x.discount AS discount FROM f""")
def product_survivorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products merged from their pages (line items) in order of arrival; minima by level and field, so no product's items are gathered."""
    line = table(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_tax", "l_discount"]
    rows = line.select(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("product"), *order, flag.alias("priority"), F.when(F.col("l_tax") > 0.02, F.col("l_extendedprice")).alias("price"), F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("discount"))
    return survivors(rows, ["site", "product"], order, "priority", [1, 2, 3], ["price", "discount"])


_SEEN_SQL = """seen AS (
    SELECT site, product, 0 AS source, NULL::DATE AS day, 0::BIGINT AS number, 0 AS line, NULL AS page, NULL::INT AS rank, price, 'catalog' AS origin FROM catalog WHERE on_sale
    UNION ALL SELECT l_suppkey, l_partkey, 1, CAST(l_shipdate AS DATE), l_orderkey, l_linenumber, '/page/' || (l_orderkey % 20), CASE WHEN l_tax > 0.02 THEN l_linenumber END, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100, 'page' FROM lineitem WHERE l_returnflag <> 'N')"""


@query(f"""WITH {CATALOG_SQL}, {_SEEN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY site, product ORDER BY source, day NULLS FIRST, number, line, price) AS n FROM seen),
p AS (SELECT site, product, page, arg_min(rank, n) AS rank_null, min(n) AS n FROM r WHERE page IS NOT NULL GROUP BY ALL), f AS (SELECT p.site, p.product, p.page, p.n, r.rank FROM p JOIN r ON r.site = p.site AND r.product = p.product AND r.n = p.n),
a AS (SELECT site, product, count(*) AS pages, arg_min(page, n) AS first_page, arg_min(rank, n) FILTER (rank IS NOT NULL) AS first_rank FROM f GROUP BY ALL)
SELECT r.site, r.product, origin, price, coalesce(pages, 0) AS pages, first_page, first_rank FROM r LEFT JOIN a USING (site, product) WHERE r.n = 1""")
def united_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of the catalog list and of all pages but homepages: the first record of each, and all pages that showed it."""
    listed = catalog(spark, sf_dir).where("on_sale").select("site", "product", F.lit(0).alias("source"), F.lit(None).cast("date").alias("day"), F.lit(0).cast("long").alias("number"), F.lit(0).alias("line"), F.lit(None).cast("string").alias("page"), F.lit(None).cast("int").alias("rank"), "price", F.lit("catalog").alias("origin"))
    line = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'")
    shown = line.select(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("product"), F.lit(1).alias("source"), F.to_date("l_shipdate").alias("day"), F.col("l_orderkey").alias("number"), F.col("l_linenumber").alias("line"), F.concat(F.lit("/page/"), (F.col("l_orderkey") % 20).cast("string")).alias("page"), F.when(F.col("l_tax") > 0.02, F.col("l_linenumber")).alias("rank"), rnd(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("price"), F.lit("page").alias("origin"))
    return united(listed.unionByName(shown), ["site", "product"], ["source", "day", "number", "line", "price"], "page", "rank", ["origin", "price"])


@query("SELECT DISTINCT l_suppkey AS site, l_partkey AS product, l_returnflag AS page_type, l_linenumber AS page FROM lineitem")
def source_page_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages a product was seen on."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("product"), F.col("l_returnflag").alias("page_type"), F.col("l_linenumber").alias("page")).distinct()


@query("SELECT l_suppkey AS site, l_partkey AS product FROM lineitem GROUP BY ALL HAVING NOT bool_and(l_returnflag = 'N')")
def provenance_homepage_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products but those that only the home page shows."""
    seen = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("product")).agg(F.bool_and(F.col("l_returnflag") == "N").alias("only_home"))
    return seen.where("not only_home").drop("only_home")


@query("""WITH w AS (SELECT doc_id, n, w FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS n FROM documents) WHERE w <> ''),
f AS (SELECT doc_id, lower(w) AS k, min(n) AS n, arg_min(w, n) AS w FROM w GROUP BY doc_id, lower(w)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS rk FROM f)
SELECT doc_id, string_agg(w, ' ' ORDER BY n) AS words FROM r WHERE rk <= 20 GROUP BY doc_id""")
def merge_unique_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words whatever their case, first spelling, in order, twenty at most.

    Done within the row: nothing is exploded or shuffled.
    """
    rows = held(table(spark, sf_dir, "documents").select("doc_id", "text"), ws=F.filter(F.split("text", " "), lambda w: w != ""))
    rows = held(rows, low=F.transform("ws", F.lower))
    rows = held(rows, ks=F.slice(F.array_distinct("low"), 1, 20)).where("size(ks) > 0")
    first = F.transform("ks", lambda k: F.element_at("ws", F.array_position(F.col("low"), k).cast("int")))
    return rows.select("doc_id", F.array_join(first, " ").alias("words"))


@query("""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
f AS (SELECT doc_id, line, min(n) AS n FROM l WHERE line <> '' GROUP BY doc_id, line), b AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM f)
SELECT doc_id, count(*) AS kept_lines, CAST(sum(length(line)) AS BIGINT) AS kept_chars FROM b WHERE used < 2000 GROUP BY doc_id""")
def dedupe_lines_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines of a document up to a running budget of characters; the line that crosses it stays."""
    lines = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("chars"))
    step = lambda a, x: F.when(a["used"] < 2000, F.struct((a["used"] + F.length(x) + 1).alias("used"), (a["n"] + 1).alias("n"), (a["chars"] + F.length(x)).alias("chars"))).otherwise(a)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.aggregate(lines, start, step).alias("x"))
    return docs.select("doc_id", F.col("x.n").alias("kept_lines"), F.col("x.chars").alias("kept_chars")).where("kept_lines > 0")


@query(f"""WITH {CATALOG_SQL}, p AS (SELECT site, product, price, row_number() OVER (PARTITION BY product ORDER BY (price IS NOT NULL)::INT * 4 + on_sale::INT * 2 + (in_stock IS NOT NULL)::INT DESC, site) AS n FROM catalog)
SELECT product, site, price FROM p WHERE n = 1""")
def price_richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all sites' prices of a product the one with the most facts; ties go to the earlier site."""
    score = F.col("price").isNotNull().cast("int") * 4 + F.col("on_sale").cast("int") * 2 + F.col("in_stock").isNotNull().cast("int")
    best = catalog(spark, sf_dir).groupBy("product").agg(F.max_by(F.struct("site", "price"), F.struct(score, -F.col("site"))).alias("x"))
    return best.select("product", "x.site", "x.price")
