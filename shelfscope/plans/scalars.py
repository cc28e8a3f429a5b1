"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean_text, html_to_text, parse_number, price_closeness, stem, title_case, tokens, truncate, url_domain, url_key, url_with_query
from ..registry import query
from ..sources.catalog import CATALOG_SQL, catalog, rnd, table

STOP = ["and", "for", "from", "in", "of", "on", "the", "to", "with"]
_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
_CLEAN = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))"
_STEM = """CASE WHEN length(w) <= 3 THEN w WHEN w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%sses' OR w LIKE '%shes' OR w LIKE '%ches' OR w LIKE '%xes' THEN left(w, length(w) - 2)
WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND w NOT LIKE '%us' THEN left(w, length(w) - 1) ELSE w END"""


@query(f"""SELECT page_id, {_CLEAN.format("regexp_replace(html, '<[^>]+>', ' ', 'g')")} AS text, length({_CLEAN.format("regexp_replace(html, '<[^>]+>', ' ', 'g')")}) AS n FROM pages""")
def html_to_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags to blanks, white space collapsed."""
    return table(spark, sf_dir, "pages").select("page_id", html_to_text(F.col("html")).alias("text")).withColumn("n", F.length("text"))


@query(f"""WITH c AS (SELECT doc_id, {_CLEAN.format('text')} AS t FROM documents) SELECT doc_id, length(t) AS n, CASE WHEN length(t) > 160 THEN rtrim(left(t, 159)) || '…' ELSE t END AS preview FROM c""")
def clean_and_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapsed texts and previews with an ellipsis."""
    rows = table(spark, sf_dir, "documents").select("doc_id", clean_text(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").alias("n"), truncate(F.col("t"), 160).alias("preview"))


@query(f"""WITH w AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS w FROM documents) SELECT w, {_STEM} AS stem FROM w WHERE regexp_full_match(w, '[a-z]+')""")
def stem_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct plain words and their stems."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("w")).distinct()
    return words.where(F.col("w").rlike("^[a-z]+$")).select("w", stem(F.col("w")).alias("stem"))


@query(f"""SELECT item_id, array_to_string(list_transform(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1 AND NOT list_contains({_STOP_SQL}, w)), lambda w: {_STEM}), ' ') AS tokens FROM benchmark""")
def tokenize_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stemmed words without stop words."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(tokens(F.col("text"), STOP), " ").alias("tokens"))


@query(r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', '') AS domain FROM pages""")
def domain_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts without www."""
    return table(spark, sf_dir, "pages").select("page_id", url_domain(F.col("url")).alias("domain"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '[?#].*$', ''), '^www\.', ''), '/+$', '') AS key, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS merged, regexp_replace(split_part(url, '?', 1), '/+$', '') AS analyzed FROM pages""")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three forms of a url that different stages compare by."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", url_key(url).alias("key"), url_with_query(url).alias("merged"), F.regexp_replace(F.split_part(url, F.lit("?"), F.lit(1)), "/+$", "").alias("analyzed"))


@query(r"""WITH p AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages),
e AS (SELECT host, parts, unnest(generate_series(1, len(parts))) AS depth FROM p)
SELECT host, '/' || array_to_string(parts[1:depth], '/') AS path, CASE WHEN depth > 1 THEN '/' || array_to_string(parts[1:depth - 1], '/') ELSE '/' END AS parent, depth, count(*) AS pages FROM e GROUP BY ALL""")
def url_tree_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of every path as a node with its parent and number of pages."""
    parts = F.filter(F.split(F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), parts.alias("parts")).where("size(parts) > 0")
    nodes = rows.select("host", "parts", F.explode(F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))).alias("depth"))
    at = lambda n: F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), n.cast("int")), "/"))
    return nodes.select("host", at(F.col("depth")).alias("path"), F.when(F.col("depth") > 1, at(F.col("depth") - 1)).otherwise("/").alias("parent"), "depth").groupBy("host", "path", "parent", "depth").agg(F.count("*").alias("pages"))


@query(r"""SELECT page_id, CASE WHEN contains(html, '€') THEN 'EUR' WHEN contains(html, '£') THEN 'GBP' WHEN regexp_matches(html, '\bRs\.?\s?[0-9]') THEN 'PKR' WHEN contains(html, '$') AND regexp_matches(url, '\.net(/|$)') THEN 'AUD' WHEN contains(html, '$') THEN 'USD' END AS currency FROM pages""")
def currency_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first currency whose sign a page shows; a dollar is told apart by the domain."""
    html = F.col("html")
    dollar = F.contains(html, F.lit("$"))
    first = F.when(F.contains(html, F.lit("€")), "EUR").when(F.contains(html, F.lit("£")), "GBP").when(html.rlike(r"\bRs\.?\s?[0-9]"), "PKR").when(dollar & F.col("url").rlike(r"\.net(/|$)"), "AUD").when(dollar, "USD")
    return table(spark, sf_dir, "pages").select("page_id", first.alias("currency"))


@query(r"""SELECT o_orderkey AS order_key, TRY_CAST(replace(regexp_extract('from ' || CASE WHEN o_totalprice >= 1000 THEN CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) || ',' ELSE '' END || lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS VARCHAR), 3, '0') || ' USD', '([0-9][0-9,]*(?:\.[0-9]+)?)', 1), ',', '') AS DOUBLE) AS amount FROM orders""")
def price_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts out of price texts with thousands commas."""
    whole = F.floor("o_totalprice")
    text = F.concat(F.lit("from "), F.when(F.col("o_totalprice") >= 1000, F.concat(F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit(","))).otherwise(""), F.lpad((whole % 1000).cast("string"), 3, "0"), F.lit(" USD"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), parse_number(text).alias("amount"))


@query(f"""WITH {CATALOG_SQL}, o AS (SELECT product, price AS own FROM catalog WHERE site = 0) SELECT site, product, CASE WHEN own > 0 AND price > 0 THEN floor(greatest(0.0, 1.0 - abs(ln(own / price)) / ln(3.0)) * 10000 + 0.5) / 10000 ELSE 0.0 END AS closeness FROM catalog JOIN o USING (product) WHERE site <> 0""")
def price_closeness_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How close competitors' prices are to the owner's."""
    rows = catalog(spark, sf_dir).select("site", "product", "price")
    own = rows.where("site = 0").select("product", F.col("price").alias("own"))
    return rows.where("site <> 0").join(own, "product").select("site", "product", rnd(price_closeness(F.col("own"), F.col("price")), 4).alias("closeness"))


@query(f"""WITH {CATALOG_SQL}, o AS (SELECT product, price AS own FROM catalog WHERE site = 0), g AS (SELECT site, product, own, floor((own - price) * 100 + 0.5) / 100 AS gap FROM catalog JOIN o USING (product) WHERE site <> 0)
SELECT site, product, gap, floor(gap / nullif(own, 0) * 100 * 100 + 0.5) / 100 AS percent, CASE WHEN gap > 0 THEN 'higher' WHEN gap < 0 THEN 'lower' ELSE 'same' END AS direction FROM g""")
def price_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap to each competitor; the percentage is of the rounded gap."""
    rows = catalog(spark, sf_dir).select("site", "product", "price")
    own = rows.where("site = 0").select("product", F.col("price").alias("own"))
    gaps = rows.where("site <> 0").join(own, "product").withColumn("gap", rnd(F.col("own") - F.col("price"), 2))
    return gaps.select("site", "product", "gap", rnd(F.try_divide(F.col("gap"), F.col("own")) * 100, 2).alias("percent"), F.when(F.col("gap") > 0, "higher").when(F.col("gap") < 0, "lower").otherwise("same").alias("direction"))


@query("""SELECT o_orderkey AS order_key, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN o_orderdate + INTERVAL 1 DAY WHEN '2-HIGH' THEN o_orderdate + INTERVAL 3 DAY WHEN '3-MEDIUM' THEN o_orderdate + INTERVAL 7 DAY ELSE o_orderdate + INTERVAL 1 MONTH END AS DATE)::VARCHAR AS next_scan FROM orders""")
def cadence_next_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of the next scan by cadence (the priority)."""
    p, d = F.col("o_orderpriority"), F.to_date("o_orderdate")
    at = F.when(p == "1-URGENT", F.date_add(d, 1)).when(p == "2-HIGH", F.date_add(d, 3)).when(p == "3-MEDIUM", F.date_add(d, 7)).otherwise(F.add_months(d, 1))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), at.cast("string").alias("next_scan"))


@query("""SELECT o_orderkey AS order_key, CASE WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN d || ' days ago' WHEN d < 30 THEN (d // 7) || ' weeks ago' ELSE (d // 30) || ' months ago' END AS label FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS d FROM orders)""")
def relative_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as people say them."""
    d = F.datediff(F.lit("2002-01-01").cast("date"), F.to_date("o_orderdate"))
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} ago"))
    label = F.when(d == 0, "today").when(d == 1, "yesterday").when(d < 7, say(d, "days")).when(d < 30, say(F.floor(d / 7), "weeks")).otherwise(say(F.floor(d / 30), "months"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), label.alias("label"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_valid(props) AS valid, json_extract_string(props, '$.missing') AS missing FROM events")
def json_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at JSON paths, null where there is none."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"), F.get_json_object("props", "$.missing").alias("missing"))


@query("""SELECT p_partkey AS part, array_to_string(list_transform(string_split(replace(p_name, ' ', '-'), '-'), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS title FROM part""")
def title_from_handle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs to titles."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), title_case(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("title"))


@query("""SELECT conv_id, turn, role, floor(length(text) / 4.0 / 1000 * 0.002 * 100000000 + 0.5) / 100000000 AS cost FROM conversations""")
def ai_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of a turn at four characters a token."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", rnd(F.length("text") / 4.0 / 1000 * 0.002, 8).alias("cost"))


#: Units as they are written and as they are counted.
UNITS = {"litre": "l", "liter": "l", "inches": "inch", "watt": "w", "watts": "w", "volt": "v", "pc": "pcs", "piece": "pcs", "pieces": "pcs", "pair": "pairs"}
_UNIT_PATTERN = r"([0-9]+(?:\.[0-9]+)?) ?(litre|liter|inches|inch|watts|watt|volt|pieces|piece|pairs|pair|pcs|pc|ml|l|w|v)( |$)"
_UNIT_CASE = "CASE u " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in UNITS.items()) + " ELSE u END"
_SIZE_TEXT = "lower(p_name || ' ' || p_size || CASE p_type WHEN 'PROMO' THEN ' litre' WHEN 'ECONOMY' THEN 'ml' WHEN 'LARGE' THEN ' inches' WHEN 'SMALL' THEN ' pieces' ELSE ' watts' END || ' 2 pc')"


@query(f"""WITH t AS (SELECT p_partkey AS part, {_SIZE_TEXT} AS t FROM part), m AS (SELECT part, unnest(regexp_extract_all(t, '{_UNIT_PATTERN}', 1)) AS q, unnest(regexp_extract_all(t, '{_UNIT_PATTERN}', 2)) AS u FROM t)
SELECT part, string_agg(DISTINCT q || {_UNIT_CASE}, ',' ORDER BY q || {_UNIT_CASE}) AS attributes FROM m GROUP BY part""")
def attribute_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities with their unit, each unit under one name."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.expr(_SIZE_TEXT).alias("t"))
    pieces = F.arrays_zip(F.regexp_extract_all("t", F.lit(_UNIT_PATTERN), F.lit(1)).alias("q"), F.regexp_extract_all("t", F.lit(_UNIT_PATTERN), F.lit(2)).alias("u"))
    named = parts.select("part", F.explode(pieces).alias("m")).select("part", F.col("m.q").alias("q"), F.col("m.u").alias("u"))
    named = named.select("part", F.concat("q", F.expr(_UNIT_CASE)).alias("x"))
    return named.groupBy("part").agg(F.array_join(F.array_sort(F.collect_set("x")), ",").alias("attributes"))
