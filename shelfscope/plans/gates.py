"""Gates: pages that a fetch must repeat, pairs of pages that are offline, real categories, and the roots of a url tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.page_type import alternation
from ..registry import query
from ..sources.catalog import table
from .matching import _site_pages, matched_pages
from .page_types import KEYS, PAGES_SQL, typed_pages

# Fixed values (F14): statuses and words of challenge pages, signs of a page's body, and those of pages made by scripts.
STATUSES = [401, 403, 418, 429, 451, 503]
CHALLENGES = ["access denied", "forbidden", "verify you are human", "checking your browser", "just a moment", "captcha", "cf-chl", "cloudflare", "akamai", "perimeterx", "datadome", "bot protection", "request blocked"]
BODY_SIGNS = ["<body", "__next_data__", "__nuxt__", "root", "app", "react", "hydration"]
SCRIPTED = ["__next_data__", "__nuxt__", "window.__", 'id="root"', 'id="app"', "data-reactroot"]
# Fixed values (F8): names that are no categories.
NO_CATEGORY = (
    r"(?i)do not delete|\btest\b|hidden|draft|\bwip\b|internal|staging|^all products|all products|excluding outlet|full[- ]?priced|^all$|shop all|everything|^featured|^new(\b| in| arrivals)|best ?sellers?|^products$|catalog|collabs?-?allproducts|% ?off|\d+ ?extra off|off and above|best of sale|\bsale\b|"
    r"clearance|outlet|\bdeals?\b|bundle|wishlist|build your|gift ?card|^gifts? for|gifts? under|\$\d|back to school|airport|christmas|black friday|cyber|valentine|summer sale|winter sale|^shop by|^best of|essentials? collection"
)


def _bare(html: Column, tags: str) -> Column:
    """Visible text without the tags' content."""
    for tag in tags.split():
        html = F.regexp_replace(html, rf"(?s)<{tag}\b.*?</{tag}>", " ")
    return html


def blocked_or_empty(html: Column, status: Column | None = None) -> Column:
    """A blocked status, no html, a short page without signs of a body, two challenge words in a page of little text, or no body."""
    low = F.lower(F.coalesce(html, F.lit("")))
    shown = _bare(low, "script style")
    text = F.trim(F.regexp_replace(F.regexp_replace(shown, "<[^>]+>", " "), r"\s+", " "))
    hits = sum((F.contains(shown, F.lit(w)).cast("int") for w in CHALLENGES), F.lit(0))
    found = (low == "") | ((F.length(F.trim(low)) < 1500) & ~F.regexp_like(low, F.lit(alternation(BODY_SIGNS)))) | ((hits >= 2) & (F.length(text) < 3000)) | ~F.contains(low, F.lit("<body"))
    return found if status is None else F.coalesce(status.isin(STATUSES), F.lit(False)) | found


def needs_browser(url: Column, html: Column) -> Column:
    """A homepage, a pricing page, a small page made by scripts, or a large one with hardly any text."""
    address, low = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(html, F.lit("")))
    path = F.regexp_replace(F.regexp_extract(address, "^[a-z]+://[^/?#]*([^?#]*)", 1), "^/+|/+$", "")
    shell = F.length(F.regexp_replace(low, "<script|</script>|<style|</style>", " ")) < 8000
    text = F.trim(F.regexp_replace(F.regexp_replace(_bare(low, "script style noscript"), "<[^>]+>", " "), r"\s+", " "))
    return path.isin("", "home", "index", "index.html") | F.regexp_like(address, F.lit("pricing|plans")) | (F.regexp_like(low, F.lit(alternation(SCRIPTED))) & shell) | ((F.length(low) > 10000) & (F.length(text) < 1800))


def _stripped(column: str, tags: str) -> str:
    for tag in tags.split():
        column = f"regexp_replace({column}, '(?s)<{tag}\\b.*?</{tag}>', ' ', 'g')"
    return column


_TEXT = "length(trim(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')))"


@query(f"""WITH {PAGES_SQL}, low AS (SELECT origin, id, lower(url) AS u, lower(html) AS low FROM typed_pages), s AS (SELECT *, {_stripped('low', 'script style')} AS shown, {_stripped('low', 'script style noscript')} AS bare, regexp_replace(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g') AS path FROM low)
SELECT origin, id, low = '' OR (length(trim(low)) < 1500 AND NOT regexp_matches(low, '{alternation(BODY_SIGNS)}')) OR ({' + '.join(f"contains(shown, '{w}')::INT" for w in CHALLENGES)} >= 2 AND {_TEXT.format('shown')} < 3000) OR NOT contains(low, '<body') AS blocked,
       path IN ('', 'home', 'index', 'index.html') OR regexp_matches(u, 'pricing|plans') OR (regexp_matches(low, '{alternation(SCRIPTED)}') AND length(regexp_replace(low, '<script|</script>|<style|</style>', ' ', 'g')) < 8000) OR (length(low) > 10000 AND {_TEXT.format('bare')} < 1800) AS browser FROM s""")
def fetch_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that came back blocked or empty, and those that only a browser shows whole."""
    rows = typed_pages(spark, sf_dir)
    return rows.select(*KEYS, blocked_or_empty(F.col("html")).alias("blocked"), needs_browser(F.col("url"), F.col("html")).alias("browser"))


@query(f"""WITH c AS (SELECT DISTINCT p_brand AS site, CASE p_size % 5 WHEN 0 THEN 'New arrivals' WHEN 1 THEN p_type || ' sale' WHEN 2 THEN p_type ELSE p_name END AS name FROM part), n AS (SELECT site, name, length(trim(name)) BETWEEN 2 AND 45 AND NOT regexp_matches(trim(name), '{NO_CATEGORY}') AS real FROM c),
s AS (SELECT *, bool_or(real) OVER (PARTITION BY site) AS kept FROM n) SELECT site, name, kept AS filtered FROM s WHERE real OR NOT kept""")
def real_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site's categories without those that are none; all of them where none would be left."""
    size = F.col("p_size") % 5
    named = table(spark, sf_dir, "part").select(F.col("p_brand").alias("site"), F.when(size == 0, "New arrivals").when(size == 1, F.concat("p_type", F.lit(" sale"))).when(size == 2, F.col("p_type")).otherwise(F.col("p_name")).alias("name")).distinct()
    real = F.length(F.trim("name")).between(2, 45) & ~F.regexp_like(F.trim("name"), F.lit(NO_CATEGORY))
    some = named.withColumn("real", real).groupBy("site").agg(F.bool_or("real").alias("filtered"))
    return named.withColumn("real", real).join(some, "site").where("real or not filtered").select("site", "name", "filtered")


@query(r"""WITH p AS (SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1) AS host, list_filter(string_split(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages),
r AS (SELECT host, parts[1] AS root, max(len(parts)) AS depth, count(*) AS urls FROM p WHERE len(parts) > 0 GROUP BY ALL)
SELECT host, CASE WHEN depth = 1 OR root = 'pages' THEN 'pages' ELSE root END AS category, sum(urls)::BIGINT AS urls, count(*) AS roots FROM r GROUP BY ALL""")
def url_tree_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first level of each host's url tree: roots without anything below them are pages."""
    path = F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract(F.lower("url"), "^[a-z]+://([^/?#]*)", 1).alias("host"), parts.alias("parts")).where("size(parts) > 0")
    roots = rows.groupBy("host", F.col("parts")[0].alias("root")).agg(F.max(F.size("parts")).alias("depth"), F.count("*").alias("urls"))
    category = F.when((F.col("depth") == 1) | (F.col("root") == "pages"), "pages").otherwise(F.col("root"))
    return roots.groupBy("host", category.alias("category")).agg(F.sum("urls").alias("urls"), F.count("*").alias("roots"))


def online_pairs(pairs: DataFrame, offline: DataFrame) -> DataFrame:
    """Pairs (url, owner_url) of which neither side is among the offline urls; slashes at the end do not count."""
    key = lambda c: F.regexp_replace(F.trim(c), "/+$", "")
    gone = offline.select(key("url").alias("_gone")).where("_gone is not null").distinct()
    kept = pairs.withColumns({"_a": key("url"), "_b": key("owner_url")})
    return kept.join(gone, F.col("_a") == F.col("_gone"), "left_anti").join(gone, F.col("_b") == F.col("_gone"), "left_anti").drop("_a", "_b")


@query()
def online_page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched pages without those that, on either side, were the last of their host to be listed (taken as offline); tested on written pairs."""
    pages, owner = _site_pages(spark, sf_dir)
    last = pages.withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("url")))).where("n <= 3").select("url")
    return online_pairs(matched_pages(pages, owner), last)
