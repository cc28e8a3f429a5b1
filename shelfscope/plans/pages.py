"""Facts out of pages and documents by regular expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.catalog import rate, rate_sql, table


@query(r"""SELECT page_id, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS h1, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang FROM pages""")
def html_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, first heading and language."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?s)<title[^>]*>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1).alias("h1"), F.regexp_extract("html", '<html[^>]*lang="([^"]*)"', 1).alias("lang"))


@query(r"""WITH n AS (SELECT page_id, regexp_extract(html, '(?s)<nav[^>]*>(.*?)</nav>', 1) AS nav FROM pages), l AS (SELECT page_id, unnest(regexp_extract_all(nav, '<a [^>]*>[^<]*</a>')) AS a FROM n)
SELECT DISTINCT page_id, regexp_extract(a, 'href="([^"]*)"', 1) AS href, regexp_extract(a, '>([^<]*)<', 1) AS label FROM l""")
def html_nav_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the navigation, each once."""
    nav = F.regexp_extract("html", "(?s)<nav[^>]*>(.*?)</nav>", 1)
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all(nav, F.lit("<a [^>]*>[^<]*</a>"), F.lit(0))).alias("a"))
    return links.select("page_id", F.regexp_extract("a", 'href="([^"]*)"', 1).alias("href"), F.regexp_extract("a", ">([^<]*)<", 1).alias("label")).distinct()


_VISIBLE = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


def visible_text(html: str = "html") -> F.Column:
    """What is left without scripts, styles and tags."""
    bare = F.regexp_replace(F.regexp_replace(F.col(html), "(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


@query(f"SELECT page_id, length({_VISIBLE}) AS visible, {rate_sql(f'length({_VISIBLE})', 'length(html)')} AS share FROM pages")
def visible_text_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the visible text and its share of the page."""
    return table(spark, sf_dir, "pages").select("page_id", F.length(visible_text()).alias("visible"), rate(F.length(visible_text()), F.length("html")).alias("share"))


@query(f"""SELECT page_id, CASE WHEN html IS NULL OR html = '' THEN 'empty' WHEN regexp_matches(lower(html), 'captcha|access denied|verify you are human') THEN 'challenge' WHEN length({_VISIBLE}) < 400 THEN 'thin' ELSE 'ok' END AS block FROM pages""")
def page_block_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a page is no page, by the first rule that holds."""
    page = F.lower("html")
    rule = F.when(F.col("html").isNull() | (F.col("html") == ""), "empty").when(page.rlike("captcha|access denied|verify you are human"), "challenge").when(F.length(visible_text()) < 400, "thin").otherwise("ok")
    return table(spark, sf_dir, "pages").select("page_id", rule.alias("block"))


@query(r"""WITH t AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS site, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS title FROM pages), d AS (SELECT *, count(*) OVER (PARTITION BY site, lower(title)) AS same FROM t)
SELECT site, count(*) AS pages, CAST(sum(length(title)) AS BIGINT) AS title_chars, count(*) FILTER (WHERE length(title) < 30) AS short_titles, count(*) FILTER (WHERE length(title) > 60) AS long_titles, count(*) FILTER (WHERE same > 1) AS duplicate_titles FROM d GROUP BY site""")
def seo_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of a site: too short, too long, the same as another's.

    Titles are counted before they meet, so a title that a site repeats on all pages is one row.
    """
    title = F.regexp_extract("html", "(?s)<title[^>]*>(.*?)</title>", 1)
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("site"), title.alias("title"))
    same = rows.groupBy("site", F.lower("title").alias("key")).agg(F.count("*").alias("n"), F.sum(F.length("title").cast("long")).alias("chars"), F.count_if(F.length("title") < 30).alias("short"), F.count_if(F.length("title") > 60).alias("long"))
    return same.groupBy("site").agg(F.sum("n").alias("pages"), F.sum("chars").alias("title_chars"), F.sum("short").alias("short_titles"), F.sum("long").alias("long_titles"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicate_titles"))


@query(r"""WITH t AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS site, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS title FROM pages) SELECT site, lower(title) AS title, count(*) AS pages FROM t GROUP BY ALL HAVING count(*) > 1""")
def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that a site uses more than once."""
    title = F.regexp_extract("html", "(?s)<title[^>]*>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("site"), F.lower(title).alias("title")).agg(F.count("*").alias("pages")).where("pages > 1")


@query(r"""SELECT regexp_extract(url, '://([^/?#]*)', 1) AS site, string_agg(k || '=' || n, ',' ORDER BY k) AS histogram FROM (SELECT url, k, count(*) OVER (PARTITION BY regexp_extract(url, '://([^/?#]*)', 1), k) AS n, row_number() OVER (PARTITION BY regexp_extract(url, '://([^/?#]*)', 1), k) AS i FROM (SELECT url, CASE WHEN contains(url, '?') THEN 'query' WHEN contains(url, '#') THEN 'fragment' ELSE 'plain' END AS k FROM pages)) WHERE i = 1 GROUP BY 1""")
def page_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of pages of each site as one text."""
    kind = F.when(F.contains("url", F.lit("?")), "query").when(F.contains("url", F.lit("#")), "fragment").otherwise("plain")
    n = table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("site"), kind.alias("k")).agg(F.count("*").alias("n"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda x: F.concat(x["k"], F.lit("="), x["n"].cast("string")))
    return n.groupBy("site").agg(F.array_join(items, ",").alias("histogram"))


_FLAGS = {"license": "licens(e|ed)", "free": r"\bfree\b", "money": r"\$", "contact": "@", "percent": "%", "list_marks": r"\|"}


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(lower(text), '{p}') AS {k}" for k, p in _FLAGS.items()) + " FROM documents")
def policy_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags over whole texts."""
    text = F.lower("text")
    return table(spark, sf_dir, "documents").select("doc_id", *(text.rlike(p).alias(k) for k, p in _FLAGS.items()))


@query(r"""WITH n AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS site, page_id, regexp_extract(html, '(?s)<nav[^>]*>(.*?)</nav>', 1) AS nav FROM pages), f AS (SELECT site, arg_min(nav, page_id) AS nav FROM n WHERE contains(nav, '<a ') GROUP BY site)
SELECT site, len(regexp_extract_all(nav, '<a ')) AS links FROM f""")
def navigation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the first page of a site that has any."""
    nav = F.regexp_extract("html", "(?s)<nav[^>]*>(.*?)</nav>", 1)
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("site"), "page_id", nav.alias("nav")).where(F.contains("nav", F.lit("<a ")))
    return rows.groupBy("site").agg(F.min_by(F.regexp_count("nav", F.lit("<a ")), "page_id").cast("long").alias("links"))


@query(r"""WITH w AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS site, unnest(regexp_extract_all(lower(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)), '[a-z]{3,}')) AS word FROM pages), c AS (SELECT site, word, count(*) AS n FROM w WHERE word NOT IN ('and', 'for', 'the', 'with', 'that') GROUP BY ALL)
SELECT site, word, n FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, word) AS k FROM c) WHERE k <= 8""")
def listing_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most frequent words of a site's titles."""
    title = F.lower(F.regexp_extract("html", "(?s)<title[^>]*>(.*?)</title>", 1))
    words = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("site"), F.explode(F.regexp_extract_all(title, F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    n = words.where(~F.col("word").isin("and", "for", "the", "with", "that")).groupBy("site", "word").agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("n"), "word"))).where("k <= 8").drop("k")


#: What a navigation link is for: the first of these with a word in its label or address.  The pages at hand label links with plain words, so the vocabulary has some too.
NAV_INTENTS = {"sale": ["sale", "deal", "was"], "blog": ["blog", "news", "the"], "contact": ["contact", "about", "los"], "support": ["help", "faq", "in"], "home": ["home", "de"]}
_NAV_CASE = " ".join(f"WHEN {' OR '.join(f"contains(blob, '{w}')" for w in ws)} THEN '{k}'" for k, ws in NAV_INTENTS.items())


@query(rf"""WITH n AS (SELECT page_id, regexp_extract(html, '(?s)<nav[^>]*>(.*?)</nav>', 1) AS nav FROM pages), l AS (SELECT page_id, unnest(regexp_extract_all(nav, '<a [^>]*>[^<]*</a>')) AS a FROM n),
d AS (SELECT DISTINCT page_id, regexp_extract(a, 'href="([^"]*)"', 1) AS href, regexp_extract(a, '>([^<]*)<', 1) AS label FROM l), b AS (SELECT *, lower(label || ' ' || href) AS blob FROM d)
SELECT page_id, href, label, CASE {_NAV_CASE} ELSE 'general' END AS intent FROM b""")
def nav_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation links and the first intent that has a word in them."""
    rows = html_nav_links(spark, sf_dir).withColumn("blob", F.lower(F.concat_ws(" ", "label", "href")))
    return rows.select("page_id", "href", "label", F.expr(f"CASE {_NAV_CASE} ELSE 'general' END").alias("intent"))
