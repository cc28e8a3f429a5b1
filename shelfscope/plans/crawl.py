"""The rules over what was crawled: pages' html and urls, and documents' texts; the oracle computes the same patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, money, topics, urls
from ..functions import rules as R
from ..registry import query
from ..sources.catalog import table
from .page_types import KEYS, PAGES_SQL, typed_pages


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _m(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_q(pattern)})"


_VISIBLE = r"length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')))"
_BLOCK_RULES = "WHEN length(html) < 200 THEN 'empty' WHEN visible < 80 THEN 'too_thin' " + " ".join(f"WHEN {_m('html', p)} THEN '{kind}'" for kind, _, p in R.BLOCKS) + f" WHEN {' + '.join(f'{_m("html", p)}::INT' for p in R.LOGIN)} >= 2 THEN 'login_wall' WHEN {_m('html', R.ERRORS)} THEN 'error_page'"


@query(f"""WITH {PAGES_SQL}, seen AS (SELECT *, {_VISIBLE} AS visible FROM typed_pages) SELECT origin, id, visible, CASE {_BLOCK_RULES} WHEN {_m('html', '(?i)content\\s+not\\s+accessible|\\[CAPTCHA\\]|\\[LOGIN REQUIRED\\]|\\[ACCESS DENIED\\]')} THEN 'bot_check' END AS kind FROM seen""")
def crawled_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stops an analysis of each page, and how much text it shows."""
    rows = typed_pages(spark, sf_dir)
    return rows.select(*KEYS, R.visible_length(F.col("html")).alias("visible"), R.page_block(F.col("html"))["kind"].alias("kind"))


_LOW = "lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1))"
_BLOCKED = " OR ".join(f"contains(lower(url), {_q(x)})" for x in R.BLOCKED_URL_PARTS)
_POINTS = {"collection": 120, "category": 120, "catalog": 110, "product": 90, "page": 60, "blog": -30, "article": -30, "post": -30, "image": -80, "video": -80, "news": -40}


@query(f"""WITH {PAGES_SQL}, p AS (SELECT origin, id, url, {_LOW} AS path, string_split(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '.') AS labels FROM typed_pages),
s AS (SELECT *, labels[-2] IN ('co', 'com', 'net', 'org', 'gov', 'edu', 'ac') AND len(labels) >= 3 AS suffixed FROM p)
SELECT origin, id, CASE WHEN {_BLOCKED} THEN 'blocked' WHEN path IN ('', '/') THEN 'homepage' WHEN {_m('path', R.PRODUCT_URL)} THEN 'products' WHEN {_m('path', R.COLLECTION_URL)} THEN 'collections' WHEN {_m('path', 'pricing|prices|plans|packages|rates|subscription')} THEN 'pricing'
       WHEN {_m('path', 'services?|solutions?|repair|installation|consulting|support|maintenance')} THEN 'services' WHEN {_m('path', 'about|contact|privacy|terms|shipping|returns|faq|help|blog|news|careers')} THEN 'otherPages' END AS route,
       CASE WHEN len(labels) < 2 THEN nullif(labels[1], '') WHEN suffixed THEN labels[-3] ELSE labels[-2] END AS name, ({' + '.join(f"CASE WHEN contains(lower(url), '{k}') THEN {n} ELSE 0 END" for k, n in _POINTS.items())})::INT AS points,
       {_m("path", "^/*(?:[a-z]{2}([-_][a-z]{2})?|[a-z]{2}([-_][a-z]{2})?/+[a-z]{2}([-_][a-z]{2})?|[a-z]{2}([-_][a-z]{2})?/+(home\\.html|home|index\\.html|index|homepage))?/*$")} AS home FROM s""")
def crawled_url_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a crawl sends each url, the registrable name of its site, its points in a sitemap, and whether it is a homepage."""
    url = F.col("url")
    return typed_pages(spark, sf_dir).select(*KEYS, R.url_route(url).alias("route"), R.registrable(url).alias("name"), R.sitemap_score(url).cast("int").alias("points"), urls.is_homepage(url).alias("home"))


def _policy_sql() -> str:
    some = f"length(t) >= {R.POLICY_LEAST}"
    out = [f"{some} AS evidence"]
    for name, kind, patterns in R.POLICY_FEATURES:
        found = "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(t, {_q(p)}, 1)), '')" for p in patterns) + ")" if kind in ("finds", "counts") else ""
        out.append({"says": f"{some} AND {_m('t', patterns[0])}", "finds": f"CASE WHEN {some} THEN {found} END", "counts": f"CASE WHEN {some} THEN ({found})::INT END", "denied": f"CASE WHEN {some} AND {_m('t', patterns[0])} THEN false WHEN {some} AND {_m('t', patterns[-1])} THEN true END"}[kind] + f" AS {name}")
    return ", ".join(out)


#: A shop's policy as its orders make it: the part's price, size and name stand in the sentences.
_POLICY = """'Orders of ' || p_name || ': ' || CASE p_size % 5 WHEN 0 THEN 'free  shipping on orders over $ ' || round(p_retailprice) || '. Cash on delivery or PayPal.' WHEN 1 THEN 'we deliver within ' || p_size || ' days; ' || p_size || '-day returns' WHEN 2 THEN 'delivered in ' || (p_size % 7) || ' to ' || (p_size % 7 + 3) || ' working days, visa or bank transfer' WHEN 3 THEN 'all sales final' ELSE p_brand END"""


@query(f"""WITH texts AS (SELECT 'document' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'part', p_partkey, {_POLICY} FROM part), low AS (SELECT origin, id, lower(left(coalesce(text, ''), {R.POLICY_LETTERS})) AS t FROM texts) SELECT origin, id, {_policy_sql()} FROM low""")
def crawled_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document, and a policy of each part's shop, says of shipping, payment and returns."""
    texts = table(spark, sf_dir, "documents").select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), "text").unionByName(table(spark, sf_dir, "part").select(F.lit("part").alias("origin"), F.col("p_partkey").alias("id"), F.expr(_POLICY).alias("text")))
    return texts.select("origin", "id", R.shipping_signals(F.col("text")).alias("s")).select("origin", "id", "s.*")


@query("""WITH u AS (SELECT page_id, lower(url) AS low, regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1) AS host FROM pages), t AS (SELECT doc_id, text, replace(text, ',', '') AS plain FROM documents)
SELECT 'page' AS origin, page_id AS id, {locale} AS currency, NULL::DOUBLE AS number FROM u
UNION ALL SELECT 'document', doc_id, NULL, nullif(try_cast(regexp_extract(plain, '[0-9]+(?:\\.[0-9]+)?') AS DOUBLE), 0.0) FROM t""".format(
    locale="coalesce(" + "CASE " + " ".join(f"WHEN contains(low, '/{k}/') THEN '{v}'" for k, v in money.LOCALE_CURRENCY.items()) + " END, "
    + "CASE regexp_extract(host, '\\.([^.]+\\.[^.]+)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in money.TLD_CURRENCY.items()) + " END, "
    + "CASE regexp_extract(host, '\\.([^.]+)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in money.TLD_CURRENCY.items()) + " END, "
    + "CASE WHEN len(string_split(host, '.')) >= 3 AND length(string_split(host, '.')[1]) = 2 THEN CASE string_split(host, '.')[1] " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in money.TLD_CURRENCY.items()) + " END END)"
))
def crawled_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The currency that each url tells, and the first number of each document."""
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), money.url_currency(F.col("url")).alias("currency"), F.lit(None).cast("double").alias("number"))
    return pages.unionByName(table(spark, sf_dir, "documents").select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("currency"), money.price_number(F.col("text")).alias("number")))


_HAS = lambda column, words: "(" + " OR ".join(f"contains({column}, {_q(w)})" for w in words) + ")"
_CLEAN = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


@query(rf"""WITH {PAGES_SQL}, a AS (SELECT origin, id, nullif({_CLEAN.format("coalesce(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '')")}, '') AS title, list_filter(list_transform(regexp_extract_all(html, '(?i)<h[1-3][^>]*>([^<]*)</h[1-3]>', 1), lambda h: {_CLEAN.format('h')}), lambda h: h <> '') AS hs,
    regexp_extract_all(html, '(?i)<p[^>a-z]*>([^<]*)', 1)[:3] AS ps, regexp_matches(html, 'href="[^"]*/products/') AS products, html FROM typed_pages),
s AS (SELECT *, lower(concat_ws(' ', title, array_to_string(hs[:5], ' '))) AS said, lower(concat_ws(' ', title, array_to_string(hs[:5], ' '), array_to_string(ps, ' '))) AS whole, coalesce(title, hs[1]) AS source FROM a)
SELECT origin, id, CASE WHEN {_HAS('whole', topics.TRANSACTIONAL)} THEN 'transactional' WHEN {_HAS('whole', topics.COMMERCIAL)} THEN 'commercial' ELSE 'informational' END AS intent,
       CASE WHEN {_HAS('said', topics.LATE)} THEN CASE WHEN products THEN 'bottom_of_funnel' ELSE 'middle_of_funnel' END ELSE 'top_of_funnel' END AS stage, lower(coalesce(nullif(trim(regexp_replace(source, '\s*[|–—-]\s*\S+.*$', '')), ''), source)) AS keyword,
       CASE {' '.join(f"WHEN {_HAS('lower(title)', words)} THEN '{name}'" for name, words in topics.TOPICS.items())} ELSE 'general' END AS topic, array_to_string(list_filter([{', '.join(f"CASE WHEN contains(lower(html), {_q(w)}) THEN {_q(w)} END" for w in topics.SPAM)}], lambda x: x IS NOT NULL), ',') AS spam FROM s""")
def crawled_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search intent, funnel stage, target keyword and topic of each page by its title, first headings and first paragraphs, and words that tell of injected spam."""
    html = F.col("html")
    clean = lambda x: F.nullif(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(""))
    rows = typed_pages(spark, sf_dir).select(
        *KEYS, "html", clean(F.coalesce(markup.one(html, "(?is)<title>(.*?)</title>"), F.lit(""))).alias("title"), F.filter(F.transform(markup.every(html, r"(?i)<h[1-3][^>]*>([^<]*)</h[1-3]>"), clean), lambda h: h.isNotNull()).alias("hs"),
        F.array_join(F.slice(markup.every(html, "(?i)<p[^>a-z]*>([^<]*)"), 1, 3), " ").alias("ps"), F.regexp_like(html, F.lit('href="[^"]*/products/')).alias("products"),
    )
    title, heads = F.col("title"), F.col("hs")
    return rows.select(*KEYS, topics.search_intent(title, F.col("ps"), heads).alias("intent"), topics.funnel_stage(title, F.col("products"), heads).alias("stage"), topics.target_keyword(title, F.get(heads, 0)).alias("keyword"), topics.topic(title).alias("topic"), F.array_join(topics.spam_words(html), ",").alias("spam"))
