"""Types, platforms and stores of pages: every crawled page, and a shop page of each part under urls of many kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import page_type as PT
from ..functions import platforms as PL
from ..functions.stores import page_money, ranked_stores, stores_in
from ..operators.elements import attribute, first, has_one, held, page_arrays, span, text_inside
from ..operators.markers import marker_counts, markers_found
from ..registry import query
from ..sources.catalog import spread, table
from .dom import KEYS

#: The shop page of a part: markers of platforms, words and markup of listings, products and articles, by its number.
_HEAD = """CASE p_partkey % 7 WHEN 0 THEN '<link href="https://cdn.shopify.com/a.css"><script src="/_next/static/a.js"></script>' WHEN 1 THEN '<link href="/wp-content/themes/x.css"><script src="/wp-content/plugins/woocommerce/a.js"></script>' WHEN 2 THEN '<script src="https://static.parastorage.com/a.js"></script>'
WHEN 3 THEN '<script src="/static/frontend/mage/cookies.js" data-x="magento"></script>' WHEN 4 THEN '<script id="__NEXT_DATA__" src="/_next/static/react-dom.js"></script><script src="hsforms.net"></script>' WHEN 5 THEN '<script src="vue.js"></script>' ELSE '' END"""
_TAIL = """CASE p_partkey % 11 WHEN 0 THEN '<form class="cart"><button class="single_add_to_cart_button">Add to cart</button></form><p class="sku">SKU: AB-12345</p><div class="product-tabs">Description. Ingredients.</div>' WHEN 1 THEN '<div class="filter-bar">Filter by price Sort by name</div><p>Showing 1-20 of 300 products</p><a href="?page=2">Load more</a><p>$5 $6 $7</p>'
WHEN 2 THEN '<p>Our tour has a guide, pickup and a safari adventure</p>' WHEN 3 THEN '<article>Posted on Monday, 5 min read</article>' WHEN 4 THEN '<p>Color* Size* Material*</p>' WHEN 5 THEN '<h2>Model One</h2><h2>Model Two</h2><h3>Model Three</h3><p>Compare all models. Learn more.</p>' WHEN 6 THEN '<script type="application/ld+json">{"@type": "Product"}</script><p>Model: XR5000 in stock</p>'
WHEN 7 THEN '<h2>New arrivals</h2><h2>Shoes</h2>' WHEN 8 THEN '<p>Web app dashboard</p>' ELSE '' END"""
_URL = """'https://shop.example' || CASE p_size % 16 WHEN 0 THEN '/' WHEN 1 THEN '/en-us/home.html' WHEN 2 THEN '/cart/x' WHEN 3 THEN '/products/a' WHEN 4 THEN '/collections/all?page=2' WHEN 5 THEN '/shop/a/b' WHEN 6 THEN '/shop' WHEN 7 THEN '/blog/a' WHEN 8 THEN '/about-us' WHEN 9 THEN '/pricing/' WHEN 10 THEN '/item/x' WHEN 11 THEN '/category/hats' WHEN 12 THEN '/2024/05/06/x' WHEN 13 THEN '/t/shoe-x/abc-1' WHEN 14 THEN '/women' ELSE '/x/' || lower(p_type) END"""
#: Shop pages without what leads to products and folds open, so that the tail decides.
SHOPS = f"""'<html><head><title>' || p_name || '</title>' || {_HEAD} || '</head><body class="x"><nav class="menu"><a href="/sale">Sale</a><a href="/men/x">Men</a></nav><main><h1>' || p_name || '</h1><p>By ' || p_brand || '</p>' || CASE WHEN p_partkey % 3 = 0 THEN '<div class="product-grid"><a href="/products/a?x">A</a><a href="/products/a#y">A</a><a href="/products/b/">B</a><a href="/products/c">C</a><a href="/cart/products/">no</a></div>' ELSE '' END || {_TAIL} || '</main><footer>Author unknown</footer></body></html>'"""


def typed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """origin (crawl or shop), id, url, html."""
    crawl = spread(table(spark, sf_dir, "pages"), "page_id").select(F.lit("crawl").alias("origin"), F.col("page_id").alias("id"), "url", "html")
    return crawl.unionByName(spread(table(spark, sf_dir, "part"), "p_partkey").select(F.lit("shop").alias("origin"), F.col("p_partkey").alias("id"), F.expr(_URL).alias("url"), F.expr(SHOPS).alias("html")))


PAGES_SQL = f"""typed_pages AS (SELECT 'crawl' AS origin, page_id AS id, url, html FROM pages UNION ALL SELECT 'shop', p_partkey, {_URL}, {SHOPS} FROM part)"""


# Platforms.


def with_platforms(pages: DataFrame) -> DataFrame:
    """``pages`` (html, url, headers if there) with found and the columns of PL.steps(), told within the row of the page; one pass over each text."""
    fields = {f: F.col(f) for f in ("html", "url", "headers") if f in pages.columns}
    rows = held(pages, found=markers_found(fields, PL.markers()))
    for step in PL.steps(PT.Dialect()):
        rows = rows.withColumns({name: F.expr(x) for name, x in step.items()})
    return rows


def platforms(pages: DataFrame, keys: list[str]) -> DataFrame:
    """platform, display, confidence, headless of pages (url, html, headers if there)."""
    rows = with_platforms(pages.select(*keys, *[c for c in ("html", "url", "headers") if c in pages.columns]))
    return rows.drop("html", "url", "headers")


def _steps_sql(source: str, steps: list[dict[str, str]], name: str) -> str:
    """One CTE by step, each replacing columns of the one before."""
    parts = []
    for k, step in enumerate(steps):
        own = ", ".join(f"{x} AS {c}" for c, x in step.items())
        parts.append(f"{name}{k} AS (SELECT * {_excluded(step, _known(steps[:k]))}, {own} FROM {source})")
        source = f"{name}{k}"
    return ",\n".join(parts)


def _known(steps: list[dict[str, str]]) -> set[str]:
    return {c for s in steps for c in s}


def _excluded(step: dict[str, str], known: set[str]) -> str:
    old = [c for c in step if c in known]
    return f"EXCLUDE ({', '.join(old)})" if old else ""


_MARKERS = ", ".join("('" + m.replace("'", "''") + "')" for m in PL.markers())
_FOUND_SQL = f"""{PAGES_SQL}, markers(marker) AS (VALUES {_MARKERS}),
hits AS (SELECT origin, id, list(CASE f WHEN 0 THEN 'html:' ELSE 'url:' END || marker) AS found FROM typed_pages, markers, range(2) AS fs(f) WHERE contains(lower(CASE f WHEN 0 THEN html ELSE url END), marker) GROUP BY origin, id),
marked AS (SELECT p.origin, p.id, coalesce(found, []::VARCHAR[]) AS found FROM typed_pages p LEFT JOIN hits USING (origin, id))"""
_PLATFORM_SQL = f"""{_FOUND_SQL}, {_steps_sql("marked", PL.steps(PT.DuckDialect()), "p")}"""
_PLATFORM_LAST = f"p{len(PL.steps(PT.DuckDialect())) - 1}"


@query(f"""WITH {PAGES_SQL}, markers(marker) AS (VALUES {_MARKERS})
SELECT origin, marker, count(*) AS pages, sum((length(html) - length(replace(lower(html), marker, ''))) // length(marker))::BIGINT AS times FROM typed_pages, markers WHERE contains(lower(html), marker) GROUP BY origin, marker""")
def platform_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On how many pages each marker stands, and how often."""
    hits = marker_counts(typed_pages(spark, sf_dir), KEYS, ["html"], PL.markers())
    return hits.groupBy("origin", "marker").agg(F.count("*").alias("pages"), F.sum("times").alias("times"))


@query(f"""WITH {_PLATFORM_SQL} SELECT origin, id, platform, display, confidence::DOUBLE AS confidence, headless FROM {_PLATFORM_LAST}""")
def page_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platform, name to show, confidence and whether the shop has a front of its own."""
    return platforms(typed_pages(spark, sf_dir), KEYS).select(*KEYS, "platform", "display", F.col("confidence").cast("double").alias("confidence"), "headless")


# Types.

CONTAINERS = [("tag", "main"), ("role", "main"), ("id", "MainContent"), ("id", "main-content"), ("class", "main-content"), ("class", "page-content"), ("class", "content"), ("tag", "body")]
# Parts of a page that are none of its main content.
CHROME_TAGS = ["header", "nav", "footer"]
CHROME_CLASSES = ["header", "site-header", "main-header", "footer", "site-footer", "main-footer", "menu", "navigation", "navbar", "nav", "mega-menu", "megamenu", "drawer", "mobile-menu", "announcement-bar", "breadcrumb", "breadcrumbs", "account", "login", "newsletter", "modal", "popup"]


def page_facts(pages: DataFrame, keys: list[str], told: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """url, path, html, body, main, seo, hrefs, headings, heads2, elements: what signals are sought in, one row per page, and the columns ``told`` as they are.

    The main content is the first container of the list that a page has, without menus, headers,
    footers and their like, however they are nested.  All is told within the row of the page.
    """
    rows = page_arrays(pages.select(*keys, *told, F.lower(F.coalesce("url", F.lit(""))).alias("url"), F.lower(F.coalesce("html", F.lit(""))).alias("_low"), "html"))
    is_ = lambda e, kind, name: e["tag"] == name if kind == "tag" else F.array_contains(e["classes"], name) if kind == "class" else attribute(e["token"], kind) == name
    place = lambda e: F.coalesce(*[F.when(is_(e, *c), F.lit(k)) for k, c in enumerate(CONTAINERS)])
    boxes = F.transform(F.filter("els", lambda e: e["end"] > e["pos"]), lambda e: F.struct(place(e).alias("k"), e["pos"].alias("pos"), e["end"].alias("end")))
    chrome = F.transform(F.filter("els", lambda e: e["tag"].isin(CHROME_TAGS) | has_one(e, CHROME_CLASSES)), span)
    rows = held(rows, box=F.array_min(F.filter(boxes, lambda x: x["k"].isNotNull())), chrome=chrome)
    # Without any container the whole page is one.
    inside = lambda x: F.col("box").isNull() | ((x["pos"] >= F.col("box.pos")) & (x["pos"] < F.col("box.end")))
    scoped = lambda x: inside(x) & ~F.exists("chrome", lambda c: (c["pos"] == x["pos"]) | ((c["pos"] < x["pos"]) & (c["end"] > x["pos"])))
    named = lambda e: [F.lower(e["cls"] if a == "class" else attribute(e["token"], a)).alias(a.replace("-", "_")) for a in PT.ATTRIBUTES]
    flags = lambda e: [F.regexp_like(F.lower(e["token"]), F.lit(rf"\s{f}[\s=>]")).alias(f.replace("-", "_")) for f in PT.FLAGS]
    element = lambda e: F.struct(e["pos"].alias("pos"), e["tag"].alias("tag"), scoped(e).alias("scoped"), *named(e), *flags(e), F.when(e["tag"] == "a", F.lower(attribute(e["token"], "href"))).alias("href"))
    head = lambda e: F.struct(e["tag"].alias("tag"), text_inside(F.col("texts"), e).alias("said"))
    rows = held(rows, elements=F.transform("els", element), heads=F.transform(F.filter("els", lambda e: e["tag"].isin("title", "h1", "h2", "h3")), head), scoped=F.filter("texts", scoped)).drop("els")
    joined = lambda texts: F.lower(F.array_join(F.transform(texts, lambda t: t["text"]), " "))
    about = F.coalesce(first("elements", lambda e: (e["tag"] == "meta") & (e["name"] == "description"))["content"], F.lit(""))
    tags = lambda *names: F.transform(F.filter("heads", lambda h: h["tag"].isin(*names)), lambda h: h["said"])
    return rows.select(
        *keys, *told, "url", F.col("_low").alias("html"), F.expr(PATH_SQL).alias("path"), joined("texts").alias("body"), joined("scoped").alias("main"),
        F.lower(F.trim(F.regexp_replace(F.concat_ws(" ", F.get(tags("title"), F.lit(0)), about, F.get(tags("h1"), F.lit(0))), r"\s+", " "))).alias("seo"), F.transform(F.filter("elements", lambda e: (e["tag"] == "a") & e["scoped"] & (e["href"] != "")), lambda e: e["href"]).alias("hrefs"), tags("h2", "h3").alias("headings"), F.transform(tags("h2"), F.lower).alias("heads2"), "elements",
    )


#: The path of a url in lower case; the root if there is none.
PATH_SQL = "CASE WHEN url LIKE '%://%' THEN coalesce(nullif(regexp_extract(url, '^[^:/?#]*://[^/?#]*([^?#]*)', 1), ''), '/') ELSE coalesce(nullif(regexp_extract(url, '^([^?#]*)', 1), ''), '/') END"


def type_steps(d: PT.Dialect) -> list[dict[str, str]]:
    """Columns from a page's facts and platform_name to its type."""
    return [
        PT.measures(d) | {"platform_name": "translate(lower(coalesce(platform, '')), '_-', '  ')"},
        {"found": d.listed([f"CASE WHEN {test} THEN '{name}' END" for _, _, name, test in PT.signals(d)])},
        {f"points_{f}": PT.points(d, f) for f in ("product", "collection", "blog")},
        PT.sums(d),
        {"stage": PT.decided(d)},
        {"page_type": PT.by_number(d, 1), "confidence": PT.by_number(d, 2), "reason": PT.by_number(d, 3)},
    ]


def page_types_of(pages: DataFrame, keys: list[str], told: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """page_type, confidence, reason, stage, subtype, scores and signals of pages (url, html), and the columns ``told`` as they are; platforms are found first."""
    rows = page_facts(with_platforms(pages), keys, [*told, "platform"])
    for k, step in enumerate(type_steps(PT.Dialect())):
        columns = {name: F.expr(x) for name, x in step.items()}
        rows = held(rows, **columns) if k in (0, 1, 3) else rows.withColumns(columns)  # else each condition would be repeated within all that use it
    return rows


_TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({0}, '(?s)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&copy;', '©'), '&amp;', '&'), '\s+', ' ', 'g'))"""
_MAIN = r"""regexp_replace(CASE WHEN contains(low, '<main>') THEN regexp_extract(low, '(?s)<main>(.*)</main>', 1) ELSE regexp_extract(low, '(?s)<body[^>]*>(.*)', 1) END, '(?s)<nav\b.*?</nav>|<footer\b.*?</footer>|<header\b.*?</header>', ' ', 'g')"""
_TYPES_SQL = f"""{_PLATFORM_SQL},
lowered AS (SELECT p.origin, p.id, lower(p.url) AS url, lower(p.html) AS low, p.html AS raw, x.platform FROM typed_pages p JOIN {_PLATFORM_LAST} x USING (origin, id)),
scoped AS (SELECT *, low AS html, {_MAIN} AS main_html, {PATH_SQL} AS path FROM lowered),
facts AS (SELECT *, {_TEXT.format("low")} AS body, {_TEXT.format("main_html")} AS main, trim(regexp_extract(low, '<title>([^<]*)', 1) || ' ' || regexp_extract(low, '<h1[^>]*>([^<]*)', 1)) AS seo, regexp_extract_all(main_html, '<a [^>]*href="([^"]*)"', 1) AS hrefs,
          regexp_extract_all(raw, '<h[23][^>]*>([^<]*)', 1) AS headings, regexp_extract_all(low, '<h2[^>]*>([^<]*)', 1) AS heads2 FROM scoped),
{_steps_sql("facts", type_steps(PT.DuckDialect()), "t")}"""


@query(f"""WITH {_TYPES_SQL} SELECT origin, id, page_type, confidence::DOUBLE AS confidence, reason, subtype, product_score::INT AS product_score, collection_score::INT AS collection_score, blog_score::INT AS blog_score, list_aggregate(list_sort(found), 'string_agg', ',') AS signals FROM t5""")
def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type of every page with confidence, the decision's reason, the kind of a general page, scores and signals."""
    rows = page_types_of(typed_pages(spark, sf_dir), KEYS)
    shown = [F.col(f"{f}_score").cast("int").alias(f"{f}_score") for f in ("product", "collection", "blog")]
    return rows.select(*KEYS, "page_type", F.col("confidence").cast("double").alias("confidence"), "reason", "subtype", *shown, F.nullif(F.array_join(F.array_sort("found"), ","), F.lit("")).alias("signals"))


# Stores.

#: A shop page of a part with stores by language, a list of countries, links that set one, and prices.
STORES = """'<html' || CASE p_partkey % 3 WHEN 0 THEN ' lang="en-GB"' WHEN 1 THEN ' lang="de"' ELSE '' END || '><head>' || CASE WHEN p_partkey % 2 = 0 THEN '<link rel="alternate" hreflang="en-GB" href="https://uk.shop.example/"><link rel="alternate" hreflang="fr" href="/fr"><link rel="alternate" hreflang="x-default" href="/"><link rel="alternate" hreflang="de-CH" href="https://shop.example/ch">' ELSE '' END
|| CASE p_partkey % 5 WHEN 0 THEN '<script>Shopify.currency = {"rate":"1","active":"PKR"};</script>' WHEN 1 THEN '<meta itemprop="priceCurrency" content="cad">' WHEN 2 THEN '<script>{"currency": "SEK"}</script>' ELSE '' END || '</head><body>' || CASE WHEN p_partkey % 5 = 3 THEN '<p>' || p_size || ' AED and 7.00 AED or USD 5</p>' ELSE '' END
|| CASE WHEN p_partkey % 4 = 1 THEN '<select name="country_code"><option value="PK">Pakistan (PKR Rs.)</option><option value="ch">Schweiz<option value="XX" data-currency="usd">Nowhere (x)</option><option value="">none</option></select><a href="/x?country=ca">Canada</a>' ELSE '' END || '</body></html>'"""


def store_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawl = spread(table(spark, sf_dir, "pages"), "page_id").select(F.lit("crawl").alias("origin"), F.col("page_id").alias("id"), "url", "html")
    return crawl.unionByName(spread(table(spark, sf_dir, "part"), "p_partkey").select(F.lit("shop").alias("origin"), F.col("p_partkey").alias("id"), F.lit("https://shop.example/a?b").alias("url"), F.expr(STORES).alias("html")))


def stores_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = store_pages(spark, sf_dir)
    return stores_in(page_arrays(pages.withColumn("raw", F.col("html")), "raw"))


_OWN = "CASE p_partkey % 3 WHEN 0 THEN 'GB' END"
_MONEY = "CASE p_partkey % 5 WHEN 0 THEN 'PKR' WHEN 1 THEN 'CAD' WHEN 3 THEN 'AED' ELSE CASE WHEN p_partkey % 3 = 0 THEN 'GBP' WHEN p_partkey % 5 = 2 THEN 'SEK' END END"
_LANG = "CASE p_partkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'en' END"
_COUNTRY_SQL = "CASE WHEN regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) SIMILAR TO '.*/(fr|de|es|it)(/.*)?' THEN upper(regexp_extract(url, '^https?://[^/?#]*/([a-z][a-z])(?:/|$)', 1)) END"


@query(f"""WITH shops AS (SELECT *, {_OWN} AS own, {_MONEY} AS money, {_LANG} AS lang FROM part),
found AS (
    SELECT p_partkey AS id, own, money, unnest([
        CASE WHEN p_partkey % 2 = 0 THEN {{'k': 0, 'hreflang': 'en-GB', 'country': 'GB', 'name': 'United Kingdom', 'url': 'https://uk.shop.example/', 'currency': CASE WHEN own = 'GB' THEN coalesce(money, 'GBP') ELSE 'GBP' END, 'current': coalesce(own = 'GB', false), 'same_url': false}} END,
        CASE WHEN p_partkey % 2 = 0 THEN {{'k': 1, 'hreflang': 'de-CH', 'country': 'CH', 'name': 'Switzerland', 'url': 'https://shop.example/ch', 'currency': coalesce(money, 'CHF'), 'current': true, 'same_url': false}} END,
        CASE WHEN p_partkey % 4 = 1 THEN {{'k': 2, 'hreflang': lang || '-PK', 'country': 'PK', 'name': 'Pakistan', 'url': 'https://shop.example/a?b&country=PK', 'currency': 'PKR', 'current': false, 'same_url': true}} END,
        CASE WHEN p_partkey % 4 = 1 THEN {{'k': 3, 'hreflang': lang || '-CH', 'country': 'CH', 'name': 'Switzerland', 'url': 'https://shop.example/a?b&country=CH', 'currency': 'CHF', 'current': false, 'same_url': true}} END,
        CASE WHEN p_partkey % 4 = 1 THEN {{'k': 4, 'hreflang': lang || '-XX', 'country': 'XX', 'name': 'Nowhere', 'url': 'https://shop.example/a?b&country=XX', 'currency': 'USD', 'current': false, 'same_url': true}} END,
        CASE WHEN p_partkey % 4 = 1 THEN {{'k': 5, 'hreflang': lang || '-CA', 'country': 'CA', 'name': 'Canada', 'url': 'https://shop.example/a?b&country=CA', 'currency': 'CAD', 'current': false, 'same_url': true}} END,
        CASE WHEN p_partkey % 4 = 3 AND (own IS NOT NULL OR money IS NOT NULL) THEN {{'k': 6, 'hreflang': concat_ws('-', CASE WHEN p_partkey % 3 < 2 THEN lang END, own), 'country': own, 'name': CASE own WHEN 'GB' THEN 'United Kingdom' END, 'url': 'https://shop.example/a?b', 'currency': money, 'current': true, 'same_url': false}} END]) AS x FROM shops
),
kept AS (SELECT id, x.*, row_number() OVER (PARTITION BY id ORDER BY x.current DESC, x.k) = 1 AS now FROM found WHERE x IS NOT NULL),
crawl AS (SELECT page_id, url, {_COUNTRY_SQL} AS country, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang FROM pages)
SELECT 'shop' AS origin, id, row_number() OVER (PARTITION BY id ORDER BY now DESC, lower(name), country)::INT AS rank, hreflang, country, name, url, currency, now AS current, same_url FROM kept
UNION ALL SELECT 'crawl', page_id, 1, lang || '-' || country, country, CASE country WHEN 'FR' THEN 'France' WHEN 'DE' THEN 'Germany' WHEN 'ES' THEN 'Spain' WHEN 'IT' THEN 'Italy' END, url, 'EUR', true, false FROM crawl WHERE country IS NOT NULL""")
def page_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regional stores of every page, the current one first."""
    return ranked_stores(stores_found(spark, sf_dir), KEYS)


@query(f"""SELECT 'shop' AS origin, p_partkey AS id, {_MONEY} AS currency, array_to_string(list_sort(list_distinct(list_filter(CASE WHEN p_partkey % 4 = 1 THEN ['PKR', 'CHF', 'USD', 'CAD', {_MONEY}] ELSE [{_MONEY}] END, lambda x: x IS NOT NULL))), ',') AS currencies,
       CASE WHEN p_partkey % 5 < 2 THEN 'active_currency' WHEN p_partkey % 5 = 3 THEN 'visible_currency' WHEN p_partkey % 3 = 0 THEN 'cctld_currency' WHEN p_partkey % 5 = 2 THEN 'base_currency' END AS source FROM part
UNION ALL SELECT 'crawl', page_id, CASE WHEN {_COUNTRY_SQL} IS NOT NULL THEN 'EUR' END, CASE WHEN {_COUNTRY_SQL} IS NOT NULL THEN 'EUR' ELSE '' END, CASE WHEN {_COUNTRY_SQL} IS NOT NULL THEN 'cctld_currency' END FROM pages""")
def page_currencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The currency of every page, all that it offers, and what told it."""
    return page_money(stores_found(spark, sf_dir), KEYS).withColumn("currencies", F.array_join("currencies", ","))
