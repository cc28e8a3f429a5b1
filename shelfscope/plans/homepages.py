"""Pages in one form, and homepages side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import truncate, url_domain
from ..functions.page_type import DuckDialect, alternation
from ..operators.elements import decoded
from ..registry import query
from ..sources.catalog import table
from ..sources.files import stored
from .page_types import _TEXT, KEYS, PAGES_SQL, typed_pages

# Words of a homepage's features.
FEATURES = {
    "has_newsletter": ["newsletter", "subscribe", "mailing list", "sign up for", "email address", "join our list"],
    "has_trust_signals": ["free shipping", "secure checkout", "money back", "money-back", "satisfaction guarantee", "easy returns", "warranty", "100% authentic", "ssl secure"],
    "has_discount_messaging": ["sale", "discount", "% off", "promo code", "coupon"],
    "has_blog_preview": ["blog", "article", "journal", "read more", "our stories"],
    "has_testimonials": ["testimonial", "reviews", "loved by", "what our customers", "rated"],
    "has_instagram_feed": ["instagram"],
    "has_whatsapp": ["whatsapp"],
    "has_video": ["youtube", "vimeo", "watch video", "play video", "wistia"],
    "has_free_shipping_offer": ["free shipping", "free delivery"],
}
_RAW = r"(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)>"


def visible_text(html):  # noqa: ANN001, ANN201
    """All text of a page without scripts, references decoded, white space collapsed."""
    return decoded(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), _RAW, " "), "<[^>]*>", " "))


_CUT = "CASE WHEN length({0}) > {1} THEN rtrim(left({0}, {1} - 1)) || '…' ELSE {0} END"


@query(rf"""WITH {PAGES_SQL}, t AS (SELECT *, {_TEXT.format("html")} AS body, trim(regexp_replace(coalesce(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), ''), '\s+', ' ', 'g')) AS title_, nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>([^<]*)', 1)), '') AS h1,
       list_filter(list_transform(regexp_extract_all(html, '(?is)<h[1-3][^>]*>([^<]*)</h[1-3]>', 1), lambda h: trim(regexp_replace(h, '\s+', ' ', 'g'))), lambda h: h <> '') AS hs FROM typed_pages)
SELECT origin, id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', '') AS domain, nullif(title_, '') AS title, h1, array_to_string(hs[:60], '|') AS headings, {_CUT.format("trim(concat_ws(' ', h1, title_, body))", 1200)} AS summary, {_CUT.format("body", 2500)} AS preview,
       coalesce(nullif(title_, ''), h1) AS name, html <> '' AS success FROM t""")
def normalized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page in one form: its site, title and heading, and what a reader of the report sees of its text."""
    html, body = F.col("html"), visible_text(F.col("html"))
    clean = lambda x: F.nullif(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(""))
    rows = typed_pages(spark, sf_dir).select(*KEYS, url_domain(F.col("url")).alias("domain"), clean(F.coalesce(M.one(html, "(?is)<title>(.*?)</title>"), F.lit(""))).alias("title"), M.one(html, r"(?is)<h1[^>]*>([^<]*)").alias("h1"), F.array_join(M.headings(html), "|").alias("headings"), body.alias("body"), (html != "").alias("success"))
    return rows.select(*KEYS, "domain", "title", "h1", "headings", truncate(F.trim(F.concat_ws(" ", "h1", F.coalesce("title", F.lit("")), "body")), 1200).alias("summary"), truncate(F.col("body"), 2500).alias("preview"), F.coalesce("title", "h1").alias("name"), "success")


#: A homepage of a part's brand; the part's columns decide what it shows.
_HOME = """'<html><head><title>' || p_brand || '</title>' || CASE WHEN p_size % 2 = 0 THEN '<meta name="description" content="x">' ELSE '' END || '</head><body><div class="announcement-bar">' || CASE WHEN p_size % 3 = 0 THEN 'Free delivery over $50' ELSE '' END || '</div><h1>' || p_name || '</h1><h2>Featured</h2>' || CASE WHEN p_size % 4 = 0 THEN '<h2>Our Stories</h2><p>Loved by all</p>' ELSE '' END
|| '<a href="/products/p' || p_size || '">P</a><a href="/products/q">Q</a><img src="a"><button>Buy</button>' || CASE WHEN p_size % 5 = 0 THEN '<iframe src="youtube.com"></iframe><p>Play video</p>' ELSE '' END || '<footer>' || CASE p_size % 6 WHEN 0 THEN 'Subscribe to our newsletter' WHEN 1 THEN 'Secure checkout. Instagram' WHEN 2 THEN 'WhatsApp us. Summer Sale' ELSE 'Contact' END || '</footer></body></html>'"""


@query(f"""WITH homes AS (SELECT 'https://' || replace(lower(p_brand), '#', '') || '.example/' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'p/' || p_partkey END AS url, p_partkey AS page, {_HOME} AS html, p_size, p_name, p_brand FROM part),
h AS (SELECT *, replace(lower(p_brand), '#', '') || '.example' AS domain, lower({_TEXT.format("html")}) AS body, row_number() OVER (PARTITION BY p_brand ORDER BY page) AS n FROM homes WHERE page % 3 = 0)
SELECT d.domain, h.page IS NOT NULL AS detected, h.page, h.p_brand AS title, CASE WHEN h.page IS NOT NULL THEN h.p_size % 2 = 0 END AS described, nullif(CASE WHEN h.p_size % 3 = 0 THEN 'Free delivery over $50' ELSE '' END, '') AS announcement, CASE WHEN h.page IS NOT NULL THEN CASE WHEN h.p_size % 4 = 0 THEN 2 ELSE 1 END END AS sections,
       CASE WHEN h.page IS NOT NULL THEN 2 END AS products, CASE WHEN h.page IS NOT NULL THEN 1 END AS buttons, CASE WHEN h.page IS NOT NULL THEN 1 END AS images, {", ".join(f"coalesce({DuckDialect().any('h.body', words)}, false) AS {name}" for name, words in FEATURES.items())}
FROM (SELECT DISTINCT replace(lower(p_brand), '#', '') || '.example' AS domain, p_brand FROM part) d LEFT JOIN h ON h.p_brand = d.p_brand AND h.n = 1""")
def homepage_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every site's homepage: what it announces, how much it shows, and its features by the words of its whole text, the footer's included; sites without one say so."""
    from ..functions.urls import is_homepage

    part = table(spark, sf_dir, "part")
    url = F.concat(F.lit("https://"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.lit(".example/"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("p/"), F.col("p_partkey").cast("string"))))
    pages = part.select(url.alias("url"), F.col("p_partkey").alias("page"), F.expr(_HOME).alias("html")).withColumn("domain", url_domain(F.col("url")))
    first = pages.where(is_homepage(F.col("url"))).withColumn("n", F.row_number().over(Window.partitionBy("domain").orderBy("page"))).where("n = 1")
    html, body = F.col("html"), F.lower(visible_text(F.col("html")))
    count = lambda pattern: F.regexp_count(html, F.lit(pattern))
    facts = first.select(
        "domain", "page", M.one(html, "(?is)<title>(.*?)</title>").alias("title"), M.meta(html, "description").isNotNull().alias("described"), M.one(html, r'(?is)class="announcement-bar"[^>]*>([^<]*)').alias("announcement"), count("(?i)<h2[ >]").alias("sections"),
        M.product_links(html).alias("products"), count("(?i)<button[ >]").alias("buttons"), count("(?i)<img[ >]").alias("images"), body.alias("body"),
    ).select("*", *[F.regexp_like("body", F.lit(alternation(words))).alias(name) for name, words in FEATURES.items()]).drop("body")
    sites = pages.select("domain").distinct().join(facts, "domain", "left")
    return sites.select("domain", F.col("page").isNotNull().alias("detected"), "page", "title", "described", "announcement", "sections", "products", "buttons", "images", *[F.coalesce(name, F.lit(False)).alias(name) for name in FEATURES])


@query(r"""WITH shops AS (SELECT p_partkey AS id, unnest([{'slug': 'women', 'title': 'Women'}, {'slug': lower(p_type), 'title': p_type}, {'slug': 'k' || p_partkey, 'title': p_name}, {'slug': 'new', 'title': 'New & now'}, {'slug': 'men-shoes', 'title': 'Men Shoes'}]) AS x FROM part),
listed AS (SELECT DISTINCT lower(p_type) AS slug FROM part)
SELECT s.id, s.x.slug AS slug, s.x.title AS title, l.slug IS NOT NULL AS in_catalog FROM shops s LEFT JOIN listed l ON l.slug = s.x.slug""")
def harvested_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of shops' menus against the catalog's collections, by url or by the last part of its path."""
    from ..functions.urls import collection_key, handle
    from .dom import menu_paths

    menu = menu_paths(spark, sf_dir).where("origin = 'shop'").select("id", "title", handle(F.col("url")).alias("slug"), collection_key(F.col("url")).alias("key"))
    # Few collections against all links: stored, as their number is not that of the parts they are read from.
    listed = stored(table(spark, sf_dir, "part").select(F.lower("p_type").alias("slug")).distinct())
    by_url = listed.select(F.concat(F.lit("shop.example/collections/"), "slug").alias("key"), F.lit(True).alias("by_url"))
    by_slug = listed.select("slug", F.lit(True).alias("by_slug"))
    # Two equi-joins, as one with "or" could not be spread by key.
    return menu.join(by_url, "key", "left").join(by_slug, "slug", "left").select("id", "slug", "title", F.coalesce("by_url", "by_slug", F.lit(False)).alias("in_catalog"))
