"""Gates and ordered rules over the table of parts: each part is given one of the written cases, and
beside each case stands what the rule must say of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import urls
from ..registry import query
from ..sources.catalog import table


def given(spark: SparkSession, sf_dir: str, schema: str, rows: list[tuple]) -> DataFrame:
    """Every part with one of the rows, by its number; the rows are a fixed table."""
    cases = F.broadcast(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k long, {schema}"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), (F.col("p_partkey") % len(rows)).alias("k")).join(cases, "k").drop("k")


def _value(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def wanted(names: str, rows: list[tuple]) -> str:
    """SQL: part and the expected columns of its case."""
    listed = ", ".join(f"({k}, {', '.join(map(_value, r))})" for k, r in enumerate(rows))
    return f"SELECT p_partkey AS part, {names} FROM part JOIN (VALUES {listed}) AS w(k, {names}) ON w.k = p_partkey % {len(rows)}"


def _split(cases: list[tuple], n: int) -> tuple[list[tuple], list[tuple]]:
    return [c[:n] for c in cases], [c[n:] for c in cases]


_LONG = "<p>" + "plain words of a page " * 12 + "</p>"
PAGES, PAGES_W = _split([
    (None, "https://a.b/x", 200, "empty", 1.0, True, False), ("", "https://a.b/captcha", 200, "empty", 1.0, False, True), ("<script>" + "x" * 300 + "</script>short", "https://a.b", 200, "too_thin", 0.9, False, False), (_LONG + "please solve the captcha", "u", 200, "captcha", 0.97, False, False),
    ("<title>Just a moment...</title>" + _LONG, "u", 503, "cloudflare", 0.97, True, True), (_LONG + "Access denied", "u", 403, "bot_check", 0.92, True, True), ("<title>Sign in</title><form class='login'>" + _LONG, "u", 200, "login_wall", 0.88, False, False), ("<title>Sign in</title>" + _LONG, "u", None, None, None, False, False),
    ("<title>404 - gone</title>" + _LONG, "u", 404, "error_page", 0.93, False, False), (_LONG + "[LOGIN REQUIRED]", "u", 200, "bot_check", 0.85, False, False), (_LONG, "https://a.b/verify?x", 200, None, None, False, True),
], 3)


@query(wanted("kind, confidence, blocked, bot", PAGES_W))
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stops an analysis of a page, in order; blocked responses by status, and challenge pages by url or opening."""
    rows = given(spark, sf_dir, "html string, url string, status int", PAGES)
    b = R.page_block(F.col("html"))
    return rows.select("part", b["kind"].alias("kind"), b["confidence"].alias("confidence"), R.blocked_response(F.col("html"), F.col("status")).alias("blocked"), R.bot_page(F.col("url"), F.col("html")).alias("bot"))


SITES, SITES_W = _split([
    ("https://www.brand.co.uk/x", "", 3, 100, False, "brand", "brand_store", False, "brand"), ("shop.com", "", 50, 10, False, "shop", "many_vendors", False, "marketplace"), ("https://bigmart.com", "", None, 300000, True, "bigmart", "allowlisted", False, None), ("https://m.bazaar.pk", "", 1, 5, False, "bazaar", "marketplace_denylist", True, "brand"),
    ("https://x.com", "Become a Seller today", None, 5, False, "x", "marketplace_signal", False, None), ("https://huge.de", None, 2, 250000, False, "huge", "size_backstop", False, "brand"), ("https://uni.edu.pk", None, None, None, False, "uni", "brand_store", True, None), ("https://department-store.com", None, 6, 1, False, "department-store", "brand_store", True, "marketplace"),
    ("https://department-store.com", None, 4, 1, True, "department-store", "brand_store", False, "brand"), ("localhost", None, 0, 1, True, "localhost", "brand_store", False, "brand"),
], 5)


@query(wanted("name, tier, excluded, kind", SITES_W))
def site_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registrable name of a site, its tier by the ordered gate, whether it is no rival, and whether it is a marketplace."""
    rows = given(spark, sf_dir, "url string, html string, vendors int, size int, multi boolean", SITES)
    domain = F.regexp_replace(F.regexp_replace(F.col("url"), "^https?://", ""), "/.*$", "")
    tier = R.scale_tier(F.col("url"), F.col("html"), F.col("vendors"), F.col("size"), ["bigmart"], ["bazaar", "bigmart"], ["become a seller", "sell on"])
    return rows.select("part", R.registrable(F.col("url")).alias("name"), tier.alias("tier"), R.excluded_domain(domain, F.col("multi"), ["bazaar"], ["department-store"]).alias("excluded"), R.site_kind(F.col("vendors"), F.lit(None).cast("int")).alias("kind"))


ROUTES, ROUTES_W = _split([
    ("https://a.b/", "homepage", 0), ("https://a.b/cart?x=1", "blocked", 0), ("https://a.b/products/lip-gloss", "products", 90), ("https://a.b/collections/lips", "collections", 120), ("https://a.b/collections/lips/products/x", "products", 210), ("https://a.b/pricing", "pricing", 0), ("https://a.b/repair-service", "services", 0), ("https://a.b/blog/about-us", "otherPages", -30),
    ("https://a.b/xyz", None, 0), ("https://a.b/img/x.PNG", "blocked", 0), ("https://a.b/sitemap_news_images_1", "otherPages", -120), ("https://a.b/category/c/x", "collections", 120), ("https://a.b", "homepage", 0),
], 1)


@query(wanted("route, points", ROUTES_W))
def url_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a crawl does with a url, and how early a sitemap of that name is read."""
    rows = given(spark, sf_dir, "url string", ROUTES)
    return rows.select("part", R.url_route(F.col("url")).alias("route"), R.sitemap_score(F.col("url")).alias("points"))


CATEGORIES = {"lipstick": ["lipstick", "lip color", "lips"], "footwear": ["shoe", "shoes", "heels"], "men": ["men", "mens"]}
SHELVES, SHELVES_W = _split([
    ("Lip Color Studio", "https://s.b/collections/lip-color", True, 500, 0, ["nike"], ["toner"], False, False, "lipstick", 95.0, "unknown"), ("Summer Sale", "https://s.b/collections/sale", False, 10, 5, ["nike"], ["toner"], True, True, None, 7.0, "marketing"),
    ("Nike", "https://s.b/collections/nike?sort_by=price", True, None, 0, ["nike"], ["toner"], True, True, None, 40.0, "brand"), ("Mens Shoes", "https://s.b/collections/mens-shoes", False, 25, 0, [], ["shoe"], False, False, "footwear", 20.0, "category"), ("Toners for your skin", "https://s.b/collections/t", False, 0, 1, [], ["toner"], False, False, None, 1.0, "category"),
    ("Acme", "https://s.b/collections/acme", False, 0, 0, ["nike"], ["toner"], True, False, None, 0.0, "brand"), (" ", "https://s.b/collections/all", False, 0, 0, [], [], False, True, None, 0.0, "unknown"), (None, "https://s.b", False, 0, 0, [], [], False, True, None, 0.0, "unknown"),
], 8)


@query(wanted("junk, category, points, kind", SHELVES_W))
def collection_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections that are none, their category, how important they are, and what kind of shelf their title names."""
    rows = given(spark, sf_dir, "title string, url string, nav boolean, size int, own int, vendors array<string>, types array<string>, multi boolean", SHELVES).withColumn("handle", urls.handle(F.col("url")))
    category = R.canonical_category(F.col("title"), F.col("handle"), CATEGORIES)
    return rows.select("part", R.junk_collection(F.col("handle"), F.col("url")).alias("junk"), category.alias("category"), R.collection_points(F.col("nav"), F.col("size"), category, F.col("own")).alias("points"), R.collection_kind(F.col("title"), F.col("vendors"), F.col("types"), F.col("multi")).alias("kind"))


SIGNALS, SIGNALS_W = _split([
    (["jsonld_product", "price_meta"], 3, True, 0, False, [], True, False, False), (["jsonld_product"], 18, True, 3, False, [], True, True, True), (["jsonld_product"], 17, False, 9, True, [], False, False, True), (["other"], 40, True, 0, True, [], False, True, True), ([], 0, True, 1, False, ["sort_filter_dom"], False, True, False), (None, None, True, 2, False, ["x"], None, False, False),
], 6)


@query(wanted("product, overrides, shop", SIGNALS_W))
def page_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether signals prove a product page, whether a collection outweighs a blog's url, and whether there is a shop at all."""
    rows = given(spark, sf_dir, "signals array<string>, score int, is_collection boolean, links int, grid boolean, found array<string>", SIGNALS)
    shop = (F.col("links") > 2) | F.col("grid")
    return rows.select("part", R.strong_product(F.col("signals"), F.col("score")).alias("product"), R.collection_override(F.col("is_collection"), F.col("links"), F.col("grid"), F.col("found")).alias("overrides"), shop.alias("shop"))


TAGS, TAGS_W = _split([([" Women ", "sale"], "Women"), (["mens"], "Men"), (["womenswear"], None), (["Boys", "unisex"], "Kids"), (["unisex"], "Unisex"), ([], None), (None, None), (["male", "ladies"], "Women")], 1)


@query(wanted("audience", TAGS_W))
def tag_audiences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who a product is for, by whole tags, the first of four groups."""
    return given(spark, sf_dir, "tags array<string>", TAGS).select("part", R.audience(F.col("tags")).alias("audience"))


SECTIONS, SECTIONS_W = _split([
    ("hero_banner", "New collection, free shipping and 20% off", 1, 5, 1, "homepage", 100, "high", "P1_show_prominently"), ("newsletter", "join us", 4, 0, 0, "homepage", 39, "low", "P3_keep_for_ai_context"), ("faq", "", 9, 0, 0, "product", 0, "low", "P4_archive_context"), ("promo", "flash deal", 3, 1, 2, "collection", 65, "medium", "P2_show_in_details"),
    ("featured_products", "Shop", 2, 4, 0, "general", 62, "medium", "P2_show_in_details"),
], 6)


@query(wanted("points, level, priority", SECTIONS_W))
def section_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How important a section is, its level and its place in a workspace."""
    rows = given(spark, sf_dir, "kind string, text string, rank int, links int, images int, page string", SECTIONS)
    rows = rows.withColumn("points", R.section_points(F.col("kind"), F.col("text"), F.col("rank"), F.col("links"), F.col("images"), F.col("page")))
    return rows.select("part", "points", R.level(F.col("points")).alias("level"), R.priority(F.col("points")).alias("priority"))


POLICIES, POLICIES_W = _split([
    ("We offer FREE shipping on orders over Rs. 2,000 and cash on delivery. Delivered in 3-5 working days. Returns within 14 days.", True, True, "rs. 2,000", True, False, False, False, "3-5 working days", True, 14), ("All sales final. Pay by Visa or PayPal; bank transfer welcome.", True, False, None, False, True, True, True, None, False, None), ("short", False, False, None, False, False, False, False, None, None, None),
    ("Free delivery! A 30-day return policy holds for everything in the store.", True, True, None, False, False, False, False, None, True, 30), (None, False, False, None, False, False, False, False, None, None, None), ("2 to 4 business days until we dispatch your parcel from the warehouse.", True, False, None, False, False, False, False, "2 to 4 business days", None, None),
], 1)


@query(wanted("evidence, free_shipping, free_from, cash, bank, card, wallet, delivery, returns, return_days", POLICIES_W))
def shipping_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipping, payment and returns as a shop's policies state them: the nine features, side by side for all sites."""
    return given(spark, sf_dir, "text string", POLICIES).select("part", R.shipping_signals(F.col("text")).alias("s")).select("part", "s.*")


KINDS, KINDS_W = _split([
    (3, 0, False, [], None, None, 0, 5, 1, "ecommerce"), (0, 1, True, [], None, None, 0, 5, 1, "ecommerce"), (0, 0, True, [], None, None, 0, 5, 1, "saas"), (0, 0, False, ["Gold", "PRO"], None, None, 0, 5, 1, "saas"), (0, 0, False, ["Gold"], "agency", None, 0, 5, 1, "business"), (0, 0, False, [], "platform", None, 0, 5, 1, "saas"),
    (0, 0, False, [], None, "news_magazine", 0, 5, 1, "content"), (0, 0, False, [], None, "portfolio", 4, 5, 1, "business"), (0, 0, False, [], None, "", 2, 5, 1, "content"), (0, 0, False, None, None, None, 1, 5, 1, "business"), (0, 0, False, [], None, None, 0, 0, 0, "unknown"),
], 9)


@query(wanted("kind", KINDS_W))
def site_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a site is: shop, software, business, content or unknown, by ordered rules."""
    rows = given(spark, sf_dir, "priced int, shops int, saas boolean, plans array<string>, model string, homepage string, blogs int, pages int, general int", KINDS)
    return rows.select("part", R.site_type(*map(F.col, ("priced", "shops", "saas", "plans", "model", "homepage", "blogs", "pages", "general"))).alias("kind"))


CLAIMS, CLAIMS_W = _split([
    ("Premium waterproof lipstick, vegan", "Affordable lipstick, VEGAN, tested", "ethical", "durability,quality", "trust,value"), ("", "smart compact camera", "", "", "convenience,innovation"), ("plain", "plain", "", "", ""), (None, None, "", "", ""),
], 2)


@query(wanted("shared, own, rival", CLAIMS_W))
def product_positioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes that both products' texts show, and those of either alone."""
    rows = given(spark, sf_dir, "own_text string, rival_text string", CLAIMS)
    a, b = (R.themes(F.lower(F.coalesce(c, F.lit("")))) for c in ("own_text", "rival_text"))
    shown = lambda c: F.array_join(c, ",")
    return rows.select("part", shown(F.array_intersect(a, b)).alias("shared"), shown(F.array_except(a, b)).alias("own"), shown(F.array_except(b, a)).alias("rival"))


SCORES, SCORES_W = _split([(0.95, "excellent"), (0.9, "excellent"), (0.85, "good"), (0.65, "partial"), (0.64, "low"), (0.1, "poor")], 1)


@query(wanted("bucket", SCORES_W))
def quality_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction quality by five bars."""
    return given(spark, sf_dir, "score double", SCORES).select("part", R.quality_bucket(F.col("score")).alias("bucket"))
