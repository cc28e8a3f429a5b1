"""Types, platforms and stores of pages: written cases, and markers against a plain loop."""

import random

import pytest

from shelfscope.functions.platforms import markers
from shelfscope.functions.stores import page_money, ranked_stores, stores, stores_in
from shelfscope.operators.elements import page_arrays, page_tables
from shelfscope.operators.markers import marker_counts
from shelfscope.plans.page_types import page_types_of, platforms


def test_markers_by_a_plain_loop(spark):
    rnd = random.Random(3)
    sought = markers()
    rows = [(i, "".join(rnd.choice([rnd.choice(sought).upper(), "x", " ", "cdn.", "/"]) for _ in range(rnd.randint(0, 30))), rnd.choice([None, "", "https://a.myshopify.com/Products/x"])) for i in range(80)]
    rows += [(80, None, None), (81, "magento" * 30_000, "")]
    got = {(r["id"], r["field"], r["marker"]): r["times"] for r in marker_counts(spark.createDataFrame(rows, "id long, html string, url string").repartition(3), ["id"], ["html", "url"], sought).collect()}
    want = {}
    for i, html, url in rows:
        for field, text in (("html", html), ("url", url)):
            for m in sought:
                if n := sum((text or "").lower().startswith(m, k) for k in range(len(text or ""))) if len(text or "") < 10_000 else (text.count(m)):
                    want[i, field, m] = n
    assert got == want
    assert marker_counts(spark.createDataFrame([], "id long, html string"), ["id"], ["html"], sought).count() == 0


PLATFORMS = [
    ("", "https://x.com", None, "Unknown", "Custom / Undetected", 0.3, False),
    ("<script src='//cdn.shopify.com/a'></script><div data-reactroot>", "u", None, "Shopify", "Shopify", 0.98, True),
    ("/wp-content/ cdn.shopify.com", "u", None, "WordPress", "WordPress", 0.98, False),
    ("cdn.shopify.com myshopify.com wixstatic.com", "u", None, "Shopify", "Shopify", 0.98, False),
    ("", "u", "{'X-Wix-Id': 1}", "Wix", "Wix", 0.98, False),
    ("shopify-section shopify.theme /cart.js", "u", None, "Unknown", "Custom / Undetected", 0.3, False),
    ("vue.js", "u", None, "Unknown", "Custom / Undetected", 0.25, False),
    ("vue.js data-v-1", "u", None, "Unknown", "Vue.js", 0.25, False),
    ("vue.js data-v-1 vuex", "u", None, "Vue", "Vue.js", 0.78, False),
    ("magento", "u", "{'X-Magento': 1}", "Magento", "Magento", 0.9, False),
    ("__next_data__ /_next/static react-dom __react", "u", None, "Next.js / React", "React / Next.js", 0.65, False),
    ("webflow.js w-webflow-badge", "u", None, "Unknown", "Custom / Undetected", 0.3, False),
    ("webflow.js w-webflow-badge", "https://a.webflow.io", None, "Webflow", "Webflow", 0.95, False),
    ("bigcommerce.com stencil-utils __next_data__ next-router", "u", None, "BigCommerce", "BigCommerce", 0.82, True),
    (None, None, None, "Unknown", "Custom / Undetected", 0.3, False),
]


def test_platforms(spark):
    df = spark.createDataFrame([(k, *row[:3]) for k, row in enumerate(PLATFORMS)], "id long, html string, url string, headers string").repartition(3)
    got = {r["id"]: (r["platform"], r["display"], round(float(r["confidence"]), 2), r["headless"]) for r in platforms(df, ["id"]).collect()}
    assert [got[k] for k in range(len(PLATFORMS))] == [row[3:] for row in PLATFORMS]


CARDS = "".join(f"<div class='product-card'><a href='/products/p{k}'>P</a></div>" for k in range(9))
TYPES = [
    ("https://a.com", "<p>x", "homepage", "homepage_path_priority"),
    ("https://a.com/us/en/", "<p>x", "homepage", "homepage_path_priority"),
    ("https://a.com/cart", "", "cart_checkout", "cart_checkout_url"),
    ("https://a.com/our-pricing/", "", "general", "pricing_page_url_priority"),
    ("https://a.com/collections/a/products/b?x", "", "product", "shopify_style_product_url_absolute_priority"),
    ("https://a.com/collections/a", "", "collection", "shopify_style_collection_url_absolute_priority"),
    ("https://a.com/collections/a", "cdn.shopify.com", "collection", "shopify_collection_url_priority"),
    ("https://a.com/blogs/a", "<p>", "blog", "shopify_style_blog_url_absolute_priority"),
    ("https://a.com/shop/serum/", "/wp-content/<body class='single-product'><h1 class='product_title'>S</h1><form class='cart'></form><i class='sku'>", "product", "shop_url_overridden_by_product_evidence"),
    ("https://a.com/shop/serum/", "/wp-content/", "collection", "wordpress_shop_collection_priority"),
    ("https://a.com/category/x/", "/wp-content/" + CARDS, "collection", "wordpress_category_collection_override"),
    ("https://a.com/category/x/", "/wp-content/", "blog", "wordpress_category_url_priority"),
    ("https://a.com/2024/01/02/x", "/wp-content/", "blog", "wordpress_date_url_priority"),
    ("https://a.com/products/", "<a href='/wp-content/x'><h3>a</h3><h3>b</h3><h3>c</h3> 20 g and 50 ml", "general", "consumer_brand_catalog_override"),
    ("https://a.com/contact-us", "", "general", "general_subtype_priority"),
    ("https://a.com/x/day", "<p>A safari tour with guide and pickup", "general", "general_subtype_priority"),
    ("https://a.com/t/shoe/ab-1", "", "product", "nike_product_url_priority"),
    ("https://a.com/stories/x", "", "blog", "blog_url_priority"),
    ("https://a.com/values", "", "general", "informational_page_override_weak_product_signals"),
    ("https://a.com/x/y", "<meta property='og:type' content='product'><script type='application/ld+json'>{\"@type\": \"Product\"}</script>", "product", "product_hard_priority_strong_evidence"),
    ("https://a.com/product/y", "<p>in stock", "product", "product_url_with_product_evidence"),
    ("https://a.com/x/y", "<p>Buy now, add to cart. In stock", "product", "product_family_landing_buying_intent"),
    ("https://a.com/x/y", CARDS, "collection", "collection_signals"),
    ("https://a.com/x/y", "<nav>" + CARDS + "</nav><p>text", "general", "fallback"),  # only the main content counts
    ("https://a.com/x/y", "<main><div class='header'><div>" + CARDS + "</div></div></main>", "general", "fallback"),
    ("https://a.com/pd/y", "<p>q", "product", "product_family_landing_buying_intent_or_fallback"),
    ("https://a.com/category/y", "", "collection", "collection_url_fallback"),
    ("https://a.com/x/y", "", "general", "fallback"),
    (None, None, "homepage", "homepage_path_priority"),
]


@pytest.fixture(scope="module")
def typed(spark):
    df = spark.createDataFrame([(k, *row[:2]) for k, row in enumerate(TYPES)], "id long, url string, html string").repartition(3)
    return {r["id"]: r for r in page_types_of(df, ["id"]).collect()}


def test_types(typed):
    assert len(typed) == len(TYPES)
    for k, (url, html, kind, reason) in enumerate(TYPES):
        assert typed[k]["page_type"] == kind, (url, html, typed[k]["reason"])
        if "_or_" not in reason:
            assert typed[k]["reason"] == reason, (url, html, typed[k]["reason"], typed[k]["found"])


def test_pages_are_judged_where_they_lie(spark):
    df = spark.createDataFrame([(1, "https://a.com/x/y", CARDS)], "id long, url string, html string")
    plan = page_types_of(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert not any(name in plan for name in ("Exchange", "Join", "Window", "Sort [")), plan
    kept = page_types_of(df.selectExpr("*", "'x' AS low"), ["id"], ["low"]).collect()
    assert [(r["id"], r["low"], r["page_type"]) for r in kept] == [(1, "x", "collection")]


def test_scores(typed):
    at = next(k for k, row in enumerate(TYPES) if row[1] == CARDS)
    # nine product links (5 and 4), the grid (6): url and texts add nothing
    assert (typed[at]["collection_score"], typed[at]["product_score"], typed[at]["product_links"]) == (15, 0, 9)
    assert round(float(typed[at]["confidence"]), 3) == 0.98
    hidden = next(k for k, row in enumerate(TYPES) if row[1] and row[1].startswith("<nav>"))
    assert (typed[hidden]["product_links"], typed[hidden]["collection_score"], typed[hidden]["capped"]) == (0, 0, True)


def test_stores(spark):
    html = "<html lang=fr-FR><select name=my_country><option value=DE>D<option value=fr>F</select><a href='/?country=zz'>no</a><a href='?country=se&x'>S</a>"
    df = spark.createDataFrame([(1, "https://a.com/", html), (2, "https://shop.com.pk/x", "<p>Rs. 5"), (3, "https://a.com/x", "<p>€5 EUR then 7 USD 8 USD"), (4, None, None), (5, "https://a.com", "<meta name='currency' content='usd'>")], "id long, url string, html string").repartition(2)
    toks, els = page_tables(df, ["id"])
    ranked, about = stores(df, toks, els, ["id"])
    got = sorted((r["id"], r["rank"], r["country"], r["currency"], r["current"], r["url"]) for r in ranked.collect() if r["country"])
    assert got == [(1, 1, "FR", "EUR", True, "https://a.com/"), (1, 2, "DE", "EUR", False, "https://a.com/?country=DE"), (1, 3, "SE", "SEK", False, "https://a.com/?country=SE"), (2, 1, "PK", "PKR", True, "https://shop.com.pk/x")]
    assert {r["id"]: (r["currency"], r["source"], r["currencies"]) for r in about.collect()} == {1: ("EUR", "cctld_currency", ["EUR", "SEK"]), 2: ("PKR", "cctld_currency", ["PKR"]), 3: ("USD", "visible_currency", ["USD"]), 4: (None, None, []), 5: ("USD", "active_currency", ["USD"])}


def test_stores_are_found_where_pages_lie(spark):
    html = "<html lang=fr-FR><select name=my_country><option value=DE>D<option value=fr>F<option value=DE>again</select><a href='?country=de'>D</a>"
    rows = page_arrays(spark.createDataFrame([(1, "https://a.com/", html, html), (1, None, None, None)], "id long, url string, html string, raw string"), "raw")
    ranked, about = ranked_stores(stores_in(rows), ["id"]), page_money(stores_in(rows), ["id"])
    for df in (ranked, about):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(name in plan for name in ("Exchange", "Join", "Window", "Sort [")), plan
    assert [(r["rank"], r["country"], r["name"], r["current"]) for r in ranked.collect()] == [(1, "FR", "France", True), (2, "DE", "Germany", False)]
    assert [(r["currency"], r["currencies"]) for r in about.collect()] == [("EUR", ["EUR"]), (None, [])]
