"""What kind of page a page is: a table of signals with points, and an ordered table of decisions over their sums.

Signals and decisions are written once, as SQL conditions over a few columns of a page; a Dialect
spells what engines spell differently (regular expressions, lists), so that the oracle reads the same
tables.  Columns: url, path, html (all in lower case), body (text of the page), main (text of its main
content), seo (title, description and first heading), hrefs (links of the main content), headings
(h2 and h3, as they are written), and elements for conditions on markup.
"""

from __future__ import annotations

import re
from collections.abc import Callable

# Word lists of the page types.
TOUR = ["tour", "excursion", "activity", "what to expect", "pickup", "pick-up", "guide", "guided", "itinerary", "duration", "safari", "atv", "quad", "adventure", "bedouin", "book your tour", "reserve your spot"]
SERVICE = ["service", "consultation", "corporate", "workshop", "team building", "event", "application form", "request information", "book a", "request a call", "get quote", "free consultation", "candle part", "group booking", "hire us", "book us", "how it works", "our process", "our services"]
TOOL = ["app", "virtual try-on", "virtual try on", "try-on", "try on", "software", "platform", "dashboard", "3d rendering", "real-time tracking", "augmented reality", "web app", "desktop app"]
ABOUT = ["founder", "our story", "about us", "brand story", "mission", "who we are", "our team"]
COMPARE = ["compare all", "compare models", "compare all models", "view all models", "all models", "explore the lineup", "see all models", "compare ipad", "compare mac", "compare iphone", "compare galaxy", "compare pixel", "compare watch", "which model"]
LANDING_PATHS = ["/women", "/men", "/kids", "/girls", "/boys", "/womens", "/mens", "/juniors", "/baby", "/toddler"]
LANDING_SECTIONS = ["shoes", "clothing", "accessories", "new arrivals", "sale", "tops", "bottoms", "outerwear", "activewear", "sportswear"]
NO_MODEL = ["filter", "sort", "view all", "see all", "shop all", "about", "contact", "menu", "navigation", "shoes", "clothing", "accessories", "new arrivals", "sale", "tops", "bottoms", "outerwear", "activewear", "sportswear", "dresses", "skirts", "jeans", "shorts", "pants", "jackets", "swimwear", "intimates", "rompers", "jumpsuits", "vintage", "brands", "gifts", "home", "beauty", "wellness"]
SERVICE_TEXT = ["our services", "service", "services", "request a call", "get quote", "book consultation", "call us", "how it works", "work process", "our work process", "contact us", "reach out to us"]
INFORMATIONAL = ["/about", "/our-story", "/story", "/mission", "/vision", "/values", "/company", "/who-we-are", "/sustainability", "/career", "/contact", "/faq", "/help", "/support", "/privacy", "/terms", "/shipping", "/delivery", "/returns", "/refund", "/pages/about", "/pages/our-story", "/pages/mission", "/pages/sustainability", "/pages/contact", "/o-nas", "/kontakt", "/dostawa", "/zwroty", "/regulamin", "/polityka-prywatnosci"]
MODERN_PATHS = ["/men", "/women", "/kids", "/sale", "/new-arrivals", "/best-sellers", "/clothing", "/shoes", "/accessories", "/bags", "/beauty", "/skincare", "/makeup", "/hair", "/fragrance", "/electronics", "/speakers", "/headphones", "/pants", "/hoodies", "/jackets"]
SEO_TERMS = ["shop", "collection", "collections", "category", "new arrivals", "best sellers", "sale", "products", "clothing", "shoes", "accessories", "skincare", "makeup", "hair care", "speakers", "headphones"]
LISTING_WORDS = ["filter", "sort by", "shop by", "view all", "color", "size", "gender", "price", "availability"]
PRICING_PATHS = ["/pricing", "/plans", "/packages", "/price-calculator", "/pricing-plans", "/our-pricing", "/compare-plans"]
# Paths of links that lead to products, to neither, and to categories.
PRODUCT_LINKS = ["/product/", "/products/", "/product-page/", "/item/", "/pd/", "/p/", "/t/"]
NO_PRODUCT_LINKS = ["/cart", "/checkout", "/basket", "mailto:", "tel:", "/help", "/support", "/blog/", "/blogs/", "/article/", "/articles/", "/news/", "/guide/", "/shipping", "/returns", "/privacy", "/terms", "/account", "/login", "/register"]
CATEGORY_LINKS = ["/collections/", "/collection/", "/product-category/", "/category/", "/categories/", "/shop/", "/store/", "/catalog/", "/c/", "/men", "/women", "/kids", "/sale", "/new-arrivals", "/best-sellers", "/clothing", "/shoes", "/accessories", "/bags", "/beauty", "/skincare", "/makeup", "/hair", "/fragrance", "/electronics", "/speakers", "/headphones"]
# Markup, as (tag or none, attribute, how, value); how is = (equal, or one of the classes), * (holds) or ? (is there).
GRID = [(None, "class", "=", c) for c in ("products", "woocommerce-products", "product-grid", "product-list", "collection-grid", "collection-list", "grid-product")] + [(None, "class", "*", c) for c in ("product-card", "product-grid", "product-tile", "product-item")] + [(None, "data-hook", "*", "product-list"), (None, "data-hook", "*", "product-grid"), (None, "data-testid", "*", "product"), (None, "data-product-id", "?", "")]
CARDS = [(None, "class", "*", "product-grid"), (None, "class", "*", "product-card"), (None, "data-product-id", "?", ""), (None, "class", "=", "product-tile"), (None, "class", "=", "grid-product"), (None, "class", "=", "wc-block-grid__product"), (None, "class", "=", "woocommerce-loop-product__title")]
TO_CART = [("form", "class", "=", "cart"), (None, "class", "=", "single_add_to_cart_button"), ("button", "name", "=", "add-to-cart"), (None, "data-hook", "*", "add-to-cart"), ("form", "action", "*", "/cart/add"), ("button", "class", "*", "add-to-cart"), ("button", "class", "*", "add_to_cart")]
BUYING = [*TO_CART, (None, "class", "=", "product-form"), ("input", "name", "=", "quantity"), ("select", "name", "=", "id"), (None, "name", "=", "quantity"), (None, "class", "*", "variant"), (None, "data-product-form", "?", "")]
ATTRIBUTES = ["class", "id", "name", "data-hook", "data-testid", "action", "property", "content"]
FLAGS = ["data-product-id", "data-product-form"]
#: Signals that count as strong evidence of a product.
STRONG = "nike_product_url jsonld_product og_type_product price_meta product_body_class product_title_dom add_to_cart_dom product_page_dom stock_sku_dom product_tabs wp_product_endpoint wix_product_attributes sku_model_text web_code_text explicit_sku_text ship_availability_text sold_shipped_by_text".split()


def alternation(terms: list[str]) -> str:
    """A pattern for any of the terms, in both engines' syntax."""
    return "|".join(re.sub(r"([.+*?()|\[\]{}^$\\])", r"\\\1", t) for t in terms)


class Dialect:
    """How Spark spells the conditions."""

    def q(self, text: str) -> str:
        return "r\"" + text.replace('"', "\\x22") + '"'

    def matches(self, column: str, pattern: str) -> str:
        return f"regexp_like({column}, {self.q(pattern)})"

    def extract(self, column: str, pattern: str) -> str:
        return f"regexp_extract({column}, {self.q(pattern)}, 1)"

    def count(self, column: str, pattern: str) -> str:
        return f"regexp_count({column}, {self.q(pattern)})"

    def different(self, column: str, test: Callable[[str], str], cut: str) -> str:
        """Number of different texts of a list that pass a test, cut by a pattern."""
        return f"size(array_distinct(transform(filter({column}, h -> {test('h')}), h -> regexp_replace(h, {self.q(cut)}, ''))))"

    def number(self, column: str, test: Callable[[str], str]) -> str:
        return f"size(filter({column}, h -> {test('h')}))"

    def markup(self, specs: list[tuple], scoped: bool = False) -> str:
        def one(tag: str | None, attribute: str, how: str, value: str) -> str:
            name = attribute.replace("-", "_")
            test = f"e.{name}" if how == "?" else f"contains(e.{name}, '{value}')" if how == "*" else f"array_contains(split(e.{name}, ' '), '{value}')" if attribute == "class" else f"e.{name} = '{value}'"
            return test if tag is None else f"(e.tag = '{tag}' AND {test})"

        return f"exists(elements, e -> {'e.scoped AND ' if scoped else ''}({' OR '.join(one(*s) for s in specs)}))"

    def listed(self, items: list[str]) -> str:
        return f"array_compact(array({', '.join(items)}))"

    def holds(self, column: str, value: str) -> str:
        return f"array_contains({column}, '{value}')"

    # What is the same in both.
    def any(self, column: str, terms: list[str]) -> str:
        return self.matches(column, alternation(terms))

    def hits(self, column: str, terms: list[str]) -> str:
        """How many of the terms the text holds."""
        return "(" + " + ".join(f"CAST({self.matches(column, alternation([t]))} AS INT)" for t in terms) + ")"


class DuckDialect(Dialect):
    """How DuckDB spells them; markup is sought by patterns in html (whole) and main_html."""

    def q(self, text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def matches(self, column: str, pattern: str) -> str:
        return f"regexp_matches({column}, {self.q(pattern)})"

    def count(self, column: str, pattern: str) -> str:
        return f"len(regexp_extract_all({column}, {self.q(pattern)}))"

    def different(self, column: str, test: Callable[[str], str], cut: str) -> str:
        return f"len(list_distinct(list_transform(list_filter({column}, lambda h: {test('h')}), lambda h: regexp_replace(h, {self.q(cut)}, ''))))"

    def number(self, column: str, test: Callable[[str], str]) -> str:
        return f"len(list_filter({column}, lambda h: {test('h')}))"

    def markup(self, specs: list[tuple], scoped: bool = False) -> str:
        def one(tag: str | None, attribute: str, how: str, value: str) -> str:
            start = rf"<{tag or '[a-z][a-z0-9]*'}\s(?:[^>]*\s)?{attribute}"
            return start if how == "?" else rf"{start}=\"[^\"]*{value}" if how == "*" else rf"{start}=\"(?:[^\"]* )?{value}[ \"]" if attribute == "class" else rf"{start}=\"{value}\""

        return "(" + " OR ".join(self.matches("main_html" if scoped else "html", one(*s).replace('\\"', '"')) for s in specs) + ")"

    def listed(self, items: list[str]) -> str:
        return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"

    def holds(self, column: str, value: str) -> str:
        return f"list_contains({column}, '{value}')"


def measures(d: Dialect) -> dict[str, str]:
    """Counts that signals and decisions use."""
    ends = "[?#].*$|/+$"
    money = r"[$£€]\s*\d+|\d+\s*(?:usd|eur|gbp)"
    return {
        "bare": d.extract("path", "^(.*?)/*$"),
        "shop_parts": d.count(d.extract("url", "/shop/(.*)$"), "[^/]+"),
        "product_links": d.different("hrefs", lambda h: f"{d.any(h, PRODUCT_LINKS)} AND NOT {d.any(h, NO_PRODUCT_LINKS)}", ends),
        "category_links": d.different("hrefs", lambda h: d.any(h, CATEGORY_LINKS), ends),
        "catalog_slugs": d.different("hrefs", lambda h: f"{d.matches(h, '/collection/[^/?#]+')} AND NOT {d.any(h, ['/collections/'])}", "^.*/collection/|[/?#].*$"),
        "price_texts": d.count("main", r"[$£€]\s?\d+(?:[,.]\d{1,2})?|\b(?:rs|pkr|aed|usd)\s?\d+(?:[,.]\d{1,2})?"),
        "seo_hits": d.hits("seo", SEO_TERMS),
        "listing_hits": d.hits("main", LISTING_WORDS),
        "facets": d.count("body", r"[a-z][a-z\s\-]{2,40}\(\d{1,4}\)"),
        "price_ranges": d.count("body", r"under\s+[$£€]\d+|[$£€]\d+\s*[-–]\s*[$£€]\d+|over\s+[$£€]\d+"),
        "wix_attributes": d.count("body", r"\b(?:color|colour|material|shape|size|brand|style|lens|frame|sku|collection)\s*\*"),
        "wix_sections": d.hits("body", ["product info", "virtual try-on", "find a store near you", "find a retailer", "store locator", "product details"]),
        "money_texts": d.count("body", money),
        "calls": f"({d.count('body', r'\bbuy\b')} + {d.count('body', 'learn more')})",
        "models": d.number("headings", lambda h: f"{d.matches(h, r'^[A-ZÀ-ÖØ-Þ]')} AND {d.matches(h, r'^\S+(?: \S+){0,5}$')} AND NOT {d.any(f'lower({h})', NO_MODEL)}"),
        "section_heads": d.number("heads2", lambda h: d.any(h, LANDING_SECTIONS)),
        "sizes": d.count("html", r"\b\d+\s*(?:g|ml|oz|lb|lbs|kg)\b"),
        "h3s": d.count("html", "<h3"),
    }


def signals(d: Dialect) -> list[tuple[str, int | str, str, str]]:
    """(family, points, signal, condition); a signal's points count once."""
    url_rule = lambda term: f"{d.any('url', [term])} AND NOT {d.matches('bare', alternation([term.rstrip('/')]) + '$')}"
    found: list[tuple[str, int | str, str, str]] = [("product", 18, "nike_product_url", d.matches("path", "/t/[^/]+/[a-z0-9-]+$"))]
    # Points of product signals.
    for term, points, name in (("/product/", 6, "url_product"), ("/products/", 6, "url_products"), ("/product-page/", 6, "url_wix_product_page"), ("/item/", 4, "url_item"), ("/pd/", 6, "url_pd"), ("/p/", 5, "url_p"), ("/t/", 4, "url_t")):
        found.append(("product", points, name, url_rule(term)))
    found += [
        ("product", 5, "deep_shop_product_url", f"{d.any('url', ['/shop/'])} AND shop_parts >= 2"),
        ("product", 2, "possible_shop_product_url", f"{d.any('url', ['/shop/'])} AND shop_parts = 1"),
        ("product", 7, "og_type_product", d.matches("html", r"<meta\s[^>]*(?:property|name)=.og:type.[^>]*content=.product.")),
        ("product", 6, "price_meta", d.matches("html", r"<meta\s[^>]*property=.(?:product:price:amount|og:price:amount|price:amount).[^>]*content=.[^>\s]")),
        ("product", 7, "product_body_class", d.markup([("body", "class", "*", c) for c in ("single-product", "post-type-product", "product-template-default", "template-product")])),
        ("product", 4, "product_title_dom", d.markup([(None, "class", "=", "product_title"), (None, "class", "*", "product-title")])),
        ("product", 7, "add_to_cart_dom", d.markup(TO_CART)),
        ("product", 5, "product_page_dom", d.markup([(None, "class", "=", c) for c in ("woocommerce-product-gallery", "product-single", "product__info", "product-form")] + [(None, "data-hook", "*", "product-page")])),
        ("product", 3, "stock_sku_dom", d.markup([(None, "class", "=", c) for c in ("stock", "availability", "posted_in")] + [(None, "data-hook", "*", "sku"), (None, "class", "*", "sku")])),
        ("product", 3, "product_tabs", d.markup([(None, "class", "=", "woocommerce-tabs"), (None, "id", "=", "tab-description"), (None, "class", "=", "woocommerce-tabs-panel"), (None, "class", "=", "product-tabs")])),
        ("product", 8, "jsonld_product", d.matches("html", r"application/ld\+json[^<]*\x22@type\x22\s*:\s*(?:\[[^\]]*)?\x22product\x22")),
        ("product", 7, "wp_product_endpoint", d.any("html", ["/wp-json/wp/v2/product/", "/wp/v2/product/"])),
        ("product", 4, "add_to_cart_text", d.any("body", ["add to cart", "buy now", "add to bag", "add to basket"])),
        ("product", 2, "stock_text", d.any("body", ["in stock", "out of stock", "sold out", "availability"])),
        ("product", 2, "product_content_sections", f"{d.any('body', ['description'])} AND {d.any('body', ['ingredients', 'how to use', 'specifications', 'sku', 'style:'])}"),
        ("product", 6, "sku_model_text", d.matches("body", r"\bmodel\s*[:#]\s*[a-z0-9][a-z0-9\-]{3,}")),
        ("product", 6, "web_code_text", d.matches("body", r"\bweb\s*code\s*[:#]?\s*\d{5,}")),
        ("product", 5, "explicit_sku_text", d.matches("body", r"\b(?:sku|item\s*(?:no|number|#))\s*[:#]\s*[a-z0-9\-]{4,}")),
        ("product", 4, "ship_availability_text", d.matches("body", r"\bavailable\s+to\s+ship\b")),
        ("product", 3, "sold_shipped_by_text", d.matches("body", r"\b(?:sold\s+and\s+shipped\s+by|fulfilled\s+by)\b")),
        ("product", 8, "wix_product_attributes", "wix_attributes >= 2"),
        ("product", 3, "wix_product_attribute", "wix_attributes = 1"),
        ("product", 4, "wix_product_sections", "wix_sections >= 2"),
        ("product", 2, "wix_product_section", "wix_sections = 1"),
    ]
    # Points of collection signals; of the first ones by url only one counts.
    before: list[str] = []
    for term, points, name in (("/collections/", 7, "url_collections"), ("/collection/", 6, "url_collection"), ("/product-category/", 7, "url_product_category"), ("/category/", 5, "url_category"), ("/categories/", 5, "url_categories"), ("/store/", 4, "url_store"), ("/catalog/", 4, "url_catalog"), ("/c/", 4, "url_c")):
        found.append(("collection", points, name, d.any("url", [term]) + (f" AND NOT {d.any('url', before)}" if before else "")))
        before = [*before, term]
    found += [
        ("collection", 7, "shop_listing_url", d.matches("path", "/shop$|^/shop/*$")),
        ("collection", 4, "shop_category_url", f"{d.any('url', ['/shop/'])} AND shop_parts = 1"),
        ("collection", 3, "modern_collection_url", d.any("path", MODERN_PATHS)),
        ("collection", "least(4, seo_hits)", "seo_collection_terms", "seo_hits >= 1"),
        ("collection", 6, "woocommerce_collection_signal", d.any("html", ["product_cat", "woocommerce-loop-product"])),
        ("collection", 6, "product_grid_dom", d.markup(GRID, True)),
        ("collection", 4, "sort_filter_dom", d.markup([("select", "class", "=", "orderby"), (None, "class", "=", "woocommerce-ordering"), (None, "data-hook", "*", "sort"), (None, "class", "*", "sort-by"), (None, "class", "*", "filter")], True)),
        ("collection", 5, "showing_x_of_y_text", d.matches("main", r"showing\s+\d+\s*[–-]\s*\d+\s+of\s+\d+")),
        ("collection", 5, "multiple_product_links", "product_links >= 3"),
        ("collection", 4, "high_product_link_density", "product_links >= 8"),
        ("collection", 2, "category_link_density_medium", "category_links >= 8"),
        ("collection", 3, "category_link_density_high", "category_links >= 15"),
        ("collection", 4, "multiple_price_texts", "price_texts >= 3"),
        ("collection", 3, "ecommerce_collection_wording", "listing_hits >= 2"),
        ("collection", 6, "filter_sort_ui", f"{d.any('main', ['filter by'])} AND {d.any('main', ['sort by'])}"),
        ("collection", 5, "wix_collection_product_links", "catalog_slugs >= 5"),
        ("collection", 4, "wix_load_more_or_paginated", f"{d.any('main', ['load more', 'show more'])} OR {d.number('hrefs', lambda h: d.matches(h, r'[?&]page=\d+'))} > 0"),
        ("collection", 7, "text_filter_results", d.matches("body", r"\bfilter\s+results\b")),
        ("collection", 5, "text_product_facet_counts", "facets >= 3"),
        ("collection", 2, "text_product_facet_hint", "facets BETWEEN 1 AND 2"),
        ("collection", 3, "text_price_range_facets", "price_ranges >= 2"),
        ("collection", 3, "text_sort_by", d.matches("body", r"\bsort\s+by\b")),
        ("collection", 3, "text_result_count", d.matches("body", r"\b\d+\s+(?:results?|products?|items?)\b")),
        ("collection", 4, "text_showing_x_of_y", d.matches("body", r"showing\s+\d+\s*[–\-]\s*\d+\s+of\s+\d+")),
        # Points of blog signals.
        ("blog", 6, "blog_url", d.any("url", ["/blog/", "/blogs/", "/post/", "/posts/", "/article/", "/articles/", "/news/", "/insights/", "/resources/"])),
        ("blog", 4, "blog_listing_url", d.matches("bare", "^/(?:blog|blogs|news|articles|resources|insights)$")),
        ("blog", 6, "wp_date_url", d.matches("path", r"/\d{4}/\d{2}/\d{2}/")),
        ("blog", 1, "og_type_article", d.matches("html", r"<meta\s[^>]*property=.og:type.[^>]*content=.(?:article|blog).")),
        ("blog", 1, "article_jsonld", d.matches("html", r"application/ld\+json[^<]*\x22@type\x22\s*:\s*(?:\[[^\]]*)?\x22(?:article|blogposting|newsarticle)\x22")),
        ("blog", 1, "article_dom", f"{d.matches('html', r'<article[\s>]')} OR {d.markup([(None, 'class', '=', 'post'), (None, 'class', '*', 'blog'), (None, 'class', '*', 'article')])}"),
        ("blog", 2, "blog_text_terms", d.any("body", ["published on", "posted on", "read time", "min read", "author"])),
    ]
    return found


def sums(d: Dialect) -> dict[str, str]:
    """What follows from found (the signals): scores and verdicts by family, kinds of general pages."""
    has = lambda *names: "(" + " OR ".join(d.holds("found", n) for n in names) + ")"
    structure = f"({has('product_grid_dom', 'showing_x_of_y_text', 'sort_filter_dom', 'filter_sort_ui', 'wix_collection_product_links', 'text_filter_results', 'text_product_facet_counts', 'text_price_range_facets', 'text_sort_by', 'text_result_count', 'text_showing_x_of_y')} OR product_links >= 5 OR (price_texts >= 3 AND product_links >= 3) OR ({has('wix_load_more_or_paginated')} AND product_links >= 3))"
    unsorted = f"NOT {d.any('body', ['sort by', 'filter by', 'filter results', 'default sorting'])} AND NOT {d.markup(CARDS)}"
    strong = "(" + " + ".join(f"CAST({d.holds('found', s)} AS INT)" for s in STRONG) + ")"
    family = f"({d.any('body', COMPARE)} OR calls >= 6) AND money_texts <= 15 AND models >= 3 AND {unsorted}"
    landing = f"({d.matches('bare', '^(?:' + '|'.join(LANDING_PATHS) + ').{0,3}$')} OR section_heads >= 2) AND money_texts <= 20 AND {unsorted}"
    service_path = ["/service", "/services", "/solution", "/solutions", "/automation", "/installation", "/consulting", "/agency", "/support", "/workshop", "/events"]
    return {
        "product_score": "points_product",
        "collection_score": f"CASE WHEN {structure} THEN points_collection ELSE least(points_collection, 4) END",
        "capped": f"NOT {structure}",
        "blog_score": "points_blog",
        "is_blog": f"{has('blog_url', 'blog_listing_url', 'wp_date_url')} OR (points_blog >= 7 AND NOT {d.any('body', SERVICE_TEXT)} AND {has('article_dom', 'blog_text_terms')})",
        "strong": f"{strong} >= 2 OR ({strong} >= 1 AND points_product >= 18)",
        "buying": f"{d.markup(BUYING)} OR {d.any('html', ['add-to-cart', 'add_to_cart', '/cart/add', 'product-form', 'productform', 'variant-picker', 'variant-selector', 'quantity-selector', 'name=' + chr(34) + 'quantity', 'data-product-form'])} OR {d.any('body', ['add to cart', 'add to bag', 'add to basket', 'buy now', 'choose size', 'select size', 'quantity'])}",
        # The first that holds, as in the table.
        "subtype": f"""CASE WHEN {d.any('bare', ['/contact', '/get-in-touch'])} THEN 'contact' WHEN {d.any('bare', ['/about', '/our-story', '/story', '/company', '/who-we-are'])} THEN 'about'
            WHEN {d.any('bare', ['/pricing', '/plans', '/packages'])} THEN 'pricing' WHEN {d.any('bare', ['/faq'])} THEN 'faq' WHEN {d.any('bare', ['/privacy', '/terms', '/refund', '/shipping', '/returns', '/delivery'])} THEN 'legal'
            WHEN {family} THEN 'product_family_landing' WHEN {landing} THEN 'category_landing' WHEN {d.hits('body', TOUR)} >= 3 THEN 'tour_page' WHEN {d.hits('body', TOOL)} >= 2 THEN 'tool_app_page' WHEN {d.hits('body', ABOUT)} >= 2 THEN 'about'
            WHEN {d.any('bare', service_path)} OR {d.hits('body', SERVICE)} >= 2 THEN 'service_page' WHEN {d.hits('body', ['get started', 'start now', 'why choose', 'trusted by'])} >= 2 THEN 'landing_page' ELSE 'unknown' END""",
    }


def decisions(d: Dialect) -> list[tuple[str, str, str, str]]:
    """(condition, type, confidence, reason) in order: the first that holds decides."""
    has = lambda *names: "(" + " OR ".join(d.holds("found", n) for n in names) + ")"
    path = lambda *terms: d.any("path", list(terms))
    on = lambda name, test: f"{d.any('platform_name', [name])} AND {test}"
    shop = d.matches("path", "^/shop/*$|^/shop/")
    override = f"(collection_score >= 6 AND ({has('multiple_product_links', 'high_product_link_density', 'product_grid_dom', 'sort_filter_dom')} OR product_links >= 3))"
    proven = f"product_score >= 20 AND {has('product_body_class')} AND {has('add_to_cart_dom', 'stock_sku_dom', 'product_tabs')}"
    blog_like = path("/blog", "/post", "/article", "/news")
    locale = "[a-z]{2}([-_][a-z]{2})?"
    only_attributes = f"(points_product = 3 * CAST({has('wix_product_attribute')} AS INT) + 8 * CAST({has('wix_product_attributes')} AS INT) + 2 * CAST({has('wix_product_section')} AS INT) + 4 * CAST({has('wix_product_sections')} AS INT))"
    filtered = f"(collection_score >= 15 AND {has('filter_sort_ui')} AND ({has('wix_collection_product_links', 'wix_load_more_or_paginated')} OR product_links >= 5) AND {only_attributes})"
    product = f"(product_score >= 6 AND NOT {filtered})"
    catalog = f"{path('/products/')} AND NOT {d.matches(d.extract('path', '/products/(.*)$'), '^/*[^/]{3,}/*$')} AND {d.any('html', ['wp-content'])} AND NOT {d.any('html', ['add-to-cart', 'add_to_cart', '/cart/add', 'add to cart', 'buy now'])} AND NOT {d.matches('html', r'(?:^|[^a-z])(?:[$£€₹]|rs\.?)\s*\d')} AND sizes >= 2 AND h3s >= 3"
    steep = lambda base, step, top, score: f"least({top}, {base} + {score} * {step})"
    # Order, confidences and reasons of the decisions.
    return [
        (d.matches("path", f"^/*(?:{locale}|{locale}/+{locale}|{locale}/+(?:home\\.html|home|index\\.html|index|homepage))?/*$"), "homepage", "0.98", "homepage_path_priority"),
        (path("/cart", "/checkout", "/basket"), "cart_checkout", "0.99", "cart_checkout_url"),
        (catalog, "general", "0.88", "consumer_brand_catalog_override"),
        (d.matches("bare", f"(?:{alternation(PRICING_PATHS)})$") + " OR " + d.matches("path", f"(?:{alternation(PRICING_PATHS)})/"), "general", "0.92", "pricing_page_url_priority"),
        (on("shopify", path("/products/")), "product", "0.99", "shopify_product_url_priority"),
        (on("shopify", path("/collections/")), "collection", "0.99", "shopify_collection_url_priority"),
        (on("shopify", path("/blogs/")), "blog", "0.95", "shopify_blog_url_priority"),
        (on("shopify", path("/pages/")), "general", "0.92", "shopify_page_url_priority"),
        (on("woocommerce", path("/product/")), "product", "0.99", "woocommerce_product_url_priority"),
        (on("woocommerce", path("/product-category/")), "collection", "0.98", "woocommerce_product_category_priority"),
        (on("woocommerce", f"{shop} AND {proven}"), "product", "0.9", "shop_url_overridden_by_product_evidence"),
        (on("woocommerce", shop), "collection", "0.96", "woocommerce_shop_url_priority"),
        (on("wordpress", path("/product/")), "product", "0.96", "wordpress_product_url_priority"),
        (on("wordpress", f"({path('/product-category/')} OR {shop}) AND {proven}"), "product", "0.9", "shop_url_overridden_by_product_evidence"),
        (on("wordpress", f"({path('/product-category/')} OR {shop})"), "collection", "0.94", "wordpress_shop_collection_priority"),
        (on("wordpress", d.matches("path", r"/\d{4}/\d{2}/\d{2}/")), "blog", "0.94", "wordpress_date_url_priority"),
        (on("wordpress", path("/blog/", "/post/", "/article/", "/news/")), "blog", "0.94", "wordpress_blog_url_priority"),
        (on("wordpress", f"{path('/category/')} AND {override}"), "collection", "0.92", "wordpress_category_collection_override"),
        (on("wordpress", path("/category/")), "blog", "0.82", "wordpress_category_url_priority"),
        (on("wix", path("/product-page/")), "product", "0.98", "wix_product_page_url_priority"),
        (on("wix", f"({path('/category/')} OR {d.matches('path', '^/shop/*$|^/shop[/-]')})"), "collection", "0.9", "wix_collection_url_priority"),
        (on("wix", path("/blog/", "/post/")), "blog", "0.92", "wix_blog_url_priority"),
        (on("webflow", path("/product/", "/products/")), "product", "0.9", "webflow_product_url_priority"),
        (on("webflow", path("/collection/", "/collections/", "/category/", "/shop/")), "collection", "0.86", "webflow_collection_url_priority"),
        (on("webflow", path("/blog/", "/post/", "/article/", "/news/")), "blog", "0.9", "webflow_blog_url_priority"),
        (path("/products/"), "product", "0.99", "shopify_style_product_url_absolute_priority"),
        (path("/collections/"), "collection", "0.99", "shopify_style_collection_url_absolute_priority"),
        (path("/blogs/"), "blog", "0.95", "shopify_style_blog_url_absolute_priority"),
        (path("/pages/"), "general", "0.92", "shopify_style_page_url_absolute_priority"),
        (f"subtype = 'pricing' AND NOT {blog_like}", "general", "0.94", "general_subtype_priority"),
        (f"NOT {blog_like} AND (subtype IN ('product_family_landing', 'category_landing') OR (subtype IN ('service_page', 'tour_page', 'tool_app_page', 'about', 'contact', 'faq', 'legal') AND product_score < 6))", "general", "0.94", "general_subtype_priority"),
        (f"{has('nike_product_url')} AND product_score >= 10", "product", "0.97", "nike_product_url_priority"),
        (f"{path('/blog', '/newsroom', '/news', '/stories', '/story', '/article', '/post', '/insights', '/resources')} AND product_score < 6", "blog", "0.95", "blog_url_priority"),
        (f"{d.any('bare', INFORMATIONAL)} AND NOT strong", "general", "0.96", "informational_page_override_weak_product_signals"),
        (f"{product} AND (strong OR (product_score >= 14 AND buying AND {has('url_product', 'url_products', 'deep_shop_product_url', 'url_wix_product_page', 'url_pd', 'url_p', 'url_t', 'nike_product_url')}) OR ({has('wix_product_attributes')} AND product_score >= 10 AND NOT (collection_score >= 18 OR product_links >= 30 OR price_texts >= 20)))", "product", steep(0.74, 0.02, 0.99, "product_score"), "product_hard_priority_strong_evidence"),
        (f"{path('/product/')} AND {product}", "product", steep(0.75, 0.02, 0.95, "product_score"), "product_url_with_product_evidence"),
        (f"{product} AND capped AND buying", "product", steep(0.7, 0.02, 0.85, "product_score"), "product_family_landing_buying_intent"),
        ("collection_score >= 6", "collection", steep(0.72, 0.025, 0.98, "collection_score"), "collection_signals"),
        ("is_blog", "blog", steep(0.72, 0.025, 0.95, "blog_score"), "blog_signals"),
        (path("/product/", "/item/", "/p/", "/pd/"), "product", "0.75", "product_url_fallback"),
        (f"{path('/collection/', '/category/', '/product-category/')} AND NOT ({d.any('platform_name', ['wix'])} AND {path('/collection/')} AND NOT {path('/collections/')})", "collection", "0.75", "collection_url_fallback"),
        (path("/blog", "/news", "/stories", "/articles", "/resources"), "blog", "0.82", "blog_url_fallback"),
        ("TRUE", "general", "0.9", "fallback"),
    ]


def decided(d: Dialect) -> str:
    """SQL: the number of the first decision that holds."""
    return "CASE " + " ".join(f"WHEN {test} THEN {k}" for k, (test, *_) in enumerate(decisions(d))) + " END"


def by_number(d: Dialect, what: int) -> str:
    """SQL: type (1), confidence (2) or reason (3) of decision ``stage``."""
    shown = lambda x: x if what == 2 else f"'{x}'"
    return "CASE stage " + " ".join(f"WHEN {k} THEN {shown(row[what])}" for k, row in enumerate(decisions(d))) + " END"


def points(d: Dialect, family: str) -> str:
    """SQL: the sum of a family's points over found."""
    return " + ".join(f"CASE WHEN {d.holds('found', name)} THEN {value} ELSE 0 END" for f, value, name, _ in signals(d) if f == family)
