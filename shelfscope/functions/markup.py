"""What pages and JSON texts tell; column functions in the JVM, and three small helpers over nested JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .text import strip_html

# Parts of paths that tell product and category links, and those that tell neither.
PRODUCT_PATHS = ["/product/", "/products/", "/product-page/", "/item/", "/pd/", "/p/", "/t/"]
NO_PRODUCT = ["/cart", "/checkout", "/basket", "mailto:", "tel:", "/help", "/support", "/blog/", "/blogs/", "/article/", "/articles/", "/news/", "/guide/", "/shipping", "/returns", "/privacy", "/terms", "/account", "/login", "/register"]
CATEGORY_PATHS = [
    "/collections/", "/collection/", "/product-category/", "/category/", "/categories/", "/shop/", "/store/", "/catalog/", "/c/", "/men", "/women", "/kids", "/sale", "/new-arrivals", "/best-sellers", "/clothing", "/shoes", "/accessories", "/bags",
    "/beauty", "/skincare", "/makeup", "/hair", "/fragrance", "/electronics", "/speakers", "/headphones",
]
GRID_NAMES = r"(?i)<[^>]*\b(?:class=[\"'][^\"']*(?:\bproducts\b|woocommerce-products|product-grid|product-list|collection-grid|collection-list|grid-product|product-card|product-tile|product-item)|data-hook=[\"'][^\"']*product-(?:list|grid)|data-testid=[\"'][^\"']*product|data-product-id)"
#: Elements that are no main content.
_CHROME = r"(?is)<(header|nav|footer|aside|script|style|form|template)\b.*?</\1\s*>"
_TAG = "(?s)<[^>]*>"


def one(html: Column, pattern: str) -> Column:
    """What the first group of the first match holds; null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(html, pattern, 1)), F.lit(""))


def every(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), F.lit(group))


def meta(html: Column, name: str) -> Column:
    return one(html, rf"(?is)<meta\b[^>]*\b(?:name|property)=[\"']{name}[\"'][^>]*\bcontent=[\"']([^\"']*)[\"']")


def open_graph(html: Column) -> Column:
    """og: properties as a map, the last one of a name wins."""
    pattern = r"(?is)<meta\b[^>]*\bproperty=[\"']og:([^\"']+)[\"'][^>]*\bcontent=[\"']([^\"']*)[\"']"
    pairs = F.arrays_zip(every(html, pattern).alias("k"), every(html, pattern, 2).alias("v"))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))


def canonical(html: Column) -> Column:
    return one(html, r"(?is)<link\b[^>]*\brel=[\"']canonical[\"'][^>]*\bhref=[\"']([^\"']*)[\"']")


def links(html: Column) -> Column:
    """All links as (url, text) in page order."""
    pattern = r"(?is)<a\b[^>]*\bhref=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    pairs = F.arrays_zip(every(html, pattern).alias("url"), every(html, pattern, 2).alias("text"))
    return F.transform(pairs, lambda p: F.struct(p["url"].alias("url"), F.trim(F.regexp_replace(F.regexp_replace(p["text"], _TAG, " "), r"\s+", " ")).alias("text")))


def navigation(html: Column, limit: int = 50) -> Column:
    """Links of all nav and header elements, each once, the first 50."""
    within = F.array_join(every(html, r"(?is)<(?:nav|header)\b[^>]*>(.*?)</(?:nav|header)>"), " ")
    return F.slice(F.array_distinct(F.filter(links(within), lambda x: x["text"] != "")), 1, limit)


def footer_links(html: Column) -> Column:
    return links(F.array_join(every(html, r"(?is)<footer\b[^>]*>(.*?)</footer>"), " "))


def main_html(html: Column) -> Column:
    """The main element, else the body, without menus, headers, footers, scripts and forms."""
    body = F.coalesce(one(html, r"(?is)<main\b[^>]*>(.*)</main>"), one(html, r"(?is)<body\b[^>]*>(.*)</body>"), html)
    return F.regexp_replace(F.regexp_replace(body, _CHROME, " "), _CHROME, " ")


def headings(html: Column, limit: int = 60) -> Column:
    """Texts of h1 to h3, the first 60."""
    found = every(html, r"(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]>")
    return F.slice(F.filter(F.transform(found, lambda h: F.trim(F.regexp_replace(F.regexp_replace(h, _TAG, " "), r"\s+", " "))), lambda h: h != ""), 1, limit)


def text_evidence(html: Column) -> Column:
    """full, top (its first 600 letters), hero (first h1 and the paragraph after it), footer."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|template)\b.*?</\1\s*>", " ")
    full = strip_html(bare)
    hero = F.concat_ws(" ", one(html, r"(?is)<h1\b[^>]*>(.*?)</h1>"), one(html, r"(?is)</h1>\s*<p\b[^>]*>(.*?)</p>"))
    return F.struct(full.alias("full"), F.left(full, F.lit(600)).alias("top"), strip_html(hero).alias("hero"), strip_html(F.array_join(every(html, r"(?is)<footer\b[^>]*>(.*?)</footer>"), " ")).alias("footer"))


def _hrefs(html: Column) -> Column:
    return F.transform(every(html, r"(?is)<a\b[^>]*\bhref=[\"']([^\"']*)[\"']"), F.lower)


def _holds(x: Column, terms: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(x, t))


def product_links(html: Column) -> Column:
    """How many different product links there are, without query and fragment."""
    found = F.filter(_hrefs(html), lambda h: _holds(h, PRODUCT_PATHS) & ~_holds(h, NO_PRODUCT))
    return F.size(F.array_distinct(F.transform(found, lambda h: F.regexp_replace(F.regexp_replace(h, "[?#].*$", ""), "/+$", ""))))


def category_links(html: Column) -> Column:
    bare = F.transform(_hrefs(html), lambda h: F.regexp_replace(F.regexp_replace(h, "[?#].*$", ""), "/+$", ""))
    return F.size(F.array_distinct(F.filter(bare, lambda h: _holds(h, CATEGORY_PATHS))))


def product_grid(html: Column) -> Column:
    return F.regexp_like(html, F.lit(GRID_NAMES))


def shown_count(html: Column) -> Column:
    """N of "Showing N products" or "Showing 1-20 of N results"."""
    found = F.regexp_extract(strip_html(html), r"(?i)showing\s+(?:all\s+)?(?:[0-9,]+\s*(?:–|—|-|to)\s*[0-9,]+\s+of\s+)?([0-9,]+)\s+(?:products|results|items)", 1)
    return F.replace(found, F.lit(","), F.lit("")).try_cast("int")


def hreflang(html: Column, limit: int = 60) -> Column:
    """Alternates with a country as (code, country, url), the first of each country."""
    tags = every(html, r"(?is)<link\b[^>]*rel=[\"']?alternate[\"']?[^>]*>", 0)
    found = F.transform(tags, lambda t: F.struct(F.lower(F.regexp_extract(t, r"hreflang=[\"']?([a-zA-Z-]+)", 1)).alias("code"), F.regexp_extract(t, r"\bhref=[\"']([^\"']+)[\"']", 1).alias("url")))
    found = F.filter(found, lambda x: (x["url"] != "") & (x["code"] != "x-default") & F.contains(x["code"], F.lit("-")))
    named = F.transform(found, lambda x: F.struct(x["code"].alias("code"), F.upper(F.element_at(F.split(x["code"], "-"), -1)).alias("country"), x["url"].alias("url")))
    return F.slice(F.filter(named, lambda x, k: F.array_position(F.transform(named, lambda y: y["country"]), x["country"]) == k + 1), 1, limit)


def plan_cards(html: Column) -> Column:
    """Cards whose class names a plan, with title, price text and number of features; none if there is only one."""
    cards = every(html, r"(?is)<div\b[^>]*class=[\"'][^\"']*\b(?:plan|pricing|tier|package)\b[^\"']*[\"'][^>]*>(.*?)</div>")
    clean = lambda c, p: F.trim(F.regexp_replace(F.regexp_extract(c, p, 1), _TAG, " "))
    found = F.transform(cards, lambda c: F.struct(clean(c, r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>").alias("name"), clean(F.regexp_replace(c, r"(?is)<(del|s|strike)\b.*?</\1>", ""), r"(?is)class=[\"'][^\"']*price[^\"']*[\"'][^>]*>([^<]*)").alias("price"), F.regexp_count(c, F.lit("(?i)<li\\b")).alias("features")))
    priced = F.filter(found, lambda c: (c["name"] != "") & (c["price"] != ""))
    return F.when(F.size(priced) >= 2, priced)


SECTION_TYPES = {"ingredients": r"ingredient|composition|material", "benefits": r"benefit|why you|what it does", "usage": r"how to|usage|directions|apply", "features": r"feature|highlight|detail", "specifications": r"specification|spec\b|dimension|technical", "faqs": r"faq|question"}


def section_type(title: Column) -> Column:
    """The first kind of section that a heading names."""
    return F.coalesce(*[F.when(F.regexp_like(title, F.lit(f"(?i){p}")), kind) for kind, p in SECTION_TYPES.items()])


def accordions(html: Column) -> Column:
    """Folded sections as (title, content, items): details with summary, and buttons followed by a panel."""
    found = [(r"(?is)<details\b[^>]*>\s*<summary\b[^>]*>(.*?)</summary>(.*?)</details>"), (r"(?is)<button\b[^>]*class=[\"'][^\"']*accordion[^\"']*[\"'][^>]*>(.*?)</button>\s*<div\b[^>]*class=[\"'][^\"']*panel[^\"']*[\"'][^>]*>(.*?)</div>")]
    pairs = F.concat(*[F.arrays_zip(every(html, p).alias("title"), every(html, p, 2).alias("body")) for p in found])
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, _TAG, " "), r"\s+", " "))
    return F.transform(pairs, lambda p: F.struct(bare(p["title"]).alias("title"), bare(p["body"]).alias("content"), F.transform(F.regexp_extract_all(p["body"], F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1)), bare).alias("items")))


# JSON.


def ld_blocks(html: Column) -> Column:
    """The JSON-LD blocks that parse."""
    return F.filter(every(html, r"(?is)<script\b[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), lambda x: F.try_parse_json(x).isNotNull())


def flat_items(block: Column) -> Column:
    """A block's items as JSON texts: those of a list or the object itself, and what their graphs hold."""
    tops = F.when(F.startswith(F.ltrim(block), F.lit("[")), F.from_json(block, "array<string>")).otherwise(F.array(block))
    return F.flatten(F.transform(tops, lambda t: F.concat(F.array(t), F.coalesce(F.from_json(F.get_json_object(t, "$['@graph']"), "array<string>"), F.array().cast("array<string>")))))


def has_type(items: Column, kind: str) -> Column:
    """Whether an item's type, or one of its types, is this."""
    named = lambda t: F.coalesce(F.from_json(t, "array<string>"), F.array(t))
    return F.exists(items, lambda i: F.coalesce(F.array_contains(F.transform(named(F.get_json_object(i, "$['@type']")), F.lower), kind.lower()), F.lit(False)))


def script_json(html: Column) -> Column:
    """Objects that scripts assign to the state variables of common frameworks, those that parse."""
    names = r"(?:window\.__INITIAL_STATE__|window\.__PRELOADED_STATE__|window\.__APOLLO_STATE__|window\.__data|__NEXT_DATA__)"
    return F.filter(every(html, rf"(?s){names}\s*=\s*(\{{.*?\}});"), lambda x: F.try_parse_json(x).isNotNull())


def canonical_json(x: Column) -> Column:
    """The same for objects that differ in the order of their keys or in white space."""
    return F.to_json(F.try_parse_json(x))


def as_list(x: Column) -> Column:
    """A JSON list's items as texts; a scalar or object is a list of one, null an empty one."""
    return F.when(x.isNull() | (x == "null"), F.array().cast("array<string>")).when(F.startswith(F.ltrim(x), F.lit("[")), F.from_json(x, "array<string>")).otherwise(F.array(x))


def values_equal(a: Column, b: Column) -> Column:
    """Numbers within 1e-9, texts without regard to case and white space."""
    x, y = a.try_cast("double"), b.try_cast("double")
    flat = lambda s: F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) < 1e-9).otherwise(F.coalesce(flat(a) == flat(b), a.isNull() & b.isNull()))


def option_values(product: Column, limit: int = 30) -> Column:
    """The different values of all variants' options, case aside, the first 30."""
    variants = F.from_json(F.get_json_object(product, "$.variants"), "array<struct<option1:string,option2:string,option3:string>>")
    found = F.filter(F.transform(F.flatten(F.transform(variants, lambda v: F.array(v["option1"], v["option2"], v["option3"]))), lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))
    low = F.transform(found, F.lower)
    return F.slice(F.filter(found, lambda v, k: F.array_position(low, F.lower(v)) == k + 1), 1, limit)


def common_prefix(texts: Column) -> Column:
    """The longest text that all begin with."""
    low, high = F.array_min(texts), F.array_max(texts)
    n = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), F.lit(0), lambda n, k: F.when((n == k - 1) & (F.substring(low, k, F.lit(1)) == F.substring(high, k, F.lit(1))) & (F.substring(low, k, F.lit(1)) != ""), k).otherwise(n))
    return F.when(F.size(texts) == 0, "").otherwise(F.substring(low, F.lit(1), n))


def _walk(x: object, depth: int = 0) -> Iterator[dict]:
    if isinstance(x, dict):
        yield x
    if depth < 12:
        for value in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            yield from _walk(value, depth + 1)


def _loaded(x: str | None) -> object:
    try:
        return json.loads(x) if x else None
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def deep_value(x: pd.Series, keys: pd.Series) -> pd.Series:
    """The first value that is not empty under one of the keys (comma-joined), at any depth down to 12."""
    return pd.Series([next((str(o[k]) for o in _walk(_loaded(text)) for k in names.split(",") if o.get(k)), None) for text, names in zip(x, keys, strict=True)], dtype=object)


@F.pandas_udf(ArrayType(StructType([StructField("name", StringType()), StructField("price", StringType())])))
def nested_products(x: pd.Series) -> pd.Series:
    """Objects at any depth down to 12 that have a name or title, and a price."""
    names = lambda o: o.get("name") or o.get("title")
    return x.map(lambda text: [{"name": str(names(o)), "price": str(o["price"])} for o in _walk(_loaded(text)) if isinstance(names(o), str) and isinstance(o.get("price"), (str, int, float))])


@F.pandas_udf(StringType())
def all_texts(x: pd.Series) -> pd.Series:
    """All texts and numbers of a JSON value in order, joined by blanks, 5000 letters at most; of a list the first 30 items."""

    def leaves(v: object, depth: int = 0) -> Iterator[str]:
        if isinstance(v, str) and v.strip():
            yield " ".join(v.split())
        elif isinstance(v, (int, float)):
            yield str(v)
        elif depth < 100:
            for item in v.values() if isinstance(v, dict) else v[:30] if isinstance(v, list) else ():
                yield from leaves(item, depth + 1)

    return x.map(lambda text: " ".join(leaves(_loaded(text)))[:5000])
