"""Parts of shop pages from the element table: menus, product cards, plan cards, folded sections.

Each part is an expression over the arrays of a page's elements and texts, so it is found in the row
of the page; menu_items() and its like take tokens() and element_table() of pages and gather them first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import resolve
from .elements import attribute, first, gathered, has_attribute, has_one, held, holds_one, innermost_of, inside, span, text_inside

# What names a menu, the paths of categories, and those of pages that are none.
MENU_CLASSES = ["header__inline-menu", "site-nav", "main-menu", "main-navigation", "primary-menu", "navmenu"]
CATEGORY_PATHS = ["/collections/", "/product-category/", "/product-cat/", "/shop/", "/c/"]
UTILITY = (
    "cart|checkout|warenkorb|kasse|account|my-account|mein-konto|login|logout|register|signin|sign-in|anmelden|konto|wishlist|wunschliste|merkliste|search|suche|contact|kontakt|about|ueber-uns|about-us|faq|help|hilfe|support|blog|news|press|presse|career|jobs|impressum|datenschutz|"
    "privacy|terms|agb|widerruf|shipping|versand|lieferung|returns|retoure|payment|zahlung|bezahlung|zahlungsweisen|cookie|sitemap|beratung|pflege|reparatur|materialien|haendler|retail|newsletter|gift-card|gutschein|locator|finden|accessibility|legal|mentions|disclosure|polic(y|ies)|wholesale|affiliate|stockist|refund|imprint|subscribe"
)
# Where products stand, what cards are called, and where their names and prices are.
AREAS = ["id:product-grid", "collection", "collection-products", "product-grid", "grid--view-items", "main-collection-product-grid", "tag:main"]
CARD_NAMES = ["product-card", "card-wrapper", "product-item", "grid__item", "grid-product", "product-block", "card"]
#: Classes of what only screen readers see.
HIDDEN = ["visually-hidden", "sr-only", "visuallyhidden", "screen-reader-text"]
NAME_CLASSES = ["product-card__title", "product-title", "product-item__title", "grid-product__title", "product-block__title", "product-card-title"]
PRICE_CLASSES = ["price", "price-item", "money", "product-price", "grid-product__price"]
NO_PRODUCTS = r"(?i)^\s*(?:klarna|afterpay|clearpay|sezzle|affirm|paypal|zip|laybuy|shop\s*pay|apple\s*pay|google\s*pay|amazon\s*pay|delivery\s+information|shipping\s+information|size\s+guide|buy\s+now\s+pay\s+later|bnpl)\s*$|^\s*(?:free\s+(?:standard\s+|express\s+)?(?:shipping|delivery|returns?)|(?:standard|express|next[\s-]*day|international)\s+(?:shipping|delivery)|free\s+returns?|returns?\s+&\s+exchanges?)\b"
# Plan cards.
MONEY = r"(?i)(?:[$€£₹₨]|USD|EUR|GBP|PKR|Rs\.?)\s?\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)?\s?(?:[$€£]|USD|EUR|GBP|PKR)"
PLAN_CLASS = r"(?i)\b(?:plan|pricing|tier|package|price[-_]?(?:table|box|card|column))\w*"
PLAN_TITLE, PLAN_OLD = r"(?i)title|name|heading", r"(?i)meta|regular|old[-_]?price|was[-_]?price|compare|strike"
PLAN_PERIOD = r"(?i)/\s*(mo(?:nth)?|yr|year|annual(?:ly)?|lifetime|one[- ]?time|user|seat|site)s?\b"
# Words of headings of product sections.
SECTION_WORDS = "ingredient benefit direction usage instruction feature highlight specification detail about faq question result why what key active formula description composition apply use size weight volume".split() + ["how to"]
HEADS = ["summary", "button", "h1", "h2", "h3", "h4", "h5", "h6"]
#: What the class or the attributes of every element that sections_of() asks for hold; the others are not asked.
SECTION_CLASSES = "accordion|collapsible|disclosure|tab-content|tab-pane|tabs__pane|elementor|rte|product-info|product-details|product-description|product__description"
SECTION_ATTRIBUTES = ["role", "data-accordion", "data-collapsible"]


def _bare(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/+$", ""))


def _site(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1)), r"^www\.", "")


def is_category(url: Column, base: Column, permissive: Column) -> Column:
    """Whether a link leads to a category: by its path; if permissive also a page right under the root of the same site that is no known other one."""
    low = F.lower(url)
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z]+://[^/?#]*|[?#].*$", ""), "^/+|/+$", "")
    root = F.regexp_like(low, F.lit("^https?://")) & (_site(url) == _site(base)) & (path != "") & ~F.contains(path, F.lit("/")) & ~F.contains(path, F.lit(".")) & ~F.regexp_like(F.lower(path), F.lit(UTILITY))
    return F.exists(F.array(*map(F.lit, CATEGORY_PATHS)), lambda p: F.contains(low, p)) | (permissive & root)


def menu_items(pages: DataFrame, toks: DataFrame, els: DataFrame, keys: list[str], url_col: str = "url") -> DataFrame:
    """menus_of() for the tables of pages."""
    return menus_of(pages.select(*keys, url_col).join(gathered(toks, els, keys), keys), keys, url_col)


def menus_of(pages: DataFrame, keys: list[str], url_col: str = "url") -> DataFrame:
    """Categories of the menus of pages (keys, url, els, texts): keys, rank, title, url, path (titles of the items above, three at most; an item with items below it ends its own path).

    The menu is the outermost list within a menu element that has most links to categories; if none
    has two, pages right under the root count as categories too; if there is still nothing, all such
    links of the page are taken, without path.  Items go four levels deep; an item without link is
    named by the first label in it; each url counts once.  Menus that are no lists come out flat.
    """
    els, base, menu = F.col("els"), F.col("_base"), F.col("menu")
    spans = lambda test: F.transform(F.filter(els, test), span)
    link = lambda e: F.struct(e["pos"].alias("pos"), e["end"].alias("end"), F.coalesce(resolve(base, attribute(e["token"], "href")), F.lit("")).alias("url"))
    rows = held(
        pages.select(*keys, F.col(url_col).alias("_base"), "els", "texts"),
        links=F.transform(F.filter(els, lambda e: (e["tag"] == "a") & has_attribute(e["token"], "href")), link),
        menus=spans(lambda e: (e["tag"] == "nav") | (F.lower(attribute(e["token"], "role")) == "navigation") | (attribute(e["token"], "id") == "AccessibleNav") | has_one(e, MENU_CLASSES)),
        lists=spans(lambda e: e["tag"] == "ul"),
        hidden=spans(lambda e: has_one(e, HIDDEN) | (F.lower(attribute(e["token"], "aria-hidden")) == "true")),
    )
    category = lambda x, permissive: F.coalesce(is_category(x["url"], base, F.lit(permissive)), F.lit(False))
    rows = held(
        rows,
        links=F.transform("links", lambda x: F.struct(*[x[c].alias(c) for c in ("pos", "end", "url")], category(x, False).alias("strict"), category(x, True).alias("loose"))),
        tops=F.filter("lists", lambda x: innermost_of(F.col("menus"), x["pos"]).isNotNull() & innermost_of(F.col("lists"), x["pos"]).isNull()),
        texts=F.filter("texts", lambda t: innermost_of(F.col("hidden"), t["pos"]).isNull()),
    )
    most = lambda c: F.array_max(F.transform("tops", lambda t: F.struct(F.size(F.filter(inside(F.col("links"), t), lambda x: x[c])).alias("n"), (-t["pos"]).alias("at"), span(t).alias("top"))))
    rows = held(rows, strict=most("strict"), loose=most("loose"))
    rows = held(rows, permissive=(F.col("strict.n") < 2) & (F.col("loose.n") > F.col("strict.n")))
    best = F.when(F.col("permissive"), F.col("loose")).otherwise(F.col("strict"))
    rows = held(rows, menu=F.when(best["n"] > 0, best["top"]))

    rows = held(rows, items=F.transform(F.filter(inside(els, menu), lambda e: (e["tag"] == "li") & F.exists("lists", lambda x: x["pos"] == e["parent"])), span))
    item = lambda x: innermost_of(F.col("items"), x["pos"])["pos"].alias("li")
    label = lambda x: F.left(text_inside(F.col("texts"), x), F.lit(60))
    labels = F.filter(inside(els, menu), lambda e: e["tag"].isin("a", "span", "button", "summary", "h2", "h3", "h4", "strong"))
    rows = held(
        rows,
        own=F.transform(inside(F.col("links"), menu), lambda x: F.struct(item(x), x.alias("a"), label(x).alias("label"))),
        other=F.filter(F.transform(labels, lambda e: F.struct(item(e), label(e).alias("label"))), lambda x: x["label"] != ""),
    )
    mine = lambda name, i: first(name, lambda x: x["li"] == i["pos"])
    rows = held(rows, items=F.transform("items", lambda i: F.struct(i["pos"].alias("pos"), item(i).alias("up"), mine("own", i).alias("own"), mine("other", i)["label"].alias("other"))))
    chosen = lambda i: F.coalesce(F.when(F.col("permissive"), i["own"]["a"]["loose"]).otherwise(i["own"]["a"]["strict"]), F.lit(False)).alias("category")
    slug = lambda url: F.initcap(F.translate(F.element_at(F.split(_bare(url), "/"), -1), "-", " "))
    title = lambda i: F.coalesce(F.nullif(i["own"]["label"], F.lit("")), i["other"], F.when(chosen(i), slug(i["own"]["a"]["url"])), F.lit(""))
    rows = held(rows, items=F.transform("items", lambda i: F.struct(i["pos"].alias("pos"), i["up"].alias("up"), i["own"]["a"]["url"].alias("url"), chosen(i), title(i).alias("title"))))
    # The items above, one level at a time; four levels at most.
    rows = held(rows, chains=F.transform("items", lambda i: F.struct(F.array(i).alias("way"), i["up"].alias("at"))))
    for _ in range(3):
        over = lambda c: F.filter("items", lambda o: o["pos"] == c["at"])
        rows = held(rows, chains=F.transform("chains", lambda c: F.struct(F.concat(over(c), c["way"]).alias("way"), first(over(c))["up"].alias("at"))))
    kept = lambda c: c["at"].isNull() & F.forall(c["way"], lambda i: i["title"] != "") & F.element_at(c["way"], -1)["category"]
    rows = held(rows, ways=F.transform(F.filter("chains", kept), lambda c: c["way"]))
    rows = held(rows, heads=F.flatten(F.transform("ways", lambda w: F.transform(F.slice(w, 1, F.size(w) - 1), lambda i: i["pos"]))))
    titles = lambda w: F.slice(F.transform(F.when(F.array_contains("heads", F.element_at(w, -1)["pos"]), w).otherwise(F.slice(w, 1, F.size(w) - 1)), lambda i: i["title"]), 1, 3)
    entry = lambda x, title, path: F.struct(x["pos"].alias("pos"), title.alias("title"), x["url"].alias("url"), path.alias("path"), _bare(x["url"]).alias("key"))
    nested = F.transform("ways", lambda w: entry(F.element_at(w, -1), F.element_at(w, -1)["title"], titles(w)))
    flat = F.transform(F.filter("links", lambda x: x["loose"]), lambda x: entry(x, F.coalesce(F.nullif(label(x), F.lit("")), slug(x["url"])), F.array().cast("array<string>")))
    rows = held(rows.select(*keys, F.when(F.size("ways") > 0, nested).otherwise(flat).alias("every")), every=F.col("every"))
    once = F.filter("every", lambda x, k: ~F.exists(F.slice("every", 1, k), lambda y: y["key"] == x["key"]))
    return rows.select(*keys, F.posexplode(once).alias("_k", "x")).select(*keys, (F.col("_k") + 1).alias("rank"), "x.title", "x.url", "x.path")


def product_cards(pages: DataFrame, toks: DataFrame, els: DataFrame, keys: list[str], url_col: str = "url") -> DataFrame:
    """cards_of() for the tables of pages."""
    return cards_of(pages.select(*keys, url_col).join(gathered(toks, els, keys), keys), keys, url_col)


def cards_of(pages: DataFrame, keys: list[str], url_col: str = "url") -> DataFrame:
    """Products of the listings of pages (keys, url, els, texts) by their links: keys, rank, handle, name, url, price_text, price, in_stock (null if nothing is said), image.

    Links within the first product area that has any (else the page); a product's card is the
    nearest element around its link that is called one, at most seven levels up, else the element around.
    """
    els, texts, base = F.col("els"), F.col("texts"), F.col("_base")
    handle = lambda url: F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    link = lambda e: F.struct(*[e[c].alias(c) for c in ("pos", "end", "depth", "parent")], holds_one(e, CARD_NAMES).alias("own"), F.regexp_replace(resolve(base, attribute(e["token"], "href")), r"\?.*$", "").alias("url"))
    rows = held(pages.select(*keys, F.col(url_col).alias("_base"), "els", "texts"), links=F.transform(F.filter(els, lambda e: (e["tag"] == "a") & F.contains(attribute(e["token"], "href"), F.lit("/products/"))), link))
    # The rest is asked of pages with links to products.
    asked = lambda x: F.when(F.size("links") > 0, x)
    is_ = lambda e, a: e["tag"] == a[4:] if a[:4] == "tag:" else attribute(e["token"], "id") == a[3:] if a[:3] == "id:" else has_one(e, [a])
    area = lambda a: first(els, lambda e: is_(e, a))
    named = lambda e: F.coalesce(F.when(has_one(e, ["card__heading"]), 1), *[F.when(has_one(e, [c]), 2 + k) for k, c in enumerate(NAME_CLASSES)], F.when(e["tag"] == "h3", 10), F.when(e["tag"] == "h2", 11))
    priced = lambda e: F.coalesce(*[F.when(has_one(e, [c]), k) for k, c in enumerate(PRICE_CLASSES)], F.when(F.contains(e["cls"], F.lit("price")), 9))
    rows = held(
        rows,
        areas=asked(F.array_compact(F.array(*map(area, AREAS)))),
        called=asked(F.transform(F.filter(els, lambda e: holds_one(e, CARD_NAMES)), lambda e: F.struct(*[e[c].alias(c) for c in ("pos", "end", "depth")]))),
        headings=asked(F.transform(F.filter(els, lambda e: has_one(e, ["card__heading"])), span)),
        images=asked(F.filter(els, lambda e: e["tag"] == "img")),
    )
    ranked = lambda rank, test: F.filter(F.transform(F.filter(F.transform(els, lambda e: F.struct(rank(e).alias("k"), e["pos"].alias("pos"), e["end"].alias("end"))), lambda x: x["k"].isNotNull()), lambda x: F.struct(x["k"].alias("k"), x["pos"].alias("pos"), text_inside(texts, x).alias("said"))), test)
    rows = held(
        rows, area=first("areas", lambda a: F.size(inside(F.col("links"), a)) > 0),
        names=asked(ranked(lambda e: F.when((e["tag"] == "a") & innermost_of(F.col("headings"), e["pos"]).isNotNull(), 0).otherwise(named(e)), lambda x: x["said"] != "")),
        prices=asked(ranked(priced, lambda x: F.regexp_like(x["said"], F.lit(r"\d")))),
    )
    rows = held(rows, links=F.transform(F.when(F.col("area").isNull(), F.col("links")).otherwise(inside(F.col("links"), F.col("area"))), lambda x: F.struct(x.alias("x"), handle(x["url"]).alias("handle"), F.when(x["own"], F.struct(*[x[c].alias(c) for c in ("pos", "end", "depth")])).otherwise(innermost_of(F.col("called"), x["pos"])).alias("card"))))
    rows = held(rows, links=F.filter("links", lambda x, k: ~F.exists(F.slice("links", 1, k), lambda y: y["handle"] == x["handle"])))
    near = lambda x: F.when(x["x"]["depth"] - x["card"]["depth"] <= 7, span(x["card"])).when(x["x"]["parent"].isNull(), span(x["x"])).otherwise(span(first(els, lambda e: e["pos"] == x["x"]["parent"])))
    rows = held(rows, links=F.transform("links", lambda x: F.struct(x["x"]["url"].alias("url"), x["handle"].alias("handle"), near(x).alias("card"))))
    best = lambda name, x: F.array_min(inside(F.col(name), x["card"]))["said"]
    image = lambda x, a: F.get(F.transform(F.slice(inside(F.col("images"), x["card"]), 1, 1), lambda e: F.nullif(attribute(e["token"], a), F.lit(""))), F.lit(0))
    whole = lambda x: F.nullif(text_inside(texts, x["card"]), F.lit(""))
    facts = lambda x: F.struct(x["url"].alias("url"), x["handle"].alias("handle"), F.coalesce(best("names", x), image(x, "alt"), F.initcap(F.translate(x["handle"], "-", " "))).alias("name"), best("prices", x).alias("price_text"), image(x, "src").alias("image"), whole(x).alias("all"))
    rows = held(rows, links=F.transform("links", facts))
    own = F.lower(F.regexp_extract(base, "/collections/([^/?#]+)", 1))
    kept = F.filter("links", lambda x: ~F.regexp_like(x["name"], F.lit(NO_PRODUCTS)) & (F.lower(x["handle"]) != own))
    out = rows.select(*keys, F.posexplode(kept).alias("_k", "x")).select(*keys, "_k", "x.*")
    low = F.lower(F.coalesce("all", F.lit("")))
    said = lambda *xs: F.exists(F.array(*map(F.lit, xs)), lambda x: F.contains(low, x))
    out = out.withColumn("price_text", F.coalesce("price_text", F.nullif(F.regexp_extract("all", r"(?i)(?:Rs\.?|PKR|\$|£|€)\s?[\d,]+(?:\.\d+)?", 0), F.lit(""))))
    return out.select(
        *keys, (F.col("_k") + 1).alias("rank"), "handle", "name", "url", "price_text", F.replace(F.regexp_extract("price_text", r"[\d,]*\d(?:\.\d+)?", 0), F.lit(","), F.lit("")).try_cast("double").alias("price"),
        F.when(said("out of stock", "sold out"), False).when(said("add to cart", "buy now", "choose options"), True).alias("in_stock"), "image",
    )


def plan_cards(toks: DataFrame, els: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """plans_of() for the tables of pages."""
    return plans_of(gathered(toks, els, keys), keys, most)


def plans_of(pages: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """Plans of the price tables of pages (keys, els, texts): keys, rank, name, price_text, price, period, compare_at, features; pages with a single card have none.

    Cards are the outermost elements whose class names a plan and that state money.  What is struck
    out or called an old price is no price, and is a comparison only if it is higher.
    """
    texts = F.col("texts")
    money = lambda x: F.nullif(F.regexp_extract(x, MONEY, 0), F.lit(""))
    amount = lambda x: F.replace(F.regexp_extract(x, r"\d[\d,]*(?:\.\d+)?", 0), F.lit(","), F.lit("")).try_cast("double")
    called = lambda e, pattern: F.regexp_like(e["cls"], F.lit(pattern))
    said = lambda e: F.struct(e["pos"].alias("pos"), e["end"].alias("end"), text_inside(texts, e).alias("said"))
    cards = F.filter(F.transform(F.filter("els", lambda e: called(e, PLAN_CLASS)), said), lambda c: (F.length(c["said"]) <= 2500) & money(c["said"]).isNotNull())
    rows = held(pages.select(*keys, "els", "texts"), cards=cards)
    # A card alone is none, so the rest is asked of pages with two at least.
    rows = held(rows, cards=F.filter("cards", lambda c: innermost_of(F.col("cards"), c["pos"]).isNull()))
    some = lambda test: F.when(F.size("cards") >= 2, F.transform(F.filter("els", test), said))
    title = lambda e: called(e, PLAN_TITLE)
    old = lambda e: called(e, PLAN_OLD)
    priced = lambda xs: F.filter(xs, lambda x: money(x["said"]).isNotNull())
    rows = held(
        rows, titles=some(title), heads=some(lambda e: ~title(e) & e["tag"].isin("h2", "h3", "h4", "h5", "h6")),
        old=priced(some(old)), struck=priced(some(lambda e: ~old(e) & e["tag"].isin("del", "s", "strike"))), lis=some(lambda e: e["tag"] == "li"),
    )
    # Only the first element that is called a title counts, and it must do for one.
    does = lambda x: (x["said"] != "") & (F.length(x["said"]) <= 60) & money(x["said"]).isNull()
    name = lambda c: F.coalesce(first(F.slice(inside(F.col("titles"), c), 1, 1), does)["said"], first(inside(F.col("heads"), c), does)["said"])
    was = lambda c: F.coalesce(first(inside(F.col("old"), c)), first(inside(F.col("struck"), c)))
    items = lambda c: F.filter(F.transform(F.slice(inside(F.col("lis"), c), 1, 10), lambda x: x["said"]), lambda x: (x != "") & (F.length(x) <= 160))
    rows = held(rows, cards=F.when(F.size("cards") >= 2, F.transform("cards", lambda c: F.struct(c["pos"].alias("pos"), c["end"].alias("end"), c["said"].alias("said"), name(c).alias("name"), was(c).alias("o"), items(c).alias("features")))))
    rest = lambda c: F.array_join(F.transform(F.filter(inside(texts, c), lambda t: c["o"].isNull() | (t["pos"] < c["o"]["pos"]) | (t["pos"] > c["o"]["end"])), lambda t: t["text"]), " ")
    rows = held(rows, cards=F.transform("cards", lambda c: F.struct(*[c[x].alias(x) for x in ("said", "name", "features")], c["o"]["said"].alias("old"), money(rest(c)).alias("price_text"))))
    rows = held(rows, cards=F.filter("cards", lambda c: c["name"].isNotNull() & c["price_text"].isNotNull()))
    rows = held(rows, cards=F.filter("cards", lambda c, k: ~F.exists(F.slice("cards", 1, k), lambda o: F.lower(o["name"]) == F.lower(c["name"]))))
    out = rows.select(*keys, F.posexplode(F.when(F.size("cards") >= 2, F.slice("cards", 1, most))).alias("_k", "c"))
    price, compared = amount(F.col("c.price_text")), amount(money(F.col("c.old")))
    period = F.nullif(F.lower(F.regexp_extract("c.said", PLAN_PERIOD, 1)), F.lit(""))
    return out.select(*keys, (F.col("_k") + 1).alias("rank"), "c.name", "c.price_text", price.alias("price"), F.concat(F.lit("/"), period).alias("period"), F.when(compared > price, compared).alias("compare_at"), "c.features")


def folded_sections(toks: DataFrame, els: DataFrame, keys: list[str]) -> DataFrame:
    """sections_of() for the tables of pages."""
    return sections_of(gathered(toks, els, keys), keys)


def sections_of(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Sections that fold open, of pages (keys, els, texts): keys, strategy (1 to 6), title, content (null below ten letters), items; of equal titles the first.

    1: details with summary; 2: accordion items; 3: collapsibles and disclosures; 4: tab panels, named
    by what controls them; 5: widgets of page builders; 6: headings in product texts, up to the next one.
    """
    els, texts = F.col("els"), F.col("texts")
    tag_is = lambda e, *tags: e["tag"].isin(*tags)
    holds = lambda e, *parts: holds_one(e, list(parts))
    one_of = lambda e, *names: has_one(e, list(names))
    spans = lambda test, items="marked": F.transform(F.filter(items, test), span)
    filled = lambda x: F.nullif(x, F.lit(""))
    said = lambda x: text_inside(texts, x)

    def ranked(rank: Callable[[Column], Column]) -> Column:
        """Elements that have a rank, as struct(k, pos, end)."""
        return F.filter(F.transform("marked", lambda e: F.struct(rank(e).alias("k"), e["pos"].alias("pos"), e["end"].alias("end"))), lambda x: x["k"].isNotNull())

    # Few elements may be part of a section, so few are asked for classes and attributes.
    marked = lambda e: tag_is(e, "details", "summary", "button") | F.regexp_like(F.lower(e["cls"]), F.lit(SECTION_CLASSES)) | F.exists(F.array(*map(F.lit, SECTION_ATTRIBUTES)), lambda a: F.contains(F.lower(e["token"]), a))
    refers = lambda e: F.contains(e["token"], F.lit("#")) | F.contains(F.lower(e["token"]), F.lit("aria-controls"))
    rows = held(pages.select(*keys, "els", "texts"), marked=F.filter(els, marked), refs=F.filter(els, refers))
    rows = held(
        rows,
        heads=F.transform(F.filter(els, lambda e: tag_is(e, *HEADS)), lambda e: F.struct(e["pos"].alias("pos"), e["end"].alias("end"), e["tag"].alias("tag"), said(e).alias("said"))),
        headers=spans(lambda e: one_of(e, "accordion-header")),
        listed=spans(lambda e: tag_is(e, "ul", "ol"), "els"),
        lis=F.filter(F.transform(F.filter(els, lambda e: tag_is(e, "li")), lambda e: F.struct(e["pos"].alias("pos"), said(e).alias("said"))), lambda x: x["said"] != ""),
        refs=F.flatten(F.transform("refs", lambda e: F.array(*[F.struct(F.lit(k).alias("k"), e["pos"].alias("pos"), e["end"].alias("end"), to.alias("id")) for k, to in enumerate([attribute(e["token"], "aria-controls"), *[F.regexp_extract(attribute(e["token"], a), "^#(.+)", 1) for a in ("data-target", "href", "data-bs-target")]])]))),
        rte=spans(lambda e: one_of(e, "rte")),
        product=spans(lambda e: holds(e, "product-info") | one_of(e, "product-details")),
        description=spans(lambda e: one_of(e, "product-description", "product__description")),
        summaries=ranked(lambda e: F.when(tag_is(e, "summary"), 0)),
    )
    rows = held(
        rows,
        refs=F.filter("refs", lambda r: r["id"] != ""),
        # Texts of headings within a body are no content; after a heading (6) those of lists are items only.
        free=F.transform(F.filter("texts", lambda t: innermost_of(F.col("heads"), t["pos"]).isNull()), lambda t: F.struct(t["pos"].alias("pos"), t["text"].alias("text"), innermost_of(F.col("listed"), t["pos"]).isNotNull().alias("listed"))),
        buttons=ranked(lambda e: F.when(holds(e, "accordion-button"), 0).when(holds(e, "accordion__button"), 1).when(tag_is(e, "button") & innermost_of(F.col("headers"), e["pos"]).isNotNull(), 2)),
        bodies=ranked(lambda e: F.when(one_of(e, "accordion-collapse"), 0).when(one_of(e, "accordion-body"), 1).when(one_of(e, "accordion__content"), 2).when(holds(e, "accordion-body", "accordion-collapse", "accordion__content"), 3)),
        contents=ranked(lambda e: F.when(holds(e, "collapsible-content"), 0).when(one_of(e, "product__accordion", "product__tab-content", "product-accordion"), 1).when(has_attribute(e["token"], "data-accordion-content") | has_attribute(e["token"], "data-collapsible-content"), 2).when(holds(e, "product__accordion"), 3).when(one_of(e, "disclosure__list-item", "disclosure__panel"), 4)),
        widget_titles=ranked(lambda e: F.when(one_of(e, "elementor-accordion-title"), 0).when(one_of(e, "elementor-toggle-title"), 1).when(holds(e, "accordion-title"), 2)),
        widget_bodies=ranked(lambda e: F.when(one_of(e, "elementor-accordion-content"), 0).when(one_of(e, "elementor-toggle-content"), 1).when(holds(e, "accordion-content"), 2)),
    )
    part = lambda name, e: F.array_min(inside(F.col(name), e))

    def titled(e: Column) -> Column:
        """The first heading in an element by the order of HEADS, its data, or its id."""
        data = [filled(F.trim(attribute(e["token"], a))) for a in ("data-title", "data-tab-title", "data-label", "data-tab", "aria-label")]
        inner = inside(F.col("heads"), e)
        return F.coalesce(*[filled(first(inner, lambda h: h["tag"] == tag)["said"]) for tag in HEADS], *data, filled(F.initcap(F.trim(F.translate(attribute(e["token"], "id"), "-_", "  ")))))

    def named(e: Column, name: str) -> Column:
        return F.when(part(name, e).isNotNull(), filled(said(part(name, e))))

    def entries(strategy: int, test: Callable[[Column], Column], title: Callable[[Column], Column] | None, body: str | None) -> Column:
        """strategy, at, title, body."""
        entry = lambda e: F.struct(F.lit(strategy).alias("strategy"), e["pos"].alias("at"), (F.coalesce(title(e), titled(e)) if title else titled(e)).alias("title"), (F.coalesce(F.when(part(body, e).isNotNull(), span(part(body, e))), span(e)) if body else span(e)).alias("body"))
        return F.transform(F.filter("marked", test), entry)

    def controlled(e: Column) -> Column:
        """The text of what controls a tab panel."""
        own = F.coalesce(filled(attribute(e["token"], "id")), filled(attribute(e["token"], "aria-labelledby")))
        ref = F.array_min(F.filter("refs", lambda r: r["id"] == own))
        return F.when(ref.isNotNull(), filled(said(ref)))

    below = lambda e: e["parent"].isNotNull() & F.exists("rte", lambda r: r["pos"] == e["parent"])
    described = lambda e: (tag_is(e, "h2", "h3", "h4") & below(e)) | (tag_is(e, "h3", "h4") & innermost_of(F.col("product"), e["pos"]).isNotNull()) | (F.contains(e["cls"], F.lit("section")) & innermost_of(F.col("description"), e["pos"]).isNotNull())
    texted = F.transform(F.filter(els, described), lambda e: F.struct(*[e[c].alias(c) for c in ("pos", "end", "parent")], said(e).alias("said")))
    texted = F.filter(texted, lambda x: (F.length(x["said"]) <= 100) & F.exists(F.array(*map(F.lit, SECTION_WORDS)), lambda w: F.contains(F.lower(x["said"]), w)))
    after = lambda x: first(els, lambda e: tag_is(e, "h1", "h2", "h3", "h4", "h5", "h6") & (e["pos"] > x["pos"]) & e["parent"].eqNullSafe(x["parent"]))["pos"]
    edge = lambda x: first(els, lambda e: e["pos"] == x["parent"])["end"]
    upto = lambda x: F.struct(x["end"].alias("pos"), F.coalesce(after(x), edge(x), F.lit(1 << 30)).alias("end"))
    every = F.concat(
        entries(1, lambda e: tag_is(e, "details") & part("summaries", e).isNotNull(), lambda e: named(e, "summaries"), None),
        entries(2, lambda e: holds(e, "accordion-item", "accordion__item"), lambda e: named(e, "buttons"), "bodies"),
        entries(3, lambda e: one_of(e, "collapsible", "disclosure") | has_attribute(e["token"], "data-accordion") | holds(e, "product__accordion-item", "collapsible-item"), None, "contents"),
        entries(4, lambda e: (F.lower(attribute(e["token"], "role")) == "tabpanel") | holds(e, "tab-pane", "tabs__pane"), controlled, None),
        entries(5, lambda e: holds(e, "elementor-accordion-item") | one_of(e, "elementor-toggle-item"), lambda e: named(e, "widget_titles"), "widget_bodies"),
        F.transform(texted, lambda x: F.struct(F.lit(6).alias("strategy"), x["pos"].alias("at"), x["said"].alias("title"), upto(x).alias("body"))),
    )
    rows = held(rows, every=F.filter(every, lambda x: F.length(F.trim(x["title"])).between(3, 120)))
    content = lambda x: F.array_join(F.transform(F.filter(inside(F.col("free"), x["body"]), lambda t: ~t["listed"] | (x["strategy"] < 6)), lambda t: t["text"]), " ")
    items = lambda x: F.transform(F.filter(inside(F.col("lis"), x["body"]), lambda i: (x["strategy"] == 6) | (F.length(i["said"]) >= 5)), lambda i: i["said"])
    own = ("strategy", "at", "title")
    rows = held(rows, every=F.transform("every", lambda x: F.struct(*[x[c].alias(c) for c in own], content(x).alias("content"), items(x).alias("items"))))
    does = lambda x: (F.length(x["content"]) >= 10) | ((x["strategy"] == 6) & (x["content"] != ""))
    rows = held(rows, every=F.filter(F.transform("every", lambda x: F.struct(*[x[c].alias(c) for c in own], F.when(does(x), x["content"]).alias("content"), x["items"].alias("items"))), lambda x: x["content"].isNotNull() | (F.size(x["items"]) > 0)))
    key = lambda x: F.lower(F.trim(x["title"]))
    once = F.filter("every", lambda x, k: ~F.exists(F.slice("every", 1, k), lambda y: key(y) == key(x)))
    return rows.select(*keys, F.inline(once))
