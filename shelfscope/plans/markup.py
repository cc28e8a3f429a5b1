"""Extraction from shop pages and from JSON in them.

One page is made of each part, its parts and counts known from the part's columns; the queries read
them back from the markup, and the oracle takes them from the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup as M
from ..registry import query
from ..sources.catalog import spread, table

#: A page by part, in SQL that both engines read.
_K = "cast(p_partkey AS varchar(20))"
PAGE_SQL = f"""'<html lang="en"><head><title>' || p_name || ' | Shop</title><meta name="description" content="Buy ' || p_name || ' by ' || p_brand || '">'
|| CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '<link rel="canonical" href="https://shop.example/p/' || {_K} || '">' END
|| '<meta property="og:title" content="' || p_name || '"><meta property="og:image" content="/i/' || {_K} || '.png">'
|| '<link rel="alternate" hreflang="en-GB" href="https://uk.shop.example/"><link rel="alternate" hreflang="fr" href="/fr"><link rel="alternate" hreflang="x-default" href="/"><link rel="alternate" hreflang="de-CH" href="/ch"><link rel="alternate" hreflang="fr-CH" href="/ch-fr">'
|| '<script type="application/ld+json">{{"@context": "x", "@graph": [{{"@type": "Product", "name": "' || p_name || '", "offers": {{"@type": "Offer", "price": "' || cast(p_retailprice AS varchar(20)) || '"}}}}, {{"@type": ["BreadcrumbList", "Thing"]}}]}}</script><script type="application/ld+json">{{bad</script>'
|| '<script>window.__INITIAL_STATE__ = {{"a": {{"items": [{{"title": "' || p_name || '", "price": ' || cast(p_size AS varchar(20)) || '}}, {{"name": "no price"}}]}}}}; var x = 1;</script></head><body><header><a href="/">Home</a></header>'
|| '<nav><ul><li><a href="/collections/' || lower(p_type) || '">' || p_type || '</a></li><li><a href="/about">About</a></li><li><a href="/about">About</a></li></ul></nav><main><h1>' || p_name || '</h1><p>Made by <b>' || p_brand || '</b>.</p><h2>More</h2>'
|| '<p>Showing 1-20 of 1,' || lpad(cast(p_size AS varchar(20)), 3, '0') || ' products</p><div class="grid ' || CASE WHEN p_partkey % 3 = 0 THEN 'product-grid' ELSE 'plain' END || '">'
|| '<a href="/products/a?x=1">A</a><a href="/products/a#y">A</a><a href="/products/' || {_K} || '/">B</a><a href="/blogs/products/z">no</a><a href="/sale">Sale</a></div>'
|| '<details><summary>Ingredients</summary><ul><li>' || p_brand || '</li><li>water</li></ul></details><details><summary>How to use</summary><p>Apply ' || p_name || '</p></details><button class="accordion">Material</button><div class="panel">' || p_type || '</div>'
|| '<div class="plan"><h3>Basic</h3><del class="price">$ 99</del><span class="price">$ ' || cast(p_size AS varchar(20)) || ' / mo</span><ul><li>one</li></ul></div>' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '<div class="plan featured"><h3>Pro</h3><span class="price">$ 50</span><ul><li>one</li><li>two</li></ul></div>' END
|| '<form>ask us</form></main><footer><a href="/policies/shipping">Shipping</a><a href="/pages/returns">Returns</a> &copy; ' || p_brand || '</footer></body></html>'"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, html."""
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("part"), F.expr(PAGE_SQL).alias("html"))


@query("""SELECT p_partkey AS part, p_name || ' | Shop' AS title, 'Buy ' || p_name || ' by ' || p_brand AS description, CASE WHEN p_partkey % 4 <> 0 THEN 'https://shop.example/p/' || p_partkey END AS canonical, p_name AS h1,
       p_name AS og_title, '/i/' || p_partkey || '.png' AS og_image, 2 AS og_count FROM part""")
def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, description, canonical url, heading and Open Graph properties."""
    html, og = F.col("html"), M.open_graph(F.col("html"))
    return pages(spark, sf_dir).select("part", M.one(html, "(?is)<title>(.*?)</title>").alias("title"), M.meta(html, "description").alias("description"), M.canonical(html).alias("canonical"), M.one(html, r"(?is)<h1\b[^>]*>(.*?)</h1>").alias("h1"), og["title"].alias("og_title"), og["image"].alias("og_image"), F.size(og).alias("og_count"))


@query("""SELECT p_partkey AS part, 'Home>/,' || p_type || '>/collections/' || lower(p_type) || ',About>/about' AS navigation, p_name || ',More,Basic' || CASE WHEN p_partkey % 5 <> 0 THEN ',Pro' ELSE '' END AS headings, 'Shipping>/policies/shipping,Returns>/pages/returns' AS footer FROM part""")
def page_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of menus and headers (each once), headings, and links of the footer."""
    html = F.col("html")
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(">", x["text"], x["url"])), ",")
    return pages(spark, sf_dir).select("part", shown(M.navigation(html)).alias("navigation"), F.array_join(M.headings(html), ",").alias("headings"), shown(M.footer_links(html)).alias("footer"))


@query("""SELECT p_partkey AS part, p_name || ' Made by ' || p_brand || ' .' AS hero, 'Shipping Returns © ' || p_brand AS footer, p_name || ' | Shop Home ' || p_type AS opening, true AS whole FROM part""")
def page_text_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full text, its top, the hero's and the footer's text."""
    e = M.text_evidence(F.col("html"))
    rows = pages(spark, sf_dir).select("part", e.alias("e"), F.regexp_extract("html", r"(?is)<title>(.*?) \| Shop", 1).alias("name"), F.regexp_extract("html", "/collections/([a-z]+)", 1).alias("kind"))
    opening = F.concat("name", F.lit(" | Shop Home "), F.upper("kind"))
    return rows.select("part", F.col("e.hero").alias("hero"), F.col("e.footer").alias("footer"), F.left("e.top", F.length(opening)).alias("opening"), F.startswith("e.full", F.col("e.top")).alias("whole"))


@query("""SELECT p_partkey AS part, 2 AS products, 1 AS categories, p_partkey % 3 = 0 AS grid, 1000 + p_size AS shown, false AS chrome FROM part""")
def page_listing_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within the main content: different product links, category links, whether there is a grid, the count that the page states."""
    main = M.main_html(F.col("html"))
    chrome = F.contains(main, F.lit("<nav")) | F.contains(main, F.lit("ask us")) | F.contains(main, F.lit("/policies/"))
    return pages(spark, sf_dir).select("part", M.product_links(main).alias("products"), M.category_links(main).alias("categories"), M.product_grid(main).alias("grid"), M.shown_count(F.col("html")).alias("shown"), chrome.alias("chrome"))


@query("""SELECT p_partkey AS part, 'en-gb:GB:https://uk.shop.example/,de-ch:CH:/ch' AS stores, 6 AS links, 5 AS internal FROM part""")
def page_locales_and_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regional stores (the first of each country) and different links of the page, all and on the same site."""
    html = F.col("html")
    stores = F.array_join(F.transform(M.hreflang(html), lambda x: F.concat_ws(":", x["code"], x["country"], x["url"])), ",")
    urls = F.array_distinct(F.transform(M.links(F.concat(M.main_html(html), F.lit('<a href="/pages/q">q</a><a href="https://else.example/">out</a>'))), lambda x: F.regexp_replace(F.regexp_replace(x["url"], "[?#].*$", ""), "/+$", "")))
    return pages(spark, sf_dir).select("part", stores.alias("stores"), F.size(urls).alias("links"), F.size(F.filter(urls, lambda u: ~F.regexp_like(u, F.lit("^https?://(?!shop\\.example)")))).alias("internal"))


@query("""SELECT p_partkey AS part, CASE WHEN p_partkey % 5 <> 0 THEN 'Basic:$ ' || p_size || ' / mo:1,Pro:$ 50:2' END AS plans FROM part""")
def page_plan_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans with price and number of features, struck-out prices aside; a single card is no price table."""
    cards = M.plan_cards(F.col("html"))
    shown = F.array_join(F.transform(cards, lambda c: F.concat_ws(":", c["name"], c["price"], c["features"].cast("string"))), ",")
    return pages(spark, sf_dir).select("part", shown.alias("plans"))


@query("""WITH e AS (SELECT p_partkey AS part, unnest([{'kind': 'ingredients', 'score': 4 + length(p_brand || ' water'), 'title': 'Ingredients', 'ord': 0}, {'kind': 'usage', 'score': length('Apply ' || p_name), 'title': 'How to use', 'ord': 1}, {'kind': 'ingredients', 'score': length(p_type), 'title': 'Material', 'ord': 2}]) AS x FROM part)
SELECT part, x.kind AS kind, arg_max(x.title, (x.score, -x.ord)) AS title, max(x.score) AS score FROM e GROUP BY part, x.kind""")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded sections by kind; of several of a kind the richest one (twice its items plus its length), the earlier on ties."""
    entries = pages(spark, sf_dir).select("part", F.posexplode(M.accordions(F.col("html"))).alias("ord", "x")).withColumn("kind", M.section_type(F.col("x.title"))).where("kind is not null")
    score = 2 * F.size("x.items") + F.length("x.content")
    best = entries.groupBy("part", "kind").agg(F.max(F.struct(score.alias("score"), (-F.col("ord")).alias("ord"), F.col("x.title").alias("title"))).alias("b"))
    return best.select("part", "kind", F.col("b.title").alias("title"), F.col("b.score").alias("score"))


@query("""SELECT p_partkey AS part, 1 AS blocks, 3 AS items, true AS product, true AS breadcrumb, false AS article, p_name AS name, CAST(p_retailprice AS VARCHAR) AS price, p_name || ':' || p_size AS state_products, 1 AS states FROM part""")
def page_json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-LD: blocks that parse, their items down into graphs, their types, values at any depth; and products in a script's state."""
    html = F.col("html")
    rows = pages(spark, sf_dir).select("part", M.ld_blocks(html).alias("blocks"), M.script_json(html).alias("states"))
    rows = rows.withColumn("items", F.flatten(F.transform("blocks", M.flat_items)))
    items = F.col("items")
    found = M.nested_products(F.col("states")[0])
    shown = F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["name"], x["price"])), ",")
    return rows.select("part", F.size("blocks").alias("blocks"), F.size("items").alias("items"), M.has_type(items, "Product").alias("product"), M.has_type(items, "breadcrumblist").alias("breadcrumb"), M.has_type(items, "Article").alias("article"), M.deep_value(F.col("blocks")[0], F.lit("title,name")).alias("name"), M.deep_value(F.col("blocks")[0], F.lit("price")).alias("price"), shown.alias("state_products"), F.size("states").alias("states"))


@query("""SELECT p_partkey AS part, p_brand || ' ' || p_size || ' a b' AS texts, true AS same_key, 2 AS listed, 1 AS single, 0 AS none, 'Red,S,' || p_brand AS options, 'cold ' = left(p_name, 5) AS cold, CASE WHEN left(p_name, 5) = 'cold ' THEN 'cold ' ELSE '' END AS prefix,
       true AS same_text, p_size = 7 AS same_number, p_size AS path_value, 'b' AS second FROM part""")
def json_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all leaves, equal keys in any order, lists, option values, common prefixes, equal values and values at paths."""
    part = table(spark, sf_dir, "part")
    size, brand = F.col("p_size").cast("string"), F.col("p_brand")
    nested = F.concat(F.lit('{"x": "'), brand, F.lit('", "n": {"size": '), size, F.lit(', "l": ["a", " b ", null]}}'))
    swapped = F.concat(F.lit('{"n":{"l":["a"," b ",null],"size":'), size, F.lit('},   "x": "'), brand, F.lit('"}'))
    product = F.concat(F.lit('{"variants": [{"option1": "Red", "option2": " S "}, {"option1": "red", "option2": "'), brand, F.lit('", "option3": ""}]}'))
    names = F.array(F.col("p_name"), F.lit("cold brew"), F.lit("cold snap"))
    equal = M.values_equal(F.concat(F.lit("  "), F.upper("p_name")), F.col("p_name"))
    return part.select(
        F.col("p_partkey").alias("part"), M.all_texts(nested).alias("texts"), (M.canonical_json(nested) == M.canonical_json(swapped)).alias("same_key"), F.size(M.as_list(F.lit('["a", "b"]'))).alias("listed"), F.size(M.as_list(nested)).alias("single"),
        F.size(M.as_list(F.lit(None).cast("string"))).alias("none"), F.array_join(M.option_values(product), ",").alias("options"), F.startswith("p_name", F.lit("cold ")).alias("cold"), M.common_prefix(names).alias("prefix"), equal.alias("same_text"), M.values_equal(size, F.lit("7.0")).alias("same_number"),
        F.get_json_object(nested, "$.n.size").cast("int").alias("path_value"), F.trim(F.get_json_object(nested, "$.n.l[1]")).alias("second"),
    )


POLICY_KINDS = {"shipping": "shipping|delivery", "returns": "return|refund|exchange", "privacy": "privacy", "terms": "terms"}
_PATH = "CASE p_partkey % 3 WHEN 0 THEN '/privacy' WHEN 1 THEN '/refunds' ELSE '/faq' END"


@query("""SELECT p_partkey AS part, kind, CASE WHEN kind = 'shipping' THEN '/policies/shipping' WHEN kind = 'returns' THEN '/pages/returns' WHEN kind = 'privacy' AND p_partkey % 3 = 0 THEN '/privacy' ELSE '/policies/' || kind END AS url,
       CASE WHEN kind IN ('shipping', 'returns') THEN 'footer' WHEN kind = 'privacy' AND p_partkey % 3 = 0 THEN 'nav' WHEN p_partkey % 2 = 0 THEN 'canonical' ELSE 'guess' END AS source
FROM part, (VALUES ('shipping'), ('returns'), ('privacy'), ('terms')) AS k(kind)""")
def policy_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One policy page of each kind: the footer's links go first, then the menu's, the platform's own paths and guesses."""
    rows = pages(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.expr(_PATH).alias("extra")), "part")
    menu = F.concat(M.navigation(F.col("html")), F.array(F.struct(F.col("extra").alias("url"), F.lit("").alias("text"))))
    found = [rows.select("part", F.explode(M.footer_links(F.col("html"))).alias("x"), F.lit(0).alias("ord")), rows.select("part", F.explode(menu).alias("x"), F.lit(1).alias("ord"))]
    linked = found[0].unionByName(found[1]).select("part", "ord", F.col("x.url").alias("url"), F.coalesce(*[F.when(F.regexp_like(F.lower(F.concat_ws(" ", "x.text", "x.url")), F.lit(p)), k) for k, p in POLICY_KINDS.items()]).alias("kind")).where("kind is not null")
    own = rows.select("part", F.explode(F.array(*map(F.lit, POLICY_KINDS))).alias("kind")).select("part", F.when(F.col("part") % 2 == 0, 2).otherwise(3).alias("ord"), F.concat(F.lit("/policies/"), "kind").alias("url"), "kind")
    best = linked.unionByName(own).groupBy("part", "kind").agg(F.min(F.struct("ord", "url")).alias("b"))
    names = F.element_at(F.array(*map(F.lit, ("footer", "nav", "canonical", "guess"))), F.col("b.ord") + 1)
    return best.select("part", "kind", F.col("b.url").alias("url"), names.alias("source"))
