"""What pages hold as trees: elements, menus, product cards, plan cards and folded sections.

The queries read every crawled page, and one shop page made of each part, as the crawled pages are
no shops.  The oracle takes a shop page's parts from the part's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import page_parts as P
from ..operators.elements import elements_of, page_arrays, page_rows
from ..registry import query
from ..sources.catalog import spread, table

#: A shop page by part, in SQL that both engines read.
SHOP_SQL = """'<html lang="en-GB"><body><header><nav class="main"><ul><li><a href="/collections/women">Women<span class="sr-only"> menu</span></a><div class="mega"><ul><li><a href="/collections/' || lower(p_type) || '">' || p_type || '</a><ul><li><a href="/collections/k' || p_partkey || '?x=1">' || p_name || '</a></li></ul></li></ul>'
|| '<ul><li><a href="/collections/new">New &amp; now</a></ul></div></li><li><span>Men</span><ul><li><a href="/collections/men-shoes"><img src="x.png"></a><li><a href="/collections/women/">Again</a></ul></li><li><a href="/pages/about">About</a></li></ul></nav></header>'
|| '<main><div class="product-grid"><div class="card-wrapper"><div class="media"><a href="/products/p' || p_partkey || '?v=1"><img alt="Alt" src="/i.png"></a></div><div><div class="info"><h3 class="card__heading"><a href="/products/p' || p_partkey || '">' || p_name || '</a></h3><div class="price"><span>$ ' || p_size || '.50</span></div></div></div><div class="foot">' || CASE WHEN p_partkey % 2 = 0 THEN 'Sold out' ELSE 'Add to cart' END || '</div></div>'
|| '<div class="card-wrapper"><div><a href="/products/second-one">x</a></div><p>only £5.00 today</p></div><div class="card-wrapper"><a href="/products/klarna">Klarna</a><h2>Klarna</h2></div></div>'
|| '<section class="grid"><div class="plan"><div class="plan-head"><h3>Basic</h3></div><div class="plan-body"><del>$ 99</del><span class="plan-cost">$ ' || p_size || ' / mo</span><ul><li>one<li>two ' || p_brand || '</ul></div></div>' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '<div class="plan"><div><h3>Pro</h3></div><div class="price-box"><span class="was-price">$ 5</span>$ 20.50 /year</div></div>' END || '</section>'
|| '<details><summary>Ingredients</summary><div><p>Made of ' || p_brand || '</p><ul><li>water</li><li>' || p_type || '</li></ul></div></details><div class="accordion-item"><h4 class="accordion-header"><button>How to use</button></h4><div class="accordion-body"><div>Apply ' || p_name || ' twice</div></div></div>'
|| '<div class="collapsible"><h3>Benefits</h3><div class="collapsible-content"><div class="inner">Good for the ' || p_type || '</div></div></div><a href="#tab1">Specs</a><div role="tabpanel" id="tab1"><div>Size is ' || p_size || ' inches</div></div>'
|| '<div class="elementor-toggle-item"><div class="elementor-toggle-title">Questions</div><div class="elementor-toggle-content"><div>Ask the ' || p_brand || ' team</div></div></div><div class="rte"><h3>Active formula</h3><p>Text about ' || p_name || '</p><ul><li>first</li></ul><h3>Nothing here</h3><p>x</p></div></main></body></html>'"""
KEYS = ["origin", "id"]


def all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """origin (crawl or shop), id, url, html."""
    crawl = spread(table(spark, sf_dir, "pages"), "page_id").select(F.lit("crawl").alias("origin"), F.col("page_id").alias("id"), "url", "html")
    shop = spread(table(spark, sf_dir, "part"), "p_partkey").select(F.lit("shop").alias("origin"), F.col("p_partkey").alias("id"), F.lit("https://shop.example/collections/all").alias("url"), F.expr(SHOP_SQL).alias("html"))
    return crawl.unionByName(shop)


@query(f"""WITH pages_ AS (SELECT 'crawl' AS origin, page_id AS id, html FROM pages UNION ALL SELECT 'shop', p_partkey, {SHOP_SQL} FROM part)
SELECT origin, id, len(regexp_extract_all(html, '<(?:div|ul|a|nav|article|main|section|h1|h3|span|footer)[ >]')) AS nested, len(regexp_extract_all(html, '<li[ >]')) AS items, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs,
       CASE origin WHEN 'shop' THEN 10 ELSE 4 END AS deepest_item FROM pages_""")
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every page the number of elements that need a closing tag and have one, of list items and paragraphs, which need none, and the depth of the deepest item."""
    els = elements_of(page_rows(all_pages(spark, sf_dir), KEYS))
    closed = F.col("tag").isin("div", "ul", "a", "nav", "article", "main", "section", "h1", "h3", "span", "footer")
    kinds = els.groupBy(*KEYS).agg(F.count_if(closed & (F.col("end") > F.col("pos"))).alias("nested"), F.count_if(F.col("tag") == "li").alias("items"), F.count_if(F.col("tag") == "p").alias("paragraphs"), F.max(F.when(F.col("tag") == "li", F.col("depth"))).alias("deepest_item"))
    return kinds


@query(rf"""WITH links AS (
    SELECT page_id AS id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS title, unnest(range(1000)[:len(regexp_extract_all(html, '<a href="([^"]*)">', 1))]) AS place FROM pages
),
kept AS (
    SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*') || href AS full_url, row_number() OVER (PARTITION BY id, lower(href) ORDER BY place) AS n FROM links
    WHERE length(href) > 1 AND substr(href, 2) NOT LIKE '%/%' AND href NOT LIKE '%.%' AND NOT regexp_matches(lower(href), '{P.UTILITY}')
)
SELECT 'crawl' AS origin, id, row_number() OVER (PARTITION BY id ORDER BY place)::INT AS rank, trim(title) AS title, full_url AS url, '' AS path FROM kept WHERE n = 1
UNION ALL
SELECT 'shop', p_partkey, x.rank, x.title, 'https://shop.example/collections/' || x.url, x.path FROM (SELECT *, unnest([
    {{'rank': 1, 'title': 'Women', 'url': 'women', 'path': 'Women'}}, {{'rank': 2, 'title': p_type, 'url': lower(p_type), 'path': 'Women>' || p_type}}, {{'rank': 3, 'title': p_name, 'url': 'k' || p_partkey || '?x=1', 'path': 'Women>' || p_type}},
    {{'rank': 4, 'title': 'New & now', 'url': 'new', 'path': 'Women'}}, {{'rank': 5, 'title': 'Men Shoes', 'url': 'men-shoes', 'path': 'Men'}}]) AS x FROM part)""")
def menu_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of the menus with the titles above them."""
    found = P.menus_of(page_arrays(all_pages(spark, sf_dir)), KEYS)
    return found.select(*KEYS, "rank", "title", "url", F.array_join("path", ">").alias("path"))


@query(f"""SELECT 'shop' AS origin, p_partkey AS id, 1 AS rank, 'p' || p_partkey AS handle, p_name AS name, 'https://shop.example/products/p' || p_partkey AS url, '$ ' || p_size || '.50' AS price_text, p_size + 0.5 AS price, p_partkey % 2 <> 0 AS in_stock, '/i.png' AS image FROM part
UNION ALL SELECT 'shop', p_partkey, 2, 'second-one', 'Second One', 'https://shop.example/products/second-one', '£5.00', 5.0, NULL, NULL FROM part
UNION ALL SELECT 'crawl', page_id, 1, '', '', '', '', 0.0, NULL, NULL FROM pages WHERE regexp_matches(html, '<a [^>]*/products/')""")
def listing_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of listings: the card around each link, its name, price and stock; badges are no products."""
    return P.cards_of(page_arrays(all_pages(spark, sf_dir)), KEYS)


@query("""SELECT 'shop' AS origin, p_partkey AS id, x.rank, x.name, x.price_text, x.price, x.period, x.compare_at, x.features FROM (SELECT *, unnest([
    {'rank': 1, 'name': 'Basic', 'price_text': '$ ' || p_size, 'price': p_size + 0.0, 'period': '/mo', 'compare_at': 99.0, 'features': 'one; two ' || p_brand}, {'rank': 2, 'name': 'Pro', 'price_text': '$ 20.50', 'price': 20.5, 'period': '/year', 'compare_at': NULL, 'features': ''}]) AS x
FROM part WHERE p_partkey % 5 <> 0)
UNION ALL SELECT 'crawl', page_id, 1, '', '', 0.0, '', 0.0, '' FROM pages WHERE regexp_matches(html, 'class="[^"]*(plan|pricing|tier|package)')""")
def outer_plan_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of price tables by their outermost cards, whatever is nested in them."""
    return P.plans_of(page_arrays(all_pages(spark, sf_dir)), KEYS).withColumn("features", F.array_join("features", "; "))


@query("""SELECT 'shop' AS origin, p_partkey AS id, x.strategy, x.title, x.content, x.items FROM (SELECT *, unnest([
    {'strategy': 1, 'title': 'Ingredients', 'content': 'Made of ' || p_brand || ' water ' || p_type, 'items': 'water; ' || CASE WHEN length(p_type) >= 5 THEN p_type ELSE '' END}, {'strategy': 2, 'title': 'How to use', 'content': 'Apply ' || p_name || ' twice', 'items': ''},
    {'strategy': 3, 'title': 'Benefits', 'content': 'Good for the ' || p_type, 'items': ''}, {'strategy': 4, 'title': 'Specs', 'content': 'Size is ' || p_size || ' inches', 'items': ''},
    {'strategy': 5, 'title': 'Questions', 'content': 'Ask the ' || p_brand || ' team', 'items': ''}, {'strategy': 6, 'title': 'Active formula', 'content': 'Text about ' || p_name, 'items': 'first'}]) AS x FROM part)
UNION ALL SELECT 'crawl', page_id, 1, '', '', '' FROM pages WHERE regexp_matches(html, '<details|accordion|collapsible|tabpanel|class="rte')""")
def folded_page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that fold open, by six ways of marking them, with their text and list items."""
    found = P.sections_of(page_arrays(all_pages(spark, sf_dir)), KEYS)
    return found.select(*KEYS, "strategy", "title", "content", F.array_join("items", "; ").alias("items"))
