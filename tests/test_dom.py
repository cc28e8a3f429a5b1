"""Element table and page parts against html.parser and plain loops."""

import random
from html.parser import HTMLParser

import pytest

from shelfscope.operators import page_parts as P
from shelfscope.operators.elements import VOID, attribute, element_table, has_attribute, page_tables, text_table, texts_within, tokens


class Stack(HTMLParser):
    """(tag, parent's number, depth, texts within) of every element of well-formed markup, in order."""

    def __init__(self):
        super().__init__()
        self.found, self.open = [], []

    def handle_starttag(self, tag, attrs):
        self.found.append([tag, self.open[-1] if self.open else None, len(self.open), []])
        if tag not in VOID:
            self.open.append(len(self.found) - 1)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        if text := " ".join(data.split()):
            for k in self.open:
                self.found[k][3].append(text)


def grown(rnd, depth=0):
    out = []
    for _ in range(rnd.randint(0, 4)):
        tag = rnd.choice(["div", "ul", "li", "p", "span", "a", "table", "tr", "td", "br", "text"])
        if tag == "text" or depth > 7:
            out.append(rnd.choice([" word ", "two\n words", " ", "x"]))
        elif tag == "br":
            out.append("<br class='y'>")
        else:
            out.append(f"<{tag} class=\"c{rnd.randint(0, 3)} it's\" data-k=a>{grown(rnd, depth + 1)}</{tag}>")
    return "".join(out)


def test_elements_equal_a_parser(spark):
    rnd = random.Random(4)
    htmls = [grown(rnd) for _ in range(120)] + ["", "only text", "<div>" * 150 + "deep" + "</div>" * 150, "<p>" + "long " * 50_000 + "</p>"]
    df = spark.createDataFrame(list(enumerate(htmls)), "page long, html string").repartition(5)
    toks, els = page_tables(df, ["page"])
    texts = texts_within(els, text_table(toks, ["page"]), ["page"], "inner").collect()
    by = {}
    for r in texts:
        by.setdefault(r["page"], []).append(r)
    for page, html in enumerate(htmls):
        parser = Stack()
        parser.feed(html)
        parser.close()
        got = sorted(by.get(page, []), key=lambda r: r["pos"])
        number = {r["pos"]: k for k, r in enumerate(got)}
        assert [(r["tag"], number.get(r["parent"]), r["depth"], r["inner"]) for r in got] == [(t, p, d, " ".join(x)) for t, p, d, x in parser.found]


def test_markup_without_end_tags(spark):
    html = "<ul><li>a<ul><li>b<li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3</table><p>x<p>y<div>open <!-- <p> --><script>if (a<b) '</div>'</script><img src=q>&amp;"
    df = spark.createDataFrame([(1, html), (2, None), (3, "<p title=\"no end>q</p> < & <b>x</b>")], "page long, html string")
    toks = tokens(df, ["page"])
    els = element_table(toks, ["page"])
    inner = {(r["page"], r["tag"], r["pos"]): r["inner"] for r in texts_within(els, text_table(toks, ["page"]), ["page"], "inner").collect()}
    first = lambda tag: [v for k, v in sorted(inner.items()) if k[0] == 1 and k[1] == tag]
    assert first("li") == ["a b c", "b", "c", "d"]
    assert first("tr") == ["1 2", "3"] and first("td") == ["1", "2", "3"]
    assert first("p") == ["x", "y open &"] and first("div") == ["open &"] and first("script") == [""]
    assert [k[1] for k in inner if k[0] == 3] == ["b"] and not [k for k in inner if k[0] == 2]


def test_attributes(spark):
    tags = ["<a href='/x' class=\"p q\">", "<a data-href='no' href=/y>", "<a title=\"href='z'\">", "<a HREF = \"/A>b\" hidden>", "<a>", "<a hreflang=en href>"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(tags)], "k int, t string").select("k", attribute(_col("t"), "href").alias("h"), has_attribute(_col("t"), "href").alias("there"), attribute(_col("t"), "class").alias("c")).orderBy("k").collect()
    assert [(r["h"], r["there"], r["c"]) for r in got] == [("/x", True, "p q"), ("/y", True, ""), ("", False, ""), ("/A>b", True, ""), ("", False, ""), ("", True, "")]


def _col(name):
    from pyspark.sql import functions as F

    return F.col(name)


@pytest.fixture(scope="module")
def parts(spark):
    pages = [
        (1, "https://s.com/", "<nav><ul><li><a href='/collections/a'>A</a><ul><li><a href='/collections/b'>B</a><ul><li><span>Group</span><ul><li><a href='/collections/c'>C</a><ul><li><a href='/collections/deep'>too deep</a></li></ul></li></ul></li></ul></li></ul></li><li><a href='/collections/A/'>again</a></li></ul></nav>"),
        (2, "https://s.com/x/", "<ul><li><a href='/one'>One</a><li><a href='/cart'>Cart</a><li><a href='https://other.com/two'>Two</a><li><a href='/p.html'>P</a></ul>"),
        (3, "https://s.com/", "<nav><ul><li><a href='/one'>One</a></li></ul></nav><nav><ul><li><a href='/shop/x'>X</a></li><li><a href='/shop/y'>Y</a></li></ul></nav>"),
        (4, "https://s.com/collections/tops", "<main><div class='product-item'><a href='/products/tops'>self</a></div><div><p><a href='https://s.com/products/bare'>b</a> Rs. 1,200 sold out</p></div><div class='card'><div><a href='/products/bare'>twice</a></div></div></main>"),
        (5, "u", "<div class=tier><h2>Solo</h2>$5</div>"),
        (6, "u", "<div class=plan><h3>A</h3>$5 <span class=old-price>$3</span></div><div class=plan><div class=plan-title>$9</div><h3>B</h3>9 EUR</div><div class=plan><h3>a</h3>$7</div><div class=plan>$8</div>"),
        (7, None, ""),
    ]
    df = spark.createDataFrame(pages, "page long, url string, html string").repartition(3)
    return df, *page_tables(df, ["page"])


def test_menus(parts):
    df, toks, els = parts
    got = {}
    for r in P.menu_items(df, toks, els, ["page"]).collect():
        got.setdefault(r["page"], []).append((r["rank"], r["title"], r["url"].removeprefix("https://s.com"), r["path"]))
    assert sorted(got[1]) == [(1, "A", "/collections/a", ["A"]), (2, "B", "/collections/b", ["A", "B"]), (3, "C", "/collections/c", ["A", "B", "Group"])]
    assert sorted(got[2]) == [(1, "One", "/one", [])]  # no menu: links of the page, permissively
    assert sorted(got[3]) == [(1, "X", "/shop/x", []), (2, "Y", "/shop/y", [])]
    assert 7 not in got


def test_cards_and_plans(parts):
    df, toks, els = parts
    cards = [tuple(r) for r in P.product_cards(df, toks, els, ["page"]).collect()]
    assert cards == [(4, 1, "bare", "Bare", "https://s.com/products/bare", "Rs. 1,200", 1200.0, False, None)]
    plans = sorted(tuple(r) for r in P.plan_cards(toks, els, ["page"]).collect())
    assert plans == [(6, 1, "A", "$5", 5.0, None, None, []), (6, 2, "B", "$9", 9.0, None, None, [])]


def test_no_pages(spark):
    df = spark.createDataFrame([], "page long, url string, html string")
    toks, els = page_tables(df, ["page"])
    assert els.count() == P.menu_items(df, toks, els, ["page"]).count() == P.folded_sections(toks, els, ["page"]).count() == P.plan_cards(toks, els, ["page"]).count() == 0


def test_tables_in_place_equal_windows(spark):
    from shelfscope.operators.elements import page_rows

    rnd = random.Random(4)
    bits = "<div>|</div>|<p>|</p>|<li>|</li>|<ul>|</ul>|<td>|<tr>|</tr>|<table>|</table>|<thead>|<tbody>|<br>|<img src='a>b'>|<a/>|x &amp; y| \n|<!-- c -->|<script>a<b</script>|<script>|<|<1|</|<DIV CLASS=x>|<dd>|<dt>|</dt>|<option>|<svg><p></svg >|</p|<é>|<!doctype html>".split("|")
    pages = [(k, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60)))) for k in range(300)] + [(999, None)]
    df = spark.createDataFrame(pages, "page long, html string").repartition(3)
    toks = tokens(df, ["page"])
    names = ["page", "pos", "end", "depth", "parent", "tag", "token"]
    wanted = sorted(map(str, element_table(toks, ["page"]).select(*names).collect()))
    own, els = page_tables(df, ["page"])
    assert sorted(map(str, els.select(*names).collect())) == wanted
    assert sorted(map(str, text_table(own, ["page"]).collect())) == sorted(map(str, text_table(toks, ["page"]).collect()))
    # Nothing is shuffled or sorted to find elements.
    assert "Exchange" not in page_rows(df.coalesce(1), ["page"])._jdf.queryExecution().executedPlan().toString().split("Coalesce")[0]


@pytest.mark.parametrize("name", ["menu_paths", "listing_cards", "outer_plan_cards", "folded_page_sections"])
def test_parts_are_sought_within_the_row_of_a_page(spark, name):
    from shelfscope import registry

    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # Only what deals out the two tables of pages; no page is shuffled, joined or sorted after that.
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan and "Sort" not in plan and "Window" not in plan


def test_arrays_of_pages_equal_their_tables(spark):
    from shelfscope.operators.elements import gathered, page_arrays

    html = "<nav class='Main x'><ul><li><a href='/c/a'>A &amp; b<li>&nbsp;</ul></nav><b><i>q</b></i>"
    df = spark.createDataFrame([(1, html), (2, "<p>")], "page long, html string")
    toks, els = page_tables(df, ["page"])
    names = ["page", "els", "texts"]
    assert sorted(map(str, page_arrays(df).select(names).collect())) == sorted(map(str, gathered(toks, els, ["page"]).select(names).collect()))


def test_elements_with_one_title_do_not_double_it(spark):
    df = spark.createDataFrame([(1, "<details><details><summary>Title one</summary><p>enough of content</p></details></details>")], "page long, html string")
    got = P.folded_sections(*page_tables(df, ["page"]), ["page"]).collect()
    assert [(r["at"], r["title"], r["content"]) for r in got] == [(0, "Title one", "enough of content")]


def test_harvested_menus_write_no_tables_of_pages(spark):
    from shelfscope import registry

    plan = registry.queries()["harvested_menu"](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "Window" not in plan


def test_shop_pages_are_dealt_out_before_they_are_read(spark):
    from shelfscope.plans.markup import pages

    assert "RepartitionByExpression" in pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_menus_against_collections_shuffle_no_links(spark):
    from shelfscope import registry

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2k")  # below the parts' table, above their types
    try:
        plan = registry.queries()["harvested_menu"](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2


def test_few_elements_are_asked_for_sections(spark):
    """Sections are asked of elements that may be part of one; marks in capitals and in attributes alone count, plain elements and links do not."""
    from shelfscope.operators.elements import page_arrays
    from shelfscope.operators.page_parts import sections_of

    html = "<div><p class='x'>plain</p><a href='/y'>link</a></div>" + "".join([
        "<div DATA-ACCORDION data-title='By data'><p>Told by an attribute</p></div>",
        "<div class='ACCORDION-Item'><h4 class='Accordion-HEADER'><button>In capitals</button></h4><div class='ACCORDION-BODY'>Body of the item</div></div>",
        "<a Data-Target='#t9'>Controlled</a><div ROLE='tabpanel' id='t9'>Text of the panel</div><b ARIA-CONTROLS='t8'>Named by aria</b><div role=tabpanel id=t8>Another long text</div>",
        "<details><summary>Folded up</summary>Some folded text</details>",
        "<div class='RTE'><h3>Active formula</h3><p>Words of it</p></div>",
    ])
    pages = page_arrays(spark.createDataFrame([(1, html)], "id long, html string"))
    found = sections_of(pages, ["id"])
    assert {(r["strategy"], r["title"], r["content"]) for r in found.collect()} == {
        (3, "By data", "Told by an attribute"), (2, "In capitals", "Body of the item"), (4, "Controlled", "Text of the panel"), (4, "Named by aria", "Another long text"), (1, "Folded up", "Some folded text"), (6, "Active formula", "Words of it")}
    assert "marked" in found._jdf.queryExecution().optimizedPlan().toString()
