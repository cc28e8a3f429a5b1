import json
from collections import Counter

from pyspark.sql import functions as F

from shelfscope.llm.html_wrapper import extract_main_text, generalised, main_text, page_hash, parse, places_of, places_sought, region_of, wrapper_of
from shelfscope.llm.preference import format_preferences
from shelfscope.llm.urlfilter import filter_urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), (None, "/x", "block")]


def judged(spark, urls, rules=RULES, **options):
    df = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)], "page_id long, url string, html string").repartition(3)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string"), **options).collect()}


def test_url_rules_by_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "http://ORG/", "https://a.Example.org/es/x?y", "http://example.org/en/12#z", "http://badexample.org/es/", "http://x.com/fr/", "http://com/de/1", "http://x.com", "a://b://c/d", "http://org", "http://u@x.org:80/", "http://a..org/q", "http://x.com/de"]
    urls += [f"http://h{i % 3}.example.org/{'es' if i % 2 else 'en'}/{i}" for i in range(200)] + ["http://hot.com/de/1"] * 300
    for options in ({}, {"ranges": 64, "sample": 50}):
        got = judged(spark, urls, **options)
        assert len(got) == len(urls)
        for i, u in enumerate(urls):
            host, path = "", ""
            if u and "://" in u:
                rest = u.split("://", 1)[1]
                cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
                host, tail = rest[:cut].lower(), rest[cut:]
                path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
            fits = [(len(h + p), h + p, v) for h, p, v in RULES if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
            best = max(fits, default=(0, None, "allow"))
            assert got[i] == (host, path, best[1], best[2])


def test_url_edges(spark):
    assert judged(spark, []) == {}
    assert judged(spark, ["http://a.b/c"], rules=[("zz", "/", "block")])[0] == ("a.b", "/c", None, "allow")
    assert judged(spark, ["http://a.b/c"], rules=[("a.b", "/", "allow"), ("a.b", "/", "block")])[0][3] == "block"


PAGE = "<html><head><title>x</title></head><body><nav><ul><li><a>m</a></ul></nav><div class='ad'>buy</div><article><h1>T{n}</h1>{body}</article><footer>f</footer></body></html>"


def test_wrapper_generalises():
    wrapper = None
    for n, body in enumerate(["<p>a", "<p>a<p>b<p>c", "<p>q<ul><li>1<li>2</ul>", "<h2>x</h2><p>y<h2>z</h2><p>w"]):
        wrapper = generalised(wrapper, wrapper_of(parse(PAGE.format(n=n, body=body))))
    path, constants, _ = region_of(wrapper)
    assert path[-1] == "article"
    article = wrapper[1][0][0][1][0][0][1][-1][0] if wrapper[1][0][0][0] == "html" else wrapper
    assert any(i[2] for i in article[1])  # a repeat
    assert any(i[1] for i in article[1])  # an option
    assert constants == []


def alone(html):
    """Its text as the only page of a host."""
    return main_text(html, *region_of(wrapper_of(parse(html), page_hash(html))))


def test_main_text_cases():
    assert main_text(PAGE.format(n=1, body="<p>a &amp; b<br>c\n d<p>e</p>"), None, None) == "T1\n\na & b c d\n\ne"
    assert main_text("<article><!-- no <p>x</p> --><p>y<script>var t='</p>'</script>z", None, None) == "yz"
    assert alone("<body><p>a<div class='comments'><p>no</div><form>no</form><aside>no</aside><p>b") == "a\n\nb"
    assert main_text(None, None, None) == main_text("", None, None) == ""
    assert main_text("plain &lt;text", None, None) == "plain <text"
    assert main_text("<p>" * 5000 + "x", None, None) == "x"


def test_extract_all_pages(spark):
    rows = [(i, f"http://h{i % 2}.x/{i}", PAGE.format(n=i, body=f"<p>para {i}")) for i in range(20)] + [(20, None, None), (21, "http://h0.x/q", ""), (1, "http://h1.x/1", PAGE.format(n=1, body="<p>again"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in extract_main_text(df).collect())
    assert len(got) == 23
    assert (3, "T3\n\npara 3", 10) in got
    assert (1, "T1\n\nagain", 9) in got
    assert got[-2:] == [(20, "", 0), (21, "", 0)]
    assert extract_main_text(df.limit(0)).count() == 0


def test_constant_text_outside_articles(spark):
    page = "<body><div id=top>Welcome</div><div id=c><p>{0} text {0} text {0} text</div></body>"
    df = spark.createDataFrame([(i, "http://h/x", page.format(f"w{i}")) for i in range(5)], "page_id long, url string, html string")
    assert {r["text"] for r in extract_main_text(df).collect()} == {f"w{i} text w{i} text w{i} text" for i in range(5)}


def test_text_of_single_pages_is_no_constant(spark):
    page = "<body><div id=top>Welcome</div><div id=c>{1}<p>{0} text {0} text {0} text</div></body>"
    extra = ["<h2>only here</h2>", "<ul><li>one</li></ul>", "<pre>code</pre>", "", "", ""]
    df = spark.createDataFrame([(i, "http://h/x", page.format(f"w{i}", e)) for i, e in enumerate(extra)], "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in extract_main_text(df).collect()}
    tail = "w{0} text w{0} text w{0} text"
    assert [got[i] for i in range(6)] == ["only here\n\n" + tail.format(0), "one\n\n" + tail.format(1), "code\n\n" + tail.format(2), *(tail.format(i) for i in (3, 4, 5))]


def test_copies_of_a_page_count_once(spark):
    page = "<body><div id=top>Welcome</div><div id=c><p>{0} text</p></div></body>"
    rows = [(i, "http://h/x", page.format("same")) for i in range(5)] + [(9, "http://g/x", page.format(w)) for w in ("a", "a", "a", "b")]
    got = sorted(r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect())
    assert len(got) == 9
    assert all(t.endswith(" text") for t in got)


def test_constants_survive_an_odd_page():
    pages = [f"<body><div id=top>Welcome</div><div id=c><p>w{i} text</p></div></body>" for i in range(40)] + ["<body><h1>Not found</h1></body>"]
    wrapper = None
    for html in pages + pages[:5]:
        wrapper = generalised(wrapper, wrapper_of(parse(html), page_hash(html)))
    assert region_of(wrapper)[1] == [[["root", "body", "div.top"], "Welcome"]]


def test_shares_are_of_all_distinct_pages(spark):
    page = "<body>{1}<div id=c><p>w{0} text w{0} text</p></div></body>"
    having = [page.format(i, "<div id=top>Welcome</div>") for i in range(300)]
    last = sorted(map(page_hash, having))[31]
    lacking = [p for i in range(300, 420) if page_hash(p := page.format(i, "")) > last]  # so the 32 smallest hashes are of pages that have it
    assert len(lacking) > 60  # fewer than nine in ten have it
    rows = [(i, "http://h/x", p) for i, p in enumerate(having + lacking[:60])]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert all(got[i].startswith("Welcome\n\n") for i in range(300))


def test_places_are_those_of_the_pages_in_the_wrapper():
    pages = [f"<body><div id=top>Hi</div>{'<h3>s</h3><p>x' * (i % 4)}<ul class=menu><li><a>a</a><li><a>b{i % 3}</a></ul>{'<p>same</p>' if i % 2 else ''}<div id=c><p>w{i}</div></body>" for i in range(40)]
    wrapper = counted = None
    for html in pages + pages[:7]:
        wrapper, counted = generalised(wrapper, wrapper_of(parse(html), page_hash(html))), generalised(counted, wrapper_of(parse(html), None))
    plan, counts = json.loads(json.dumps(places_sought(counted))), Counter()
    for html in pages:
        counts.update(places_of(wrapper_of(parse(html), None), plan))
    assert counts[0] == 40
    assert region_of(counted, counts) == region_of(wrapper)


def test_names_of_containers_do_not_drop_the_page():
    kept = [
        "<html class='no-search'><body class='has-sidebar'><p>x</body>",
        "<body class='sidebar'><main class='search'><p>x</main>",
        "<article class='post has-comments'><p>x</article>",
        "<div id='content' class='no-sidebar'><p>x</div>",
        "<div id='content' class='sidebar'><p>x</div>",
        "<div class='widget'><article><p>x</article></div>",
        "<div data-id='sidebar' data-hidden='1' title='id=menu'><p>x</div>",
        "<p class='share-price'>x",
        "<p>x<div class='comments-area'>no</div><div class='site-footer'>no</div><div class='siteSidebar'>no</div>",
        "<main><p>x</main><div class='comments'><article>no</article></div>",
        "<p>some words x<div class='comment'><div class='content'>no</div></div>",
        "<p>some words x<div class='main-menu'>no</div>",
    ]
    assert [alone(html).removeprefix("some words ") for html in kept] == ["x"] * len(kept)


def shop(k, extra=""):
    """A page whose names mean nothing: a menu of links, the article with a line that all have, a foot note."""
    menu = "".join(f"<li><a href='/{k}{j}'>link {k} {j} more</a></li>" for j in range(5))
    return f"<body><div class='x1'><ul>{menu}</ul></div><div class='x2'><h1>Title {k}</h1><p>{f'word{k} ' * 30}</p>{extra}<div class='q7'>Follow us</div></div><div class='x3'>Foot note</div></body>"


def test_the_wrapper_decides_where_names_mean_nothing(spark):
    pages = [shop(k, f"<p class='promotion'>own {k}</p><div class='related-work'>also {k}</div>" if k == 2 else "") for k in range(8)]
    rows = [(k, f"http://h/{k}", html) for k, html in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    want = {k: f"Title {k}\n\n" + " ".join([f"word{k}"] * 30) + ("\n\nown 2\n\nalso 2" if k == 2 else "") for k in range(8)}
    assert got == want
    assert all(main_text(html) != want[k] for k, html in enumerate(pages))  # without the wrapper the text is wrong
    right, kept, there = 0, 0, 0
    for k in range(8):
        a, b = set(got[k].split()), set(want[k].split())
        right, kept, there = right + len(a & b), kept + len(a), there + len(b)
    assert right / kept == right / there == 1


def test_named_parts_go_if_two_pages_have_them():
    pages = [f"<body><article><h1>T{k}</h1><p>text {k}</p><div class='ad'>offer {k}</div></article></body>" for k in range(3)]
    wrapper = None
    for html in pages:
        wrapper = generalised(wrapper, wrapper_of(parse(html), page_hash(html)))
    assert [main_text(html, *region_of(wrapper)) for html in pages] == [f"T{k}\n\ntext {k}" for k in range(3)]


def test_deep_and_long_pages(spark):
    deep = "<div>" * 3000 + "x<nav>menu</nav>y" + "</div>" * 3000
    mixed = ["<div>" + "".join(("<p>a</p>", "<pre>b</pre>", "<h2>c</h2>")[(i * 7 + k * i * i) % 3] for i in range(2000)) + "</div>" for k in range(3)]
    rows = [(0, "http://d/", deep), (1, "http://d/2", deep + "z"), *((k + 2, "http://m/", m) for k, m in enumerate(mixed))]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "x\n\ny"
    assert got[1].endswith("z")
    assert all(len(got[k].split()) == 2000 for k in (2, 3, 4))


def host(spark, pages):
    rows = [(k, "http://h/x", html) for k, html in enumerate(pages)]
    return [r["text"] for r in sorted(extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect())]


def test_names_that_hold_main_are_no_article(spark):
    page = "<div class='{1}'><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></div><div class=text><h1>Title {0}</h1><p>Words of {0}</div>"
    for name in ("main-menu", "main-nav", "top-menu", "menu main", "mainMenu"):
        assert host(spark, [page.format(k, name) for k in range(5)]) == [f"Title {k}\n\nWords of {k}" for k in range(5)]
    assert alone("<div class='main-nav'><ul><li><a>Home</a></ul></div><div><p>The article.</p></div>") == "The article."


def test_shared_lines_and_references_of_articles_stay(spark):
    refs = "<ul>" + "".join(f"<li><a href=/{k}>Reference {k}</a></li>" for k in range(3)) + "</ul>"
    page = f"<body><div class=q>Hello</div><article><h1>T{{0}}</h1><p>Text {{0}}</p><p>The same line</p>{refs}</article></body>"
    tail = "The same line\n\nReference 0\n\nReference 1\n\nReference 2"
    assert host(spark, [page.format(k) for k in range(4)]) == [f"T{k}\n\nText {k}\n\n{tail}" for k in range(4)]


def test_constants_go_by_place(spark):
    page = "<body><div class=a1><p>Home</p></div><div class=a2><p>Home</p><p>{0} long text of this page</p><p>{1}</p></div></body>"
    pages = [page.format(f"w{k}", f"end {k}") for k in range(4)] + [page.format("w4", "Home")]
    got = host(spark, pages)
    assert got[4].endswith("Home") and got[4].count("Home") == 1 or got[4].count("Home") == 2
    assert all("long text" in t for t in got)


def test_text_after_deep_elements_stays(spark):
    deep = "".join(f"<div class=c{k}>t{k} " for k in range(900))
    assert host(spark, [deep + "last" + "</div>" * 900 + "z"])[0].split() == [f"t{k}" for k in range(900)] + ["last", "z"]


#: Templates with the names that sites use: menu, article, other parts.
TEMPLATES = [
    "<body><nav class='main-menu'><ul>{menu}</ul></nav><div class='entry-content'>{text}</div><div class='post-footer'>Filed under {k}</div></body>",
    "<body><div id='main-nav'><ul>{menu}</ul></div><div id='content'>{text}</div><div class='sidebar-main'><p>Offer {k}</p></div><footer>All rights {k}</footer></body>",
    "<body><header><div class='site-title'>Site</div></header><main><div class='breadcrumbs'>a / b{k}</div>{text}<div class='related-posts'><a>Other {k}</a></div></main></body>",
    "<body><div class='top'><ul>{menu}</ul></div><article class='post'>{text}<div class='share-buttons'>Share</div></article><section class='comments'><p>Reader {k}</p></section></body>",
    "<body><div class='wrap'><div class='story'>{text}</div><div class='newsletter-signup'>Join {k}</div></div></body>",
    "<body><div class='page'><div class='cookie-notice'>We use cookies {k}</div><div role='main'>{text}</div><div class='ad-box'>Buy {k}</div></div></body>",
]


def test_common_templates(spark):
    menu = "".join(f"<li><a href=/{k}>Section {k}</a></li>" for k in range(6))
    rows, want = [], {}
    for t, template in enumerate(TEMPLATES):
        for k in range(6):
            paragraphs = [f"Title {t} {k}"] + [f"para{t}{k}{j} " * 12 for j in range(1 + k)]
            text = f"<h1>{paragraphs[0]}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs[1:])
            rows.append((10 * t + k, f"http://site{t}/{k}", template.format(menu=menu, text=text, k=f"n{k}")))
            want[10 * t + k] = "\n\n".join(p.strip() for p in paragraphs)
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    right = sum(len(set(got[i].split()) & set(want[i].split())) for i in want)
    assert right == sum(len(set(w.split())) for w in want.values())  # recall of words 1
    assert right / sum(len(set(got[i].split())) for i in want) >= 0.99


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://h/1", "<p>x", "a", "b", "c")], "page_id long, url string, html string, host string, path string, parts string")
    assert [r["text"] for r in extract_main_text(df).collect()] == ["x"]


def test_preferences(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "good"), (2, 0, "system", "s"), (2, 1, "user", "q"), (2, 2, "assistant", "bad"), (2, 3, "user", "why"), (3, 0, None, None), (4, 0, "user", "a"), (5, 0, "user", "a"), (None, 0, "user", "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    pairs = spark.createDataFrame([(1, 1, 2), (2, 3, None), (3, 4, 5), (4, None, None)], "pair_id long, chosen long, rejected long")
    got = {r["pair_id"]: r for r in format_preferences(pairs, df).collect()}
    r = got[1]
    assert (r["shared_turns"], r["prompt"]) == (2, "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n")
    a, b = map(int, r["chosen_loss"].split(":"))
    assert r["chosen"][a:b] == "good<|end|>\n"
    a, b = map(int, r["rejected_loss"].split(":"))
    assert r["rejected"][a:b] == "bad<|end|>\n"
    assert "why" in r["rejected"]
    assert (got[2]["prompt"], got[2]["chosen"], got[2]["rejected"]) == ("", "<||>\n<|end|>\n", "")
    assert (got[3]["shared_turns"], got[3]["chosen"], got[3]["rejected"]) == (1, "", "")
    assert (got[4]["shared_turns"], got[4]["prompt"]) == (0, "")
    assert format_preferences(pairs.limit(0), df).count() == 0
    twice = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "user", "x" * 200_000)], "conv_id long, turn long, role string, text string")
    r = format_preferences(pairs.where("pair_id = 1"), twice).first()
    assert (r["shared_turns"], len(r["rejected"])) == (1, 200_000 + len("<|user|>\n<|end|>\n"))


def test_preference_pairs_of_extreme_ids(spark, tmp_path):
    from shelfscope.llm.queries import QUERIES

    turns = [(c, k, role, f"{role} {c}") for c in (2**63 - 1, 2**62 + 1, -(2**63), -(2**63) + 1, 7, 8) for k, role in enumerate(("user", "assistant"))]
    turns += turns[:2] + [(None, 0, "assistant", "x"), (9, 0, "user", "x" * 100_000)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("side", F.lit("clash")).withColumn("pair_id", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["pair_id"]: r for r in QUERIES["op5_preference_pairs"](spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted({c for c, *_ in turns if c not in (None, 9)})
    assert "assistant 8" in got[7]["rejected"] and f"assistant {-(2**63) + 1}" in got[-(2**63)]["rejected"]
    assert got[2**63 - 1]["rejected"] == got[8]["rejected"] == ""


def test_queries_with_sql_give_its_rows(spark):
    import os

    import duckdb

    from shelfscope.llm.queries import ORACLE, QUERIES

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        return
    db = duckdb.connect()
    for name in ("pages", "conversations", "documents", "labels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    for name, sql in ORACLE.items():
        ours, theirs = QUERIES[name](spark, data).toPandas(), db.execute(sql).df()
        columns = sorted(ours.columns)
        assert columns == sorted(theirs.columns)
        plain = lambda frame: sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))  # noqa: E731, B023
        assert plain(ours) == plain(theirs)
        if name.startswith("op5"):
            assert ours["shared_turns"].max() > 1 and (ours["prompt"] != "").any()
