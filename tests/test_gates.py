"""Gates on written pages and pairs."""

from pyspark.sql import functions as F

from shelfscope.plans.gates import blocked_or_empty, needs_browser, online_pairs

LONG = "<body><p>" + "plain words of a page " * 40 + "</p>"
PAGES = [
    (None, None, None, True, True), ("u://x/a", "", None, True, False), ("https://a.com/x", LONG, None, False, False), ("https://a.com/x", LONG, 403, True, False), ("https://a.com/x", "<p>short", None, True, False), ("https://a.com/x", "<p>" + "words " * 400, None, True, False),
    ("https://a.com/x", LONG + "captcha cloudflare", None, True, False), ("https://a.com/x", "<script>captcha cloudflare</script>" + LONG, None, False, False), ("https://a.com/x", "<body>" + "captcha cloudflare words " * 200, None, False, False),
    ("https://a.com/", LONG, None, False, True), ("https://a.com/index.html", LONG, None, False, True), ("https://a.com/our-plans", LONG, None, False, True), ("https://a.com/x", LONG + '<div id="root">', None, False, True), ("https://a.com/x", LONG + "<script>" + "y" * 12_000 + "</script>", None, False, True),
]


def test_fetch_gates(spark):
    df = spark.createDataFrame([(k, *r[:3]) for k, r in enumerate(PAGES)], "k int, url string, html string, status int")
    got = df.select("k", blocked_or_empty(F.col("html"), F.col("status")).alias("b"), needs_browser(F.col("url"), F.col("html")).alias("n")).orderBy("k").collect()
    assert [(r["b"], r["n"]) for r in got] == [r[3:] for r in PAGES]


def test_online_pairs(spark):
    pairs = spark.createDataFrame([("https://r/a", "https://o/a"), ("https://r/b/", "https://o/b"), ("https://r/c", "https://o/c/"), ("https://r/d", None), (None, "https://o/a")], "url string, owner_url string")
    offline = spark.createDataFrame([("https://r/b",), ("https://o/c",), (None,), ("https://r/b/",)], "url string")
    assert sorted(map(str, map(tuple, online_pairs(pairs, offline).collect()))) == sorted(map(str, [("https://r/a", "https://o/a"), ("https://r/d", None), (None, "https://o/a")]))
