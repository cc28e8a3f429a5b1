"""Small cases of the functions and operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from shelfscope.functions import jaccard, parse_number, price_closeness, stem, truncate, url_key
from shelfscope.operators.assignment import greedy_in_order, greedy_one_to_one
from shelfscope.plans.dedup import fold_survivors
from shelfscope.plans.matching import sequence_ratio


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("word", "expected"), [("mascaras", "mascara"), ("dresses", "dress"), ("lips", "lip"), ("dress", "dress"), ("berries", "berry"), ("bus", "bus"), ("gas", "gas")])
def test_stem(spark, word, expected):
    assert one(spark, stem(F.lit(word))) == expected


def test_price_closeness(spark):
    assert one(spark, price_closeness(F.lit(100.0), F.lit(105.0))) > 0.8
    assert one(spark, price_closeness(F.lit(100.0), F.lit(400.0))) == 0
    assert one(spark, price_closeness(F.lit(None).cast("double"), F.lit(4.0))) == 0


def test_price_closeness_at_three_times_the_price(spark):
    import duckdb

    pairs = [(c / 100, 3 * c / 100) for c in range(100, 20000, 3)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs + [(b, a) for a, b in pairs])], "i long, a double, b double")
    ours = [r["x"] for r in frame.select("i", price_closeness(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]
    held = frame.toPandas()  # noqa: F841  (read by the SQL)
    theirs = [r[0] for r in duckdb.sql("SELECT greatest(0.0, 1.0 - abs(ln(a / b)) / ln(3.0)) FROM held ORDER BY i").fetchall()]
    assert [x > 0 for x in ours] == [x > 0 for x in theirs]


def test_staged_pages_of_a_million(spark, tmp_path):
    import duckdb

    from shelfscope import registry

    rows = [(1, 2), (1_000_001, 20), (1_000_002, 4), (2, 1), (1_200_000, 13), (7, 12), (8, 13), (9, None)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    ours = registry.queries()["staged_pages"](spark, str(tmp_path)).collect()
    sql = registry.oracle_sql()["staged_pages"].replace("FROM part", f"FROM '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(tuple(r) for r in ours) == sorted(duckdb.sql(sql).fetchall())


def test_texts(spark):
    assert one(spark, truncate(F.lit("abc def"), 5)) == "abc…"
    assert one(spark, url_key(F.lit("HTTPS://www.A.com/b/?q=1#x"))) == "a.com/b"
    assert one(spark, parse_number(F.lit("from $1,234.50 now"))) == 1234.5
    assert one(spark, parse_number(F.lit("none"))) is None
    assert one(spark, jaccard(F.array(), F.array())) == 0


def test_sequence_ratio_depends_on_order(spark):
    got = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), (None, None)], "a string, b string").select(sequence_ratio("a", "b").alias("r")).toPandas()["r"].tolist()
    assert got == [0.25, 0.5, 1.0]


def test_survivors_are_a_fold(spark):
    rows = [(0, 2, "1", None), (1, 1, None, "H"), (2, 2, None, "C")]
    df = spark.createDataFrame(rows, "n int, priority int, a string, b string")
    items = F.transform(F.sort_array(F.collect_list(F.struct("n", "priority", "a", "b"))), lambda x: F.struct(x["priority"].alias("priority"), x["a"].alias("a"), x["b"].alias("b")))
    got = df.agg(items.alias("xs")).select(fold_survivors(F.col("xs"), ["a", "b"]).alias("x")).first()["x"]
    assert (got["a"], got["b"]) == ("1", "H")


def test_survivors_by_minima_are_the_fold(spark):
    from shelfscope.operators.provenance import survivors, united

    rng = random.Random(9)
    rows = [(k, n, rng.choice([1, 2, 3]), rng.choice([None, f"a{n}"]), rng.choice([None, f"b{n}"]), rng.choice([None, "p1", "p2"]), rng.choice([None, n])) for k in range(60) for n in range(rng.randint(1, 7))]
    want, joined = {}, {}
    for k, n, p, a, b, page, rank in rows:
        have = want.get(k)
        if have is None:
            want[k] = (p, a, b)
        elif p > have[0]:
            want[k] = (p, a if a is not None else have[1], b if b is not None else have[2])
        else:
            want[k] = (have[0], have[1] if have[1] is not None else a, have[2] if have[2] is not None else b)
        record = joined.setdefault(k, [a, []])
        if page and page not in [x[0] for x in record[1]]:
            record[1].append((page, rank))
    for parts in (1, 5):
        given = list(rows)
        rng.shuffle(given)
        df = spark.createDataFrame(given, "k int, n int, priority int, a string, b string, page string, rank int").repartition(parts)
        got = {r["k"]: (r["priority"], r["a"], r["b"]) for r in survivors(df, ["k"], ["n"], "priority", [1, 2, 3], ["a", "b"]).collect()}
        assert got == want
        seen = {r["k"]: (r["a"], r["pages"], r["first_page"], r["first_rank"]) for r in united(df, ["k"], ["n"], "page", "rank", ["a"]).collect()}
        assert seen == {k: (a, len(ps), ps[0][0] if ps else None, next((r for _, r in ps if r is not None), None)) for k, (a, ps) in joined.items()}


def test_greedy_is_the_plain_greedy(spark):
    rng = random.Random(3)
    edges = sorted({(b, rng.randrange(8), rng.randrange(8)) for b in range(6) for _ in range(30)})
    edges = [(*e, rng.choice([0.5, 0.6, 0.7])) for e in edges]
    got = greedy_one_to_one(spark.createDataFrame(edges, "block int, left int, right int, score double")).collect()
    expected, used = set(), set()
    for b, left, right, score in sorted(edges, key=lambda e: (e[0], -e[3], e[1], e[2])):
        if (b, "l", left) not in used and (b, "r", right) not in used:
            used |= {(b, "l", left), (b, "r", right)}
            expected.add((b, left, right, score))
    assert {tuple(r) for r in got} == expected


def test_collections_are_matched_greedily(spark):
    from shelfscope.plans.matching import match_collections_greedy
    from shelfscope.sources.catalog import catalog

    data = "/root/testdata/sf0.001"
    kept = {(r.site, r.category, r.vendor) for r in catalog(spark, data).select("site", "category", "vendor").distinct().collect()}
    number = lambda v: int("".join(c for c in v if c.isdigit()))
    words = lambda c, v: set("".join(x if x.isalnum() else " " for x in f"{c} {v}".lower()).split())
    pairs = [(r.a, r.b) for r in spark.createDataFrame(sorted({(f"{c} {v}".lower(), f"{c} {w}".lower()) for s, c, v in kept if s == 0 for t, d, w in kept if t != 0 and c == d}), "a string, b string").collect()]
    ratio = {(r.a, r.b): r.r for r in spark.createDataFrame(pairs, "a string, b string").withColumn("r", sequence_ratio("a", "b")).collect()}
    expected = set()
    for site in {s for s, _, _ in kept} - {0}:
        scored = []
        for _, c, v in (x for x in kept if x[0] == 0):
            for _, _, w in (x for x in kept if x[0] == site and x[1] == c):
                a, b, r = words(c, v), words(c, w), ratio[f"{c} {v}".lower(), f"{c} {w}".lower()]
                score = 0.6 + min(0.25, 0.9 * len(a & b) / len(a | b)) + (min(0.15, 0.15 * r) if r >= 0.5 else 0)
                scored.append((-int(score * 1000 + 0.5) / 1000, number(v), number(w), c))
        used = set()
        for score, left, right, c in sorted(scored):
            if not used & {("l", c, left), ("r", c, right)}:
                used |= {("l", c, left), ("r", c, right)}
                expected.add((site, c, left, right, -score))
    got = {tuple(r) for r in match_collections_greedy(spark, data).collect()}
    assert got == expected


def test_products_are_matched_greedily_over_all_pairs(spark):
    from shelfscope.plans.matching import _cards, comparable, match_products_greedy

    data = "/root/testdata/sf0.001"
    cards = _cards(spark, data).collect()
    expected = {}
    for a in (x for x in cards if x.site == 0):
        for b in (x for x in cards if x.site != 0 and x.category == a.category):
            names = min(0.3, 0.75 * (len(set(a.ws) & set(b.ws)) / len(set(a.ws) | set(b.ws))))
            closeness = max(0.0, 1.0 - abs(math.log(a.price / b.price)) / math.log(3.0)) if a.price > 0 and b.price > 0 else 0.0
            score = math.floor((0.35 + names + 0.1 * closeness + (0.2 if a.vendor == b.vendor else 0.0)) * 10000 + 0.5) / 10000
            if score >= 0.45:
                expected[b.site, a.product, b.product] = score
    found = comparable(_cards(spark, data)).collect()
    assert len(found) == len(expected)
    assert {(r.site, r.left_product, r.right_product): r.score for r in found} == expected
    assert any(score == 0.45 for score in expected.values())  # by category and price alone
    matched, used = set(), set()
    for (site, left, right), score in sorted(expected.items(), key=lambda e: (e[0][0], -e[1], e[0][1], e[0][2])):
        if not used & {(site, "l", left), (site, "r", right)}:
            used |= {(site, "l", left), (site, "r", right)}
            matched.add((site, left, right, score))
    assert {tuple(r) for r in match_products_greedy(spark, data).collect()} == matched


def test_greedy_in_order_is_the_greedy_by_rounds(spark):
    rng = random.Random(4)
    edges = [(*e, rng.choice([0.5, 0.6, 0.7])) for e in sorted({(b, rng.randrange(8), rng.randrange(8)) for b in range(6) for _ in range(30)})]
    df = spark.createDataFrame(edges, "block int, left int, right int, score double")
    assert {tuple(r) for r in greedy_in_order(df).collect()} == {tuple(r) for r in greedy_one_to_one(df).collect()}


def test_words_are_lowered_once_a_document(spark):
    from shelfscope import registry

    plan = registry.queries()["merge_unique_strings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and plan.count("split(") == 1
