"""Products matched where a rival's products lie, against plain loops."""

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfscope.functions import price_closeness
from shelfscope.operators import site_pairs as S

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("most, piece", [(1 << 20, 1 << 20), (7, 11), (1, 1), (40, 1000)])
def test_greedy_in_little_room_is_the_greedy(most, piece):
    rnd = random.Random(5)
    scores = np.array([[rnd.choice([0.5, 0.5, 0.7, rnd.random() * 1e-3 + 0.6, 0.0]) for _ in range(30)] for _ in range(25)])
    left, right = np.array([k - (k % 10 == 9) for k in range(25)]), np.arange(30)  # some places are of one end

    def edges(xs, ys):
        assert len(xs) * len(ys) <= max(piece, len(ys))
        part = scores[np.ix_(xs, ys)]
        i, j = np.nonzero(part > 0)
        return i, j, part[i, j]

    want, used = [], set()
    for s, x, y in sorted(((scores[x, y], x, y) for x in range(25) for y in range(30) if scores[x, y] > 0), key=lambda e: (-e[0], e[1], e[2])):
        if ("l", left[x]) not in used and ("r", y) not in used:
            used |= {("l", left[x]), ("r", y)}
            want.append((x, y, s))
    assert sorted(zip(*S.greedy(edges, left, right, most, piece), strict=True)) == sorted(want)
    assert not len(S.greedy(lambda xs, ys: (xs[:0], ys[:0], np.zeros(0)), left, right)[0])


def test_closeness_is_the_jvms_to_the_last_bit(spark):
    r = np.random.default_rng(2)
    a = np.round(np.exp(r.uniform(-3, 12, 20000)), 2)
    b = np.where(r.random(20000) < 0.5, a * r.choice([1, 3, 1 / 3, 0.5, 1.00001], 20000), np.round(np.exp(r.uniform(-3, 12, 20000)), 2))
    rows = spark.createDataFrame(pd.DataFrame({"a": a, "b": b})).select("a", "b", price_closeness(F.col("a"), F.col("b")).alias("c")).toPandas()
    assert (S.closeness(rows.a.to_numpy(), rows.b.to_numpy()) == rows.c.to_numpy()).all()
    assert S.closeness(np.array([0.0, np.nan, -1.0]), np.array([1.0, 1.0, -1.0])).tolist() == [0, 0, 0]


def test_shared_words_are_counted():
    rows, codes, _, _ = S.flat(pa.array([["a", "b", "a"], None, []]), pa.array([["b", "c"], ["a", "b"]]))
    lists = S.Lists(rows, codes, 5)
    assert lists.shares(np.array([0, 1, 2]), np.array([4, 3])).tolist() == [[1.0, 1 / 3], [0, 0], [0, 0]]
    assert lists.both(np.array([4]), np.array([0, 3, 1])).tolist() == [[2.0, 1.0, 0.0]]


def test_no_pair_of_products_is_shuffled(spark):
    from shelfscope.plans.matching import match_products_greedy

    plan = match_products_greedy(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    # Line items by product, products by site; no join by category or word, and no edges by site.
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Join") == 1 and "hashpartitioning(category" not in plan


def made(tmp_path, spark, lines, parts):
    """A folder of tables: lines (site, product, price) and parts (product, name, vendor, category)."""
    spark.createDataFrame([(s, p, k, 1, float(price) if price is not None else None, 1.0, 0.0, "N", "O", "1995-01-01") for k, (s, p, price) in enumerate(lines)], "l_suppkey long, l_partkey long, l_orderkey long, l_linenumber int, l_extendedprice double, l_quantity double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate string").withColumn("l_shipdate", F.to_timestamp("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(*p, 10, 1.0) for p in parts], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(s, s % 25) for s in sorted({x[0] for x in lines})], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


def shop(tmp_path, spark, sites=4, products=90):
    """Odd products: without name, vendor, category or price, at equal prices, and a part that stands there twice, of two categories."""
    rnd = random.Random(7)
    parts = [(p, rnd.choice([None, "", "red rod", "blue rod", "red gear mk", "one two three four five six seven eight nine " + rnd.choice(["ten", "x"])]), rnd.choice([None, "A", "B"]), rnd.choice([None, "x", "y", "x"])) for p in range(products)]
    parts += [(3, "red rod", "A", "x"), (3, "red rod", "A", "y")]
    lines = [(s, p, rnd.choice([None, 0.0, 10.0, 10.0, 10.01, 29.99, 30.0, 50000.0, 50000.01, 50000.02])) for s in range(sites) for p in range(products) if rnd.random() < 0.8]
    return made(tmp_path, spark, lines, parts)


def test_odd_products_are_matched_as_the_edges_say(spark, tmp_path):
    from shelfscope.plans.matching import _cards, comparable, match_products_greedy

    data = shop(tmp_path, spark)
    edges = {tuple(r) for r in comparable(_cards(spark, data)).collect()}
    want, used = set(), set()
    for site, left, right, score in sorted(edges, key=lambda e: (e[0], -e[3], e[1], e[2])):
        if not used & {(site, "l", left), (site, "r", right)}:
            used |= {(site, "l", left), (site, "r", right)}
            want.add((site, left, right, score))
    assert len(want) > 50 and {tuple(r) for r in match_products_greedy(spark, data).collect()} == want
    assert match_products_greedy(spark, data).where("site = 99").count() == 0 and math.isclose(max(e[3] for e in edges), 0.95)


def test_odd_products_are_suggested_as_the_sql_says(spark, tmp_path):
    import duckdb

    from shelfscope import registry
    from shelfscope.plans.matching import suggest_matches

    data, con = shop(tmp_path, spark), duckdb.connect()
    for t in ("lineitem", "part", "supplier"):
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet/*.parquet')")
    want = con.sql(registry.oracle_sql()["suggest_matches"]).fetchall()
    assert len(want) > 10 and sorted(tuple(r) for r in suggest_matches(spark, data).collect()) == sorted(want)
    plan = suggest_matches(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Window" not in plan


def test_suggestions_in_little_room_are_the_same():
    from shelfscope.plans.matching import _suggested

    rnd = random.Random(9)
    table = lambda lo: pa.table({"site": [1] * 50, "product": [lo + k for k in range(50)], "name": [rnd.choice(["a b", "b c", "a c d"]) for _ in range(50)], "price": [rnd.choice([1.0, 2.0, 2.5, None]) for _ in range(50)]})
    own, rows = table(0), table(100)
    once, pieces = _suggested(own, rows), _suggested(own, rows, piece=60)
    assert all((once[c] == pieces[c]).all() for c in once) and len(once["score"]) > 2
