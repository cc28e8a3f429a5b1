import numpy as np
from pyspark.sql import functions as F

from shelfscope.llm.collisions import calibrated_count, collision_probability, count_collisions, linked_vectors
from shelfscope.llm.ivfpq import nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)


def clustered(n, d=32, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    for k in range(0, n - 5, 7):
        x[k + 1 : k + 4] = x[k] + rng.standard_normal((3, d)) * rng.choice([0.1, 0.25, 0.35])
    x[-2] = x[0]
    x[-1] = x[0] * 2
    return [(int(i), [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]


def test_links_match_brute_force(spark):
    rows = clustered(800)
    got = {r["vec_id"]: r for r in linked_vectors(frame(spark, rows), cell=64, block=40).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    found = sum(got[i]["n_links"] for i in got)
    assert 0.99 * near.sum() <= found <= near.sum()
    assert all(got[i]["n_links"] <= near[i].sum() for i in got)
    assert got[798]["component_id"] == 0
    assert got[0]["kept"]


def test_odd_vectors(spark):
    bad = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [])]
    good = [(7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [2.0, 0.0]), (10, [0.0, 1.0]), (11, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0])]
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in linked_vectors(frame(spark, bad + good)).collect()]
    assert all((i, 0, i) in got for i in range(1, 7))
    assert {g for g in got if g[0] in (7, 8, 9)} == {(7, 2, 7), (8, 2, 7), (9, 2, 7)}
    assert (10, 0, 10) in got
    assert (11, 0, 11) in got
    assert len(got) == 13
    assert linked_vectors(frame(spark, [])).count() == 0


def test_collision_counts():
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((20, 9)), rng.standard_normal((30, 9))
    assert (count_collisions(a, b, 0.5) == (np.abs(a[:, None] - b[None]) <= 0.5).sum(axis=2)).all()
    assert 0 < calibrated_count(0.9, 0.6, 32, 0.997) < 32 * collision_probability(0.9, 0.6)


def test_search_recall_and_exact_scores(spark):
    rows = clustered(1500)
    got = nearest_neighbours(frame(spark, rows), F.col("vec_id") % 100 == 0, k=10).collect()
    x = np.array([v for _, v in rows])
    hit = 0
    for q in range(0, 1500, 100):
        exact = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(1500), exact)) if i != q][:10]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert all(abs(r["score"] - exact[r["vec_id"]]) < 1e-12 for r in own)
        assert [(r["score"], r["vec_id"]) for r in own] == sorted((r["score"], r["vec_id"]) for r in own)
        hit += len({r["vec_id"] for r in own} & set(best))
    assert hit / 150 >= 0.9


def test_search_copies_and_few_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(0, 30)] + [(100, [5.0, 5.0]), (200, None), (300, [0.0, 0.0])]
    got = nearest_neighbours(frame(spark, rows), F.col("vec_id") % 100 == 0).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == 0), key=lambda r: r["rank"])] == [(i, 0.0) for i in range(1, 11)]
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 100), key=lambda r: r["rank"])] == list(range(10))
    assert {r["query_id"] for r in got} == {0, 100}
    few = nearest_neighbours(frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])]), F.col("vec_id") % 100 == 0).collect()
    assert [tuple(r) for r in few] == [(0, 1, 1, 2**0.5)]
    assert nearest_neighbours(frame(spark, []), F.lit(True)).count() == 0


def test_vectors_of_extreme_size(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.01e200]), (3, [1e-200, 3e-200]), (4, [3e-200, 1e-200]), (5, [-1.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5)}


def test_neighbours_of_rarer_lengths_are_exact(spark):
    from shelfscope.llm.ivfpq import nearest_neighbours

    rng = np.random.default_rng(12)
    rows = [(i, rng.standard_normal(8).round(3).tolist()) for i in range(300)]
    rows += [(1000 + i, rng.standard_normal(3).round(1).tolist()) for i in range(120)] + [(2000, [1.0, 2.0]), (2100, [1.0, 2.5]), (2200, [4.0] * 5), (1000, rows[0][1])]
    rows += [(3000 + i, rows[305][1]) for i in range(15)]  # copies of a rare one
    df = spark.createDataFrame([(i, [float(x) for x in v], "clash") for i, v in rows], "vec_id long, embedding array<float>, vector string").repartition(4)
    df = df.unionByName(spark.createDataFrame([(4000, None, ""), (4100, [float("nan")] * 3, ""), (None, [1.0] * 3, "")], df.schema))
    from pyspark.sql import functions as F

    got = {}
    for r in nearest_neighbours(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    as_float = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    for id_, q in as_float:
        if id_ % 100 == 0 and len(q) != 8 and id_ != 1000:
            want = sorted((float(np.sqrt(((v - q) ** 2).sum())), i) for i, v in as_float if len(v) == len(q) and i != id_)[:10]
            assert got.get(id_, []) == [(i, round(d, 9)) for d, i in want], id_
    assert 4000 not in got and 4100 not in got and len(got[100]) == 10


def test_search_of_extreme_magnitudes(spark):
    from shelfscope.llm.ivfpq import distances

    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 16))
    mixed = x.copy()
    mixed[100:200:2] *= 1e-200
    mixed[201:300:2] *= 1e200
    for rows, scale in ((x * 1e160, 1e160), (x * 1e-170, 1e-170), (x * 1e25, 1e25), (mixed, 1.0)):
        got = nearest_neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
        hit = 0
        for q in range(0, 900, 100):
            exact = distances(rows, rows[q])
            if scale != 1:
                assert np.allclose(exact / scale, np.sqrt(((x - x[q]) ** 2).sum(axis=1)), rtol=1e-12, atol=0)
            best = [int(i) for i in np.argsort(exact, kind="stable") if i != q][:10]
            own = {r["vec_id"]: r["score"] for r in got if r["query_id"] == q}
            assert len(own) == 10 and all(s == exact[i] for i, s in own.items())
            hit += len(set(own) & set(best))
        assert hit / 90 >= 0.9
