import numpy as np
import pytest

from shelfscope.llm.minhash import drop_near_duplicates, icws, near_duplicates
from shelfscope.llm.textops import shingle_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def classes(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    return {r["doc_id"]: (r["class_id"], r["kept"]) for r in near_duplicates(df, **options).collect()}


def words(seed, n):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**9, n)]


def test_classes_match_brute_force(spark):
    rows = []
    for k in range(12):
        base = words(k, 120)
        for c in range(4):
            w = list(base)
            for p in np.random.default_rng([k, c]).integers(0, 120, c):
                w[p] = f"x{k}-{c}-{p}"
            rows.append((k * 10 + c, " ".join(w)))
    got = classes(spark, rows)
    sets = {i: {" ".join(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    for a in sets:
        for b in sets:
            similarity = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if similarity >= 0.85:
                assert got[a][0] == got[b][0]
            if a // 10 != b // 10:
                assert got[a][0] != got[b][0]


def test_edges(spark):
    long = " ".join(words(1, 3000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b"), (5, "a b"), (6, "a b"), (7, long), (8, long), (9, long + " tail"), (None, long), (10, "x" * 100_000)]
    got = classes(spark, rows)
    assert [got[i] for i in (1, 2, 3)] == [(1, True), (2, True), (3, True)]
    assert [got[i] for i in (4, 5, 6)] == [(4, True), (4, False), (4, False)]
    assert {got[i][0] for i in (7, 8, 9)} == {7}
    assert got[None] == (None, True)
    assert got[10] == (10, True)


def test_empty_table_and_clashing_columns(spark):
    assert classes(spark, []) == {}
    df = spark.createDataFrame([(1, "a b c d e f", 9, "k"), (2, "a b c d e f", 9, "k")], "doc_id long, text string, component long, key string")
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert [r["doc_id"] for r in kept.collect()] == [1]


def test_hot_group_in_blocks(spark):
    base = words(5, 60)
    rows = [(i, " ".join([*base[: i % 3], *base[i % 3 :], f"e{i}"])) for i in range(60)]
    got = classes(spark, rows, block=8)
    assert {c for c, _ in got.values()} == {0}


def test_icws_collides_as_often_as_weighted_jaccard():
    import pyarrow as pa

    row, h, _ = shingle_counts(pa.array([" ".join(words(1, 200)), " ".join(words(1, 200)[:150] + words(2, 50))]))
    _, samples = icws(row, h, np.ones(len(h), np.float32), 600)
    a, b = set(h[row == 0].tolist()), set(h[row == 1].tolist())
    assert (samples[0] == samples[1]).mean() == pytest.approx(len(a & b) / len(a | b), abs=0.07)


def test_classes_at_the_threshold_by_brute_force(spark):
    """Every pair of weighted or plain similarity 0.8 shares a class, and each class hangs together by such pairs."""
    import pyarrow as pa

    from shelfscope.llm.minhash import document_frequencies, idf_table, similarities

    rng, rows = np.random.default_rng(8), []
    for k in range(40):
        base = words(100 + k, 90)
        for c in range(5):
            w = list(base)
            for p in rng.integers(0, 90, int(rng.integers(0, 5))):
                w[p] = f"y{k}-{c}-{p}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, rows[0][1] + " tail" * k) for k in range(30)]  # a passage that many share
    got = classes(spark, rows)
    idf = idf_table(*document_frequencies(spark.createDataFrame(rows, "doc_id long, text string")))
    a, b = np.triu_indices(len(rows), 1)
    texts = pa.array([t for _, t in rows])
    near = similarities(texts.take(pa.array(a)), texts.take(pa.array(b)), idf, 5) >= 0.8
    caught = [got[int(i)][0] == got[int(j)][0] for i, j in zip(a[near], b[near], strict=True)]
    assert len(caught) > 200
    assert np.mean(caught) >= 0.99
    label = list(range(len(rows)))
    for i, j in sorted(zip(a[near].tolist(), b[near].tolist(), strict=True)):
        low = min(label[i], label[j])
        label = [low if x in (label[i], label[j]) else x for x in label]
    assert all(label[i] == label[got[i][0]] for i in range(len(rows)))


def test_one_id_with_two_texts_and_clashing_names(spark):
    a, b = " ".join(words(1, 50)), " ".join(words(2, 50))
    rows = [(1, a, 5), (2, b, 6), (3, b, 7), (3, a, 8), (None, a, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone long").repartition(3)
    assert sorted(map(str, ((r["doc_id"], r["_gone"]) for r in drop_near_duplicates(df).collect()))) == sorted(map(str, [(1, 5), (2, 6), (None, 9)]))
    assert drop_near_duplicates(df.withColumnsRenamed({"_gone": "h1"})).columns == ["doc_id", "text", "h1"]
