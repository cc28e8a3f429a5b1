"""Merkle manifest, filter audit and toxicity against plain Python, with edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfscope.llm.audit import FILTERS, copies, interactions, route
from shelfscope.llm.merkle import digest, manifest
from shelfscope.llm.toxicity import CLASSES, LEET, REPEAT, SWAP, Lattices, Reader, chains, classes, features, fit, language_model, restore_texts, score_toxicity, smoothed, train_toxicity, trigram_codes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """doc_id -> sorted (leaf, subroot, root, proof_sha256, folded_root, verified)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h(*map(field, (r[0], r[3], r[2], r[4], text)))
    low = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        out = []
        for nodes in levels[:-1]:
            run = i - i % 16
            out.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 16])))
            i //= 16
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = climb([leaf(r, r[1]) for r in groups[s]])
    top = climb([trees[s][-1][0] for s in order])
    found = []
    for at, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            own, steps = leaf(r, r[1]), path(trees[s], i) + path(top, at)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf(r, low(r[1])) if hit else own
            for a, b in steps:
                node = h(a, node, b)
            found.append((r[0], own, trees[s][-1][0], top[-1][0], h(*(a + b for a, b in steps)), node, node == top[-1][0]))
    return sorted(found, key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17, None: 3}, {"hot": 700, "é": 1, "": 2, "z": 257}, {f"s{i}": 1 for i in range(40)}])
def test_manifest_by_plain_trees(spark, sizes):
    rows = [(100 * k + i * 3 - 50, [f"Text {i}", "", None, "low"][i % 4], "en" if i % 3 else None, s, i) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [rows[0], (None, "No id", None, rows[0][3], None), (2**63 - 1, "X" * 300_000, "en", rows[0][3], 1), (-(2**63), "é", "en", rows[0][3], 1)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, DOCS).repartition(5).withColumn("node", F.lit("clash")).withColumn("grp", F.lit(1)).withColumn("path", F.lit(2))
    got = digest(manifest(df)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_manifest(rows)


def test_manifest_of_nothing(spark):
    assert digest(manifest(spark.createDataFrame([], DOCS))).collect() == []


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    fails = {}
    for i, text, _, source, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text)) + "E" * (i is not None and i > least[text])
        fails.setdefault(source or "", []).append((i, bad))
    out = {}
    for part, docs in fails.items():
        for order in map("".join, itertools.permutations(FILTERS)):
            left = docs
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                out[part, order, step] = [len(left), len(removed), sum(f in d[1] for d in docs) - len(removed), sum(d[1] == f for d in docs), sum(d[0] in good for d in removed), sum(d[0] in toxic for d in removed)]
    return out


AUDIT = [(i, t, "en", s, 1) for i, (t, s) in enumerate([("a b c", "x"), ("a b c", "y"), (None, "x"), ("", None), ("", ""), ("w " * 400, "x"), (" ".join(f"w{k}" for k in range(300)), "x"), (" ".join(f"w{k}" for k in range(300)), "y"), ("A$ " * 250, "y"), ("É É\x0bx", "x"), ("big " + "z" * 500_000, "x")])]
AUDIT += [(None, "a b c", "en", "x", 1), (None, "fresh", "en", None, 1), (-5, "a b c", "en", "x", 1), (-5, "a b c", "en", "x", 1), (-5, "a b c", "en", "y", 1), (7, "w " * 400, "en", "x", 1)]
AUDIT += [(1000 + k, "hot text " * 30, "en", "hot", 1) for k in range(300)]
LABELS = [(0, 1, 0), (1, 1, 1), (5, 0, 1), (5, 1, 0), (6, None, 1), (999, 1, 1), (None, 1, 1), (1005, 1, None)]


@pytest.mark.parametrize("options", [{}, {"fingerprint": 7}, {"partition_bytes": 500}])
def test_audit_by_loops(spark, options):
    docs = spark.createDataFrame(AUDIT, DOCS).repartition(4).withColumn("mask", F.lit(1)).withColumn("part", F.lit("clash"))
    if "fingerprint" in options:  # all texts collide
        options = {"fingerprint": F.lit(options["fingerprint"])}
    got = interactions(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"), **options).collect()
    want = plain_audit(AUDIT, LABELS)
    assert {(r["part"], r["filter_order"], r["step"]): [r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"]] for r in got} == want
    assert len(got) == len(want)
    for part in {p for p, _, _ in want}:
        for k, f in enumerate(FILTERS):
            total = {r["shapley"] for r in got if r["part"] == part and r["filter_order"][r["step"] - 1] == f}
            assert total == {sum(v[1] for (p, o, s), v in want.items() if p == part and o[s - 1] == FILTERS[k])}


def test_copies(spark):
    docs = spark.createDataFrame(AUDIT, DOCS).repartition(6)
    got = {r["doc_id"] for r in copies(docs).collect()}
    assert got == {0, 1, 3, 4, 7} | set(range(1001, 1300))
    assert sum(r[3] for r in route(docs).collect()) == len(AUDIT)
    empty = spark.createDataFrame([], DOCS)
    assert interactions(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


WORDS = "idiot stupid clown pathetic scum worthless trash moron disgusting loser".split()
PLAIN = "the cat sat on a mat and then it ran after the other animals in this old town near water".split()


def corpus(n=600, seed=3):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(PLAIN) for _ in range(40)]
        bad = i % 4 == 0
        for _ in range(3 * bad):
            words.insert(rnd.randrange(len(words)), rnd.choice(WORDS))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    return train_toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def best_by_trying(lattices, piece):
    """All readings of a piece without gaps, by plain recursion."""
    language = lattices.model.reshape(CLASSES, CLASSES, CLASSES)
    runs = [(c, len(list(g))) for c, g in itertools.groupby(piece)]
    found = []

    def walk(k, symbols, value):
        if k == len(runs):
            s = [0, 0, *symbols, 0]
            found.append((value + sum(language[s[i], s[i + 1], s[i + 2]] for i in range(len(s) - 2)), symbols))
            return
        c, n = runs[k]
        if c in LEET:
            letters = [ord(x) - 96 for x in LEET[c]]
            walk(k + 1, [*symbols, *([27] * min(n, 2) if c.isdigit() else [28])], value)
            for x in letters:
                walk(k + 1, [*symbols, x], value + SWAP + (REPEAT if n > 1 else 0))
                for y in letters if n > 1 else []:
                    walk(k + 1, [*symbols, x, y], value + 2 * SWAP)
        else:
            x = ord(c) - 96
            walk(k + 1, [*symbols, x], value + (REPEAT if n > 1 else 0))
            if n > 1:
                walk(k + 1, [*symbols, x, x], value)

    walk(0, [], 0.0)
    return max(found)[1]


def test_viterbi_by_trying_all_paths(model):
    lattices = Lattices(model.language)
    rnd = random.Random(5)
    pieces = ["".join(rnd.choice("iidotsp10$@") * rnd.choice([1, 1, 2, 3]) for _ in range(rnd.randint(1, 6))) for _ in range(150)]
    for piece, got in zip(pieces, lattices.restore(pieces), strict=True):
        assert got == "".join(chr(96 + s) if 1 <= s <= 26 else " " for s in best_by_trying(lattices, piece)).strip(), piece


def test_restoring(model):
    disguised = {"1d10t": "idiot", "i d i o t": "idiot", "s.t.u.p.i.d": "stupid", "s tupid": "stupid", "stuuupiddd": "stupid", "$TUP1D": "stupid", "c1own": "clown", "w-0-r-t-h-l-3-s-s": "worthless", "tr@5h": "trash", "Móròn": "moron", "d!$gu$t!ng": "disgusting", "": ""}
    got = Lattices(model.language).restore(list(disguised))
    assert [re.sub(r"(.)\1+", r"\1", g).strip() for g in got] == [re.sub(r"(.)\1+", r"\1", w) for w in disguised.values()]
    assert list(chains("the s t u pid of so a b".split())) == [(0, 5), (6, 9)]
    assert list(chains("| a | of | b".split())) == [(0, 3), (4, 6)]
    reader = Reader(model.language)
    long = "x" * 1000 + "1d10t" + "y" * 3
    assert reader.read([None, "", "clean words", "A 1d10t here", " ".join("stupid") + " end", long])[:3] == [set(), set(), {"clean", "words"}]
    assert "idiot" in reader.read(["A 1d10t here"])[0] and "stupid" in reader.read([" ".join("stupid") + " end"])[0]


def test_reader_reads_alike_however_texts_are_dealt(model):
    rows, _ = corpus(40, 9)
    texts = [t for _, t, *_ in rows] + ["s t u p i d a b", None, "w" * 500]
    alone = [Reader(model.language).read([t])[0] for t in texts]
    assert Reader(model.language).read(texts) == alone
    few = Reader(model.language, keep=30)
    assert [few.read([t])[0] for t in texts] == alone
    wanted = Reader(model.language, only=model.weights)
    for t, keys in zip(texts, alone, strict=True):
        assert features(wanted.read([t])[0]) & model.weights.keys() == features(keys) & model.weights.keys()


def test_toxicity_on_held_out_rows(spark, model):
    rows, labels = corpus(400, 11)
    rnd = random.Random(2)
    leet = {"i": "1", "o": "0", "e": "3", "a": "@", "s": "$"}
    ways = [lambda w: w, lambda w: " ".join(w), lambda w: "".join(leet.get(c, c) for c in w), lambda w: w[:2] + w[1] * 3 + w[2:], str.upper]
    hidden = [(i, re.sub(r"\b(" + "|".join(WORDS) + r")\b", lambda m: rnd.choice(ways)(m.group()), t), *r) for i, t, *r in rows]
    got = {r["doc_id"]: r["score"] for r in score_toxicity(spark.createDataFrame(hidden, DOCS).repartition(3), model).collect()}
    caught = [got[i] >= 0.5 for i, _, t in labels if t]
    clean = [got[i] < 0.5 for i, _, t in labels if not t]
    assert sum(caught) / len(caught) >= 0.95 and sum(clean) / len(clean) >= 0.98


def test_toxicity_edges(spark, model):
    rows = [(1, None, "en", "s", 1), (1, "", None, None, None), (None, "you idiot moron", "xx", "s", 1), (None, "you idiot moron", "xx", "s", 1), (2**63 - 1, "idiot moron " + "a " * 200_000, "en", "s", 1), (3, "\x00퟿\U0001f600 1 \n\n|", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).withColumn("keys", F.lit(1)).repartition(2)
    got = sorted(((r["doc_id"], r["score"]) for r in score_toxicity(df, model).collect()), key=str)
    by = {}
    for i, s in got:
        by.setdefault(i, []).append(s)
    assert len(by[1]) == 2 and by[1][0] == by[1][1] and len(by[None]) == 2 and min(by[None]) > 0.5 and by[2**63 - 1][0] > 0.5 and len(by[3]) == 1
    empty = spark.createDataFrame([], DOCS)
    assert score_toxicity(empty, model).collect() == []
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert train_toxicity(df, none) is None
    one = spark.createDataFrame([(1, 1, 1), (1, 1, None), (None, 0, 0), (77, 0, 0)], "doc_id long, quality int, toxic int")
    assert train_toxicity(df, one) is None
    assert [r["score"] for r in score_toxicity(df, None).collect()] == [0.0] * len(rows)
    restored = {r["doc_id"]: r["restored"] for r in restore_texts(spark.createDataFrame([(1, "an 1d10t s t u p i d."), (2, None), (3, "")], "doc_id long, text string"), model.language).collect()}
    assert restored[2] is None and restored[3] == "" and "idiot" in restored[1] and "stupid" in restored[1]


def test_language_model_counts_all_documents(spark):
    texts = ["ab a", None, "", "É b!!", "ab"]
    want = np.zeros(CLASSES**3)
    want += np.bincount(trigram_codes(" ".join(t for t in texts if t)), minlength=len(want))
    got = language_model(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1))
    assert np.allclose(got, smoothed(want))
    assert classes("aÉ 7!ßж").tolist() == [1, 5, 0, 27, 28, 29, 29]
    assert fit(np.array([[1], [1], [0], [0]]), np.array([1, 1, 0, 0]))[0] > 1
