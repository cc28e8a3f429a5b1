"""Each stage of the pipeline against what its operator says on its own input."""

import re
from collections import Counter

import corpus_pipeline
import pytest

from shelfscope.llm.minhash import near_duplicates
from shelfscope.llm.mixing import water_fill
from shelfscope.llm.pii_crf import pattern_spans
from shelfscope.llm.quality_cnn import score_quality, train_quality
from shelfscope.llm.scratch import materialise

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], DATA), name))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[1:5])


def test_quality_stage(spark, stages):
    model = train_quality(stages[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    good = {r["doc_id"] for r in score_quality(stages[0], model).where("score >= 0.3").collect()}
    assert {r["doc_id"] for r in stages[1].collect()} == good


def test_near_duplicate_stage(stages):
    kept = {r["doc_id"] for r in near_duplicates(stages[1]).where("kept").collect()}
    assert {r["doc_id"] for r in stages[2].collect()} == kept
    texts = Counter(r["text"] for r in stages[2].collect())
    assert max(texts.values()) == 1


def test_personal_data_stage(stages):
    before, after = ({r["doc_id"]: r["text"] for r in s.collect()} for s in stages[2:4])
    assert before.keys() == after.keys()
    assert not any(pattern_spans(t) for t in after.values())
    assert all(before[i] == t for i, t in after.items() if "[" not in t)


def test_mixing_stage(stages):
    def words(rows):
        n = Counter()
        for r in rows:
            n[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        return n

    before, after = words(stages[3].collect()), words(stages[4].collect())
    for source, target in water_fill(dict(before)).items():
        assert abs(after[source] - target) <= 0.04 * target + 3


def test_packing_stage_and_run(spark, stages):
    pieces = stages[5].collect()
    assert sum(r["length"] for r in pieces) >= stages[4].count()
    assert sorted(map(tuple, pieces)) == sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect()))


ODD = [
    (1, None, "en", "s", 0, "a", 1), (2, "", None, None, None, "b", 2), (3, " \n\t", "en", "s", 3, None, None), (None, "no id here but some words " * 9, "en", "s", 0, "c", 3), (None, "no id here but some words " * 9, "en", "s", 0, "c", 3),
    (5, "same words in the same order as ever " * 12, "de", "t", 0, "d", 4), (5, "same words in the same order as ever " * 12, "de", "t", 0, "d", 4), (6, "same words in the same order as ever " * 12, "de", "t", 0, "d", 4), (7, "mail a.b@c.example or +49 30 1234567 " * 6, "fr", "u", 0, "e", 5),
    (2**63 - 1, "end of the range " * 10, "en", "u", 0, "f", 6), (-(2**63), "word " * 60_000, "en", "t", 0, "g", 7), (8, "x" * 200_000, "en", "t", 0, "h", 8),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys string, score long"


def test_stages_take_odd_rows_and_other_columns(spark):
    docs = spark.createDataFrame(ODD, ODD_SCHEMA).repartition(3)
    out = {name: stage(spark, docs, DATA).collect() for name, stage in corpus_pipeline.STAGES}
    plain = lambda rows: Counter(map(tuple, rows))
    assert not plain(out["quality"]) - plain(docs.collect())
    kept = plain(out["near_duplicates"])
    assert kept == plain(r for r in docs.collect() if r["doc_id"] != 6)  # its text is that of 5
    data = {r["doc_id"]: r for r in out["personal_data"]}
    assert len(out["personal_data"]) == len(ODD) and data[1]["text"] is None and data[2]["text"] == "" and "a.b@c.example" not in data[7]["text"] and (data[7]["keys"], data[7]["score"]) == ("e", 5)
    taken = {r["doc_id"] for r in out["mixing"]}
    assert taken <= {r[0] for r in ODD} - {1, 2, 3} and out["mixing"][0].asDict().keys() == docs.first().asDict().keys()
    tokens = Counter()
    for r in out["packing"]:
        tokens[r["doc_id"]] += r["length"]
    assert tokens.keys() == {r[0] for r in ODD} and tokens[1] == tokens[2] == 1 and tokens[8] > 2048


def test_stages_of_nothing(spark):
    docs = spark.createDataFrame([], ODD_SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0
