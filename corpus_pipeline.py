"""A corpus from raw documents: quality, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns
as Parquet to the shared scratch folder and rereads it as the next stage's documents.  All stages
but the last return the columns of their input, whatever other columns it has and whatever they are
called; of an empty table each makes an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfscope.llm.minhash import drop_near_duplicates
from shelfscope.llm.mixing import mix_documents
from shelfscope.llm.packing import pack_documents
from shelfscope.llm.pii_crf import redact
from shelfscope.llm.quality_cnn import keep_good, train_quality
from shelfscope.llm.scratch import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network scores below 0.3 go; it learns from the labels of those at hand.

    A null or empty text has the score of no text; rows that repeat an id are judged each; a null
    id is judged like any other; without labels of both kinds all stay; very long texts count whole.
    """
    return keep_good(docs, train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the smallest doc_id stays.

    Null, empty and blank texts are classes of their own and stay, as do rows without id; rows that
    repeat both id and text stay or go together; on a tie of similarity at the bar texts are linked.
    """
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind in brackets; no document goes.

    Null texts stay null; n_chars is that of the text after; rows that repeat an id are read each.
    """
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and in such parts, as the mix takes their words.

    Null, empty and blank texts have no words and are not taken; a null source is the last source;
    rows that repeat an id are documents of their own; null ids stay null.
    """
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens.

    A null text is an empty one, of one token; very long texts are cut; rows that repeat an id, and
    those without one, are documents of their own.
    """
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]

#: No stage but the last but one is SQL; tests/llm/test_pipeline.py checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage makes of the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
