"""Vectors as Spark rows: which ones take part, and how tasks read them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, not all zero, and every component finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def vector_hashes(vector: Column) -> tuple[Column, Column]:
    """h1 and h2; the salt stands first, as it is the seed with which the vector is then hashed."""
    return F.xxhash64(vector).alias("h1"), F.xxhash64(F.lit(7), vector).alias("h2")


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; each is first divided by its largest component, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_vectors(vectors: DataFrame, id_col: str, vec_col: str, keep_ids: int) -> DataFrame:
    """One row per distinct usable vector: id (its smallest), ids (its ``keep_ids`` smallest), copies, vector.

    Copies are counted and their ids ranked by a hash of the vector, with limits applied before
    the shuffle, so any number of copies costs each task a few rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vector")).where(usable(F.col("vector")) & F.col("id").isNotNull())
    rows = rows.distinct().withColumns(dict(zip(("h1", "h2"), vector_hashes(F.col("vector")), strict=True)))
    counts = rows.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min_by("vector", "id").alias("vector"))
    ranked = rows.select("h1", "h2", "id").withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("n") <= keep_ids)
    ids = ranked.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return counts.join(ids, ["h1", "h2"]).select(F.col("ids")[0].alias("id"), "ids", "copies", "vector")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long arrays as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    return np.asarray(column.flatten()).astype(float).reshape(len(column), -1)
