"""Connected components over an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialise


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger end u to its smaller end v."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Returns (id, component) for every id on an edge; component is its smallest reachable id.

    Large-star hangs each larger neighbour of a node on the smallest one, small-star each smaller
    neighbour; the two alternate until the edges are stars, which takes a logarithmic number of rounds.  Minima are aggregated before the
    shuffle, and the joins back are plain equi-joins whose hot keys adaptive execution splits, so
    a node with a third of all edges is no single task.  Edges whose ends are null or equal count
    for nothing.  Each round is a table in the shared folder; none is collected.
    """
    edges = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    current = materialise(_down(edges), "edges")
    size = (0, None)
    while True:
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _down(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # Every u keeps its link to m by the row whose v is m itself.
        after = materialise(_down(small), "edges")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(current)
        current = after
        if tuple(now) == size:
            break
        size = tuple(now)
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
