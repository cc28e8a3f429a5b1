"""One-to-one assignment by score."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import shared_folder


def greedy_one_to_one(edges: DataFrame, block: str = "block", left: str = "left", right: str = "right", score: str = "score") -> DataFrame:
    """The matching that takes edges by (score desc, left, right) where both ends are still free.

    With that strict order the greedy matching is the locally dominant one: again and again take
    every edge that is the best of both its ends and drop the ends' other edges.  A round is two
    grouped maxima and two joins over all blocks at once; few rounds are needed.  Each round is
    checkpointed, so the plan does not grow and lost executors cost one round.
    """
    spark = edges.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "assignment"))
    rest = edges.select(F.col(block).alias("b"), F.col(left).alias("l"), F.col(right).alias("r"), F.col(score).alias("s")).checkpoint()
    taken = None
    while True:
        rank = F.struct(F.col("s"), (-F.col("l")).alias("l"), (-F.col("r")).alias("r"))
        best_l = rest.groupBy("b", "l").agg(F.max(rank).alias("x")).select("b", "l", F.col("x.s").alias("s"), (-F.col("x.r")).alias("r"))
        best_r = rest.groupBy("b", "r").agg(F.max(rank).alias("x")).select("b", "r", F.col("x.s").alias("s"), (-F.col("x.l")).alias("l"))
        found = best_l.join(best_r, ["b", "l", "r", "s"]).checkpoint()
        taken = found if taken is None else taken.unionByName(found)
        rest = rest.join(found.select("b", "l"), ["b", "l"], "left_anti").join(found.select("b", "r"), ["b", "r"], "left_anti").checkpoint()
        if rest.isEmpty():
            return taken.select(F.col("b").alias(block), F.col("l").alias(left), F.col("r").alias(right), F.col("s").alias(score))


def greedy_in_order(edges: DataFrame, block: str = "block", left: str = "left", right: str = "right", score: str = "score", more: tuple[str, ...] = ()) -> DataFrame:
    """The matching of greedy_one_to_one() in one pass over the sorted edges of each block; columns ``more`` of an edge stay with it.

    For blocks with many edges and ties, where rounds are many.  A task holds the matched ends of
    one block only; its edges stream by.
    """

    def coded(column: pa.Array) -> tuple[list[int], list]:
        """Numbers in place of values, which are made Python objects once each."""
        found = column.dictionary_encode("encode")
        return found.indices.to_pylist() if found.indices.null_count else found.indices.to_numpy().tolist(), found.dictionary.to_pylist()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, begun, lefts, rights = None, False, set(), set()
        for batch in batches:
            (bs, blocks), (xs, left_names), (ys, right_names) = (coded(batch.column(k)) for k in range(3))
            now = bs[0] if bs and begun and blocks[bs[0]] == at else None
            # The block of the batch before goes on: its matched ends are not free here.
            left_of, right_of = ([k for k, v in enumerate(names) if now is not None and v in held] for names, held in ((left_names, lefts), (right_names, rights)))
            took_left, took_right = bytearray(len(left_names)), bytearray(len(right_names))
            for v in left_of:
                took_left[v] = 1
            for v in right_of:
                took_right[v] = 1
            kept: list[int] = []
            for i, (b, x, y) in enumerate(zip(bs, xs, ys, strict=True)):
                if b != now:
                    for v in left_of:
                        took_left[v] = 0
                    for v in right_of:
                        took_right[v] = 0
                    now, left_of, right_of, lefts, rights = b, [], [], set(), set()
                if not took_left[x] and not took_right[y]:
                    took_left[x] = took_right[y] = 1
                    left_of.append(x)
                    right_of.append(y)
                    kept.append(i)
            if bs:
                at, begun = blocks[now], True
                lefts.update(left_names[v] for v in left_of)
                rights.update(right_names[v] for v in right_of)
            yield batch.take(pa.array(kept, pa.int64()))

    rows = edges.select(block, left, right, score, *more)
    return rows.repartition(block).sortWithinPartitions(F.col(block), F.desc(score), F.col(left), F.col(right)).mapInArrow(take, rows.schema)


def first_come(edges: DataFrame, block: str = "block", left: str = "left", right: str = "right", score: str = "score") -> DataFrame:
    """Left ends in their order, each with its best right end that is still free.

    One pass over the sorted edges of each block; a task holds the matched right ends of one block.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, done, used = None, None, set()
        for batch in batches:
            kept = []
            for i, (b, x, y) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                if b != at:
                    at, done, used = b, None, set()
                if x != done and y not in used:
                    done = x
                    used.add(y)
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    rows = edges.select(block, left, right, score)
    return rows.repartition(block).sortWithinPartitions(F.col(block), F.col(left), F.desc(score), F.col(right)).mapInArrow(take, rows.schema)
