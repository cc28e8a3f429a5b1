"""Vector bin packing of token sequences.

A bin has simultaneous limits on tokens, segments and loss-bearing tokens.  It is filled by the
dot-product heuristic: of the items that fit, the one whose demand has the largest product with
what the bin has left, each dimension measured against its limit.  Each Spark task packs what its
partition holds through a bounded pool, so nothing is shuffled and memory does not grow.

``pack_examples`` places whole instruction examples.  ``pack_documents`` tokenises texts and may
cut them: where nothing fits any more an item is cut to fill the bin, and what remains at the end
of a partition goes into sequences of power-of-two length, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import slices, tidy
from .tokens import batch_tokenizer, default_path

#: Sequence numbers are unique over partitions: the partition's number times this, plus a count.
PER_PARTITION = 1 << 40


class VectorPacker:
    """Fills bins from a pool of items (key, tokens, loss); place(bin, offset, key, start, length) is called per piece."""

    def __init__(self, limits: tuple[int, int, int], place, cut: bool, pool: int = 2048) -> None:
        self.limits, self.place, self.cut, self.pool = np.array(limits, float), place, cut, pool
        self.demand = np.zeros((pool, 3))
        self.keys: list = [None] * pool
        self.starts = np.zeros(pool, np.int64)
        self.n = self.bins = 0

    def add(self, key, start: int, tokens: int, loss: int) -> None:
        if tokens <= 0:
            return
        if not self.cut and (tokens > self.limits[0] or loss > self.limits[2]):
            self.place(self._open(), 0, key, start, tokens)  # fits nowhere: a sequence of its own
            return
        if self.n == self.pool:
            while self.n > self.pool // 2:
                self.fill()
        self.demand[self.n] = tokens, 1, loss
        self.keys[self.n], self.starts[self.n] = key, start
        self.n += 1

    def _open(self) -> int:
        self.bins += 1
        return self.bins - 1

    def _remove(self, k: int) -> None:
        last = self.n - 1
        self.demand[k], self.keys[k], self.starts[k] = self.demand[last], self.keys[last], self.starts[last]
        self.keys[last] = None
        self.n = last

    def fill(self, size: int | None = None) -> None:
        """Fill one bin; size: its tokens, if fewer than the limit."""
        left, number, offset = self.limits.copy(), self._open(), 0
        left[0] = size or left[0]
        while self.n and left[0] > 0 and left[1] > 0 and left[2] >= 0:
            demand = self.demand[: self.n]
            score = demand @ (left / self.limits**2)
            score[(demand > left).any(axis=1)] = -1
            k = int(score.argmax())
            if score[k] < 0:
                if not self.cut or left[2] <= 0:
                    break
                k = int(demand[:, 0].argmax())
                share = demand[k, 2] / demand[k, 0]
                room = int(min(left[0], left[2] / share if share else left[0], demand[k, 0]))
                if room < 1:
                    break
                self.place(number, offset, self.keys[k], int(self.starts[k]), room)
                self.starts[k] += room
                self.demand[k] -= room, 0, room * share
                left -= room, 1, room * share
            else:
                room = int(demand[k, 0])
                self.place(number, offset, self.keys[k], int(self.starts[k]), room)
                left -= demand[k]
                self._remove(k)
            offset += room

    def close(self) -> None:
        """Place what the pool still holds."""
        while self.n:
            total = int(self.demand[: self.n, 0].sum())
            if self.cut and total < self.limits[0]:
                self.fill(1 << (total.bit_length() - 1))
            else:
                self.fill()


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, max_segments: int = 512, max_loss: int | None = None, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Pack whole documents into sequences of at most ``length`` tokens, cutting where needed.

    All of a document's ids, and ``end_id`` after them, bear loss.  One row per piece: doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset.  A null or empty text is the one id
    ``end_id``; rows that repeat a doc_id, or have none, are documents of their own; other columns
    are ignored; an empty table gives no rows.
    """
    path = path or default_path()
    limits = (length, max_segments, max_loss or length)

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, base = batch_tokenizer(path), TaskContext.get().partitionId() * PER_PARTITION
        rows: list[list] = [[] for _ in range(7)]

        def place(number: int, offset: int, key: tuple, start: int, n: int) -> None:
            doc, ids, shift, total = key
            for column, value in zip(rows, (doc, start, n, zlib.crc32(ids[start - shift : start - shift + n].tobytes()), total, base + number, offset), strict=True):
                column.append(value)

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], NAMES)
            for column in rows:
                column.clear()
            return batch

        packer = VectorPacker(limits, place, cut=True)
        whole = min(length, limits[2])
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids, bounds = tokenizer.encode(part["text"])
                for doc, a, b in zip(part["doc_id"].to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    full = len(own) // whole * whole
                    for start in range(0, full, whole):
                        place(packer._open(), 0, (doc, own, 0, len(own)), start, whole)
                    packer.add((doc, own[full:].copy(), full, len(own)), full, len(own) - full, len(own) - full)
                if len(rows[0]) > 20_000:
                    yield out()
        packer.close()
        yield out()

    NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(pack, ", ".join(f"{n} long" for n in NAMES))


def pack_examples(examples: DataFrame, id_col: str, tokens_col: str, loss_col: str, length: int = 2048, max_segments: int = 64, max_loss: int = 1024) -> DataFrame:
    """Place whole instruction examples under all three limits at once: example, sequence_id, offset, tokens, loss.

    An example over a limit by itself has a sequence of its own; one without tokens (null, zero)
    has none and is left out.
    """

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() * PER_PARTITION
        rows: list[tuple] = []
        packer = VectorPacker((length, max_segments, max_loss), lambda number, offset, key, start, n: rows.append((key[0], base + number, offset, n, key[1])), cut=False)

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 5
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["example", "sequence_id", "offset", "tokens", "loss"])

        for batch in batches:
            for row in batch.to_pylist():
                packer.add((row["example"], row["loss"] or 0), 0, row["tokens"] or 0, row["loss"] or 0)
            yield out()
        packer.close()
        yield out()

    source = examples.select(F.col(id_col).cast("long").alias("example"), F.col(tokens_col).cast("long").alias("tokens"), F.col(loss_col).cast("long").alias("loss"))
    return source.mapInArrow(pack, "example long, sequence_id long, offset long, tokens long, loss long")
