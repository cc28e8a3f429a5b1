"""Mixing sources to target weights by blocks and pseudorandom permutations.

The words of each source, document after document, form a stream that is cut into blocks of a
fixed number of words.  The mix is a set of output shards; each draws how many blocks it takes of
each source from a multinomial with the sources' shares, so a source's target is met in
expectation: its blocks are so small that it has ``GRAIN`` of them or more (or of one word), which
makes the standard deviation of what it gives GRAIN ** -0.5, and of ``TRIES`` draws the one is
taken whose sources come nearest to their targets.  A source's slots are numbered over the shards,
and slot number s is the block at place s mod n of a pseudorandom permutation of its n blocks, a
new one for every epoch s div n.  So a source is used up evenly: no block is taken twice before all
are taken once, and none more than ``max_repeats`` times (a draw beyond that is cut).  Drawn slots
and the blocks of documents are joined by block number.  mix_documents() puts every repeat of a
document into the shard of its first block, and writes shard by shard.

What the driver holds is one row per source and one small row per shard and source; shards have
up to 2**18 blocks, so there are few.  The place of a document in its source's stream is a running
sum within hashed buckets plus the sum of the buckets before, so no source is one task.

Edge cases: a null or empty text has size 0 and is not taken; a null source is a source, the last;
rows that repeat a doc_id are documents of their own, ordered by size and text; a null doc_id stays
null; a very long text is cut at words like any other; an empty table gives no rows; other columns
are ignored by mix_plan and kept by mix_documents, whatever their names.  There are as many sources
as one driver can list; a source per host of a crawl would be too many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .scratch import materialise
from .textops import mix64, slices, tidy, utf8_buffer, word_spans

#: Blocks of a source's target at least, and draws of which the nearest one counts.
GRAIN, TRIES = 8192, 32
WORD = r"[^\x20\x09-\x0D]+"


def water_fill(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), max_repeats: float = 3) -> dict[str | None, float]:
    """Target words per source: all words shared by weight, none above max_repeats times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    targets: dict[str | None, float] = {}
    open_, left = set(order), float(sum(sizes.values()))
    while open_:
        whole = sum(weight[s] for s in open_)
        over = [s for s in order if s in open_ and left * weight[s] / whole > max_repeats * sizes[s]]
        if not over:
            targets |= {s: left * weight[s] / whole for s in open_}
            break
        for s in over:
            targets[s] = float(max_repeats * sizes[s])
            open_.discard(s)
        left = max(0.0, sum(sizes.values()) - sum(targets.values()))
    return targets


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: a four-round Feistel network, walked until within n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for k in range(4):
            left, right = right, left ^ (mix64(right + np.uint64((key * 4 + k) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1))) & low)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while len(over := np.flatnonzero(out >= n)):
        out[over] = once(out[over])
    return out.astype(np.int64)


def draw_shards(wanted: list[float], most: list[int], seed: int = 1, largest: int = 1 << 18, least_shards: int = 16) -> list[tuple[int, int, int, int]]:
    """(shard, source number, first slot, slots): multinomial counts of blocks, ``wanted`` of each source in expectation, at most ``most``."""
    total = round(sum(wanted))
    if not total:
        return []
    size = max(1, min(largest, -(-total // least_shards)))
    sizes = [min(size, total - at) for at in range(0, total, size)]
    share = np.array(wanted) / sum(wanted)
    best, off = None, np.inf
    for k in range(TRIES):
        counts = np.random.default_rng([seed, k]).multinomial(sizes, share)
        far = float(np.max(np.abs(counts.sum(axis=0) - wanted) / np.maximum(wanted, 1)))
        if far < off:
            best, off = counts, far
    first, out = np.zeros(len(wanted), np.int64), []
    for shard, counts in enumerate(best):
        counts = np.minimum(counts, np.array(most) - first)
        out += [(shard, k, int(first[k]), int(n)) for k, n in enumerate(counts) if n]
        first += counts
    return out


def _sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a number, a size and the key that orders their source's stream (the id, so that a rerun on other partitions agrees)."""
    # The text's hash orders rows that repeat an id; rows that are alike in both may stand in any order.
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.xxhash64(text_col).cast("string"))
    return docs.withColumns({"_row": F.monotonically_increasing_id(), "_key": key, "_size": F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")})


def _overlaps(rows: DataFrame, weights: tuple[float, ...], max_repeats: int, block_words: int, seed: int) -> DataFrame:
    """For every row (_row, _key, _source, _size) its parts by block: source_size, target, at, words, times."""
    spark = rows.sparkSession
    totals = rows.groupBy("_source").agg(F.sum("_size").alias("size"), F.count("*").alias("n")).collect()  # one row per source
    sizes = {r["_source"]: r["size"] for r in totals}
    targets = water_fill(sizes, weights, max_repeats)
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    table, wanted = [], []
    for k, s in enumerate(sources):
        words = int(max(1, min(block_words, targets[s] // GRAIN)))
        blocks = -(-sizes[s] // words)
        # The last block is shorter, so a source's words are its blocks' only on the whole.
        wanted.append(targets[s] * blocks / sizes[s] if sizes[s] else 0.0)
        table.append((s, k, sizes[s], float(targets[s]), words, blocks))
    known = {k: t[5] for k, t in enumerate(table)}

    @tidy
    def slot_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                k, n = r["k"], known[r["k"]]
                for a in range(r["first"], r["first"] + r["n"], 65536):
                    slot = np.arange(a, min(a + 65536, r["first"] + r["n"]))
                    block = np.empty(len(slot), np.int64)
                    for epoch in range(int(slot[0] // n), int(slot[-1] // n) + 1):
                        here = slot // n == epoch
                        block[here] = permute(slot[here] % n, n, (seed * 1_000_003 + k) * 8191 + epoch)
                    yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(slot), k, np.int32)), "block": pa.array(block), "slot": pa.array(slot), "shard": pa.array(np.full(len(slot), r["shard"]))})

    drawn = draw_shards(wanted, [max_repeats * t[5] for t in table], seed)
    shards = spark.createDataFrame(drawn, "shard long, k int, first long, n long")
    # A shard's row is small but makes many slots: a fixed number of partitions is not coalesced by the size of the rows.
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    times = shards.repartition(many, "shard", "k").mapInArrow(slot_blocks, "k int, block long, slot long, shard long")
    # At most max_repeats slots have the same block.
    times = times.groupBy("k", "block").agg(F.count("*").alias("times"), F.sort_array(F.collect_list(F.struct("slot", "shard")))["shard"].alias("shards"))

    of = F.broadcast(spark.createDataFrame(table, "_name string, k int, source_size long, target double, words long, blocks long"))  # one row per source
    buckets = max(256, -(-sum(r["n"] for r in totals) // 100_000))
    rows = rows.join(of, F.col("_source").eqNullSafe(F.col("_name")))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int"))
    sums = rows.groupBy("k", "bucket").agg(F.sum("_size").alias("held"))
    sums = sums.select("k", "bucket", (F.sum("held").over(Window.partitionBy("k").orderBy("bucket")) - F.col("held")).alias("before"))
    place = F.sum("_size").over(Window.partitionBy("k", "bucket").orderBy("_key", "_size", "_row").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("place", F.coalesce(place, F.lit(0))).join(sums, ["k", "bucket"]).withColumn("start", F.col("before") + F.col("place"))
    first, last = F.floor(F.col("start") / F.col("words")), F.floor((F.col("start") + F.col("_size") - 1) / F.col("words"))
    parts = rows.withColumn("block", F.explode_outer(F.when(F.col("_size") > 0, F.sequence(first.cast("long"), last.cast("long")))))
    low = F.greatest("start", F.col("block") * F.col("words"))
    high = F.least(F.col("start") + F.col("_size"), (F.col("block") + 1) * F.col("words"))
    parts = parts.withColumns({"at": low - F.col("start"), "part": high - low})
    # Blocks grow with the corpus, whatever the planner thinks of a table made from a few shards.
    return parts.join(times.hint("merge"), ["k", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = (5, 2, 1), max_repeats: int = 3, block_words: int = 256, seed: int = 1) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken, in words."""
    rows = _sized(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("_source"), F.col(text_col).alias("_text")), "doc_id", "_text").drop("_text")
    parts = _overlaps(materialise(rows, "sizes"), weights, max_repeats, block_words, seed)
    out = parts.groupBy("_row", "doc_id", "_size", "source_size", "target").agg(F.sum(F.coalesce("part", F.lit(0)) * F.col("times")).alias("taken"))
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken")


def _cut(text: str, segments: list[dict]) -> list[tuple[int, str]]:
    """Shard and text of each repeat: the words of all segments that are taken so often, in order; the shard is that of the first."""
    data, offsets = utf8_buffer(pa.array([text]))
    starts, ends, _ = word_spans(data, offsets)
    raw, out = data.tobytes(), []
    for repeat in range(1, max((s["times"] for s in segments), default=0) + 1):
        runs: list[list[int]] = []
        shard = next(s["shards"][repeat - 1] for s in segments if s["times"] >= repeat)
        for s in segments:
            if s["times"] >= repeat:
                if runs and runs[-1][1] == s["at"]:
                    runs[-1][1] += s["part"]
                else:
                    runs.append([s["at"], s["at"] + s["part"]])
        if len(runs) == 1 and runs[0] == [0, len(starts)]:
            out.append((shard, text))
        else:
            out.append((shard, "\n".join(raw[starts[a] : ends[b - 1]].decode() for a, b in runs)))
    return out


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = (5, 2, 1), max_repeats: int = 3, block_words: int = 256, seed: int = 1) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: a document is there as often as its words are taken.

    Where blocks take only part of a document, its row has the text of that part; n_chars, if
    there, follows the text.
    """
    names = docs.columns
    docs = docs.toDF(*(f"c{k}" for k in range(len(names))))  # names of its own, whatever the columns are called
    columns = docs.columns
    id_col, source_col, text_col, counted = (f"c{names.index(c)}" if c in names else "" for c in (id_col, source_col, text_col, "n_chars"))
    rows = materialise(_sized(docs, id_col, text_col).withColumn("_source", F.col(source_col)), "mixing")
    parts = _overlaps(rows.select("_row", "_key", "_source", "_size"), weights, max_repeats, block_words, seed)
    plan = parts.where("times > 0").groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("at", "part", "times", "shards"))).alias("_segments"))
    schema = docs.select(*columns).schema

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                at, texts, shards = [], [], []
                for k, (text, segments) in enumerate(zip(part[text_col].to_pylist(), part["_segments"].to_pylist(), strict=True)):
                    for shard, t in _cut(text, segments):
                        at.append(k)
                        texts.append(t)
                        shards.append(shard)
                out = part.select(columns).take(pa.array(at, pa.int64()))
                out = out.set_column(columns.index(text_col), text_col, pa.array(texts, out[text_col].type))
                if counted:
                    out = out.set_column(columns.index(counted), counted, pa.array([len(t) for t in texts], out[counted].type))
                yield from out.append_column("_shard", pa.array(shards, pa.int64())).to_batches()

    taken = rows.join(plan, "_row").select(*columns, "_segments").mapInArrow(emit, StructType([*schema.fields, StructField("_shard", LongType())]))
    # A shard is dealt to several tasks by its texts, and each task writes shard by shard, in an order that is no source's.
    taken = taken.withColumn("_spot", F.xxhash64("_shard", text_col))
    many = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return taken.repartition(many, "_shard", F.pmod("_spot", F.lit(8))).sortWithinPartitions("_shard", "_spot").select(*columns).toDF(*names)
