"""Near-duplicate documents by improved consistent weighted sampling.

Documents become multisets of word shingles weighted by TF-IDF.  Improved consistent weighted
sampling (ICWS) draws one (shingle, level) sample per hash function such that two documents
draw the same one with a probability equal to their weighted Jaccard similarity.  Samples are
banded; documents that share a band are compared exactly.

Stages, all on Spark:

1. *Document frequencies.*  A count-min sketch over all documents, summed per block of counters in
   two levels.  Its error is a fixed share of the number of documents, whatever that number is, and
   lies below the share ``RARE`` at which the IDF stops growing.
2. *Signatures*, one pass over the texts, no shuffle of texts.
3. *Exact copies* collapse by two independent 64-bit hashes before anything is compared.
4. *Pivots.*  In each bucket every document is verified against the bucket's smallest, in blocks of
   bounded size; the smallest one's text goes once to each block.
5. *Rest.*  Buckets whose other members are still in several components are compared in full, in
   blocks: a member outside the bucket's main component meets every member of the others.  Pairs
   that are connected already are skipped, as they cannot change a class.

Two texts are linked if their weighted Jaccard similarity reaches the threshold, or their plain
one (all weights alike) does: copies that make up much of a corpus make their own shingles
frequent, so that the weights alone would part them.

No bucket is capped and no pair of copies is expanded.  Results depend on texts only.

Edge cases: a null or empty text, or one of white space only, is a class of its own; a text of
one to four words has one shingle, all its words; a very long text is read whole, as one part of
its own; rows that repeat a doc_id are judged by their own texts, and those that repeat its text
too share its class; a row with a null doc_id has a null class and is kept; other columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .scratch import materialise
from .textops import mix64, shingle_counts, slices, sorted_groups, tidy

#: Counters in each of the sketch's two rows, and counters in one block of its sum.
SKETCH, BLOCK = 1 << 17, 1 << 14
#: The IDF of a shingle grows until it is as rare as this share of all documents.
RARE = 0.01


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & np.uint64(SKETCH - 1)).astype(np.int64), SKETCH + ((hashes >> np.uint64(32)) & np.uint64(SKETCH - 1)).astype(np.int64)


def document_frequencies(docs: DataFrame, text_col: str = "text", width: int = 5) -> tuple[int, np.ndarray]:
    """Number of documents and the two-row count-min sketch of how many of them hold a shingle.

    The sketch has a fixed size (2 x SKETCH counters); what executors send grows with the number
    of tasks, not with the number of shingles.
    """

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, n = np.zeros(2 * SKETCH, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for part in slices(batch, "text"):
                _, hashes, _ = shingle_counts(part["text"], width)
                for places in _places(hashes):
                    sketch += np.bincount(places, minlength=2 * SKETCH)
        if n:
            kind = np.uint16 if sketch.max() < 65536 else np.uint32 if sketch.max() < 1 << 32 else np.int64
            blocks = [k for k in range(2 * SKETCH // BLOCK) if sketch[k * BLOCK : (k + 1) * BLOCK].any()]
            yield pa.RecordBatch.from_pydict({"block": pa.array([-1, *blocks], pa.int32()), "task": pa.array([TaskContext.get().partitionId()] * (1 + len(blocks)), pa.int32()), "size": pa.array([8] + [np.dtype(kind).itemsize] * len(blocks), pa.int32()), "data": pa.array([np.int64(n).tobytes(), *(sketch[k * BLOCK : (k + 1) * BLOCK].astype(kind).tobytes() for k in blocks)], pa.binary())})

    @tidy
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                part = np.frombuffer(row["data"], {2: np.uint16, 4: np.uint32, 8: np.int64}[row["size"]]).astype(np.int64)
                sums[row["block"]] = sums.get(row["block"], 0) + part
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "size": pa.array([8] * len(sums), pa.int32()), "data": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "block int, task int, size int, data binary")
    # Of so many tasks' sketches one task sums 64, so that the last sum meets a 64th of them.
    some = parts.repartition("block", F.expr("task div 64")).mapInArrow(total, "block int, size int, data binary")
    rows = some.repartition("block").mapInArrow(total, "block int, size int, data binary").collect()  # 2 x SKETCH counters at most
    sketch, n = np.zeros(2 * SKETCH, np.int64), 0
    for row in rows:
        if row["block"] < 0:
            n = int(np.frombuffer(row["data"], np.int64)[0])
        else:
            sketch[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["data"], np.int64)
    return n, sketch


def idf_table(n: int, sketch: np.ndarray) -> np.ndarray:
    """IDF by sketch counter: 1 + ln(1 / share of documents), the share within [RARE, 1]; so from 1 to 5.6."""
    return (1 - np.log(np.clip(sketch / max(n, 1), RARE, 1))).astype(np.float32)


def shingle_weights(idf: np.ndarray, hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
    """TF-IDF; of the two estimates the one of the smaller count is the better."""
    a, b = _places(hashes)
    return times.astype(np.float32) * np.maximum(idf[a], idf[b])


def icws(row: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_hashes: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have shingles and, for each, ``n_hashes`` consistent weighted samples (uint64)."""
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    out = np.empty((len(first), n_hashes), np.uint64)
    if not len(first):
        return row[first], out
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(row))))
    log_w = np.log(weights.astype(np.float32))
    low, tiny = np.uint64((1 << 21) - 1), np.float32(2.0**-21)
    half = np.float32(0.5)
    log_a, level = np.empty(len(row), np.float32), np.empty(len(row), np.int32)
    for k in range(n_hashes):
        step = 1 << 15
        for i in range(0, len(row), step):
            s = slice(i, i + step)
            z = mix64(hashes[s] + np.uint64(((seed * 1000 + k + 1) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))
            y = mix64(z + np.uint64(0xD1B54A32D192ED03))
            u = [((x >> np.uint64(shift)) & low).astype(np.float32) * tiny + half * tiny for x, shift in ((z, 0), (z, 21), (z, 42), (y, 0), (y, 21))]
            r = -np.log(u[0] * u[1])
            log_c = np.log(-np.log(u[2] * u[3]))
            t = np.floor(log_w[s] / r + u[4])
            level[s] = t
            log_a[s] = log_c - r * (t - u[4] + np.float32(1))
        best = np.minimum.reduceat(log_a, first)
        at = np.flatnonzero(log_a == best[of])
        at = at[np.concatenate([[True], of[at][1:] != of[at][:-1]])]
        out[:, k] = mix64(hashes[at] + level[at].astype(np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(k))
    return row[first], out


def text_hashes(text: Column) -> tuple[Column, Column]:
    """h1 and h2; the salt stands first, as it is the seed with which the text is then hashed."""
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")


def signatures(docs: DataFrame, idf: np.ndarray, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """One row per document: doc_id, h1, h2 (hash of the text; null without words), keys (one per band)."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # 2 x SKETCH floats

    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                row, hashes, times = shingle_counts(part["text"], width)
                who, samples = icws(row, hashes, shingle_weights(idf, hashes, times), bands * rows)
                keys = np.zeros((len(who), bands), np.uint64)
                for k in range(rows):
                    keys = mix64(keys + samples[:, k::rows][:, :bands] + np.uint64(k + 1))
                worded = np.zeros(part.num_rows, bool)
                worded[who] = True
                values = np.zeros((part.num_rows, bands), np.int64)
                values[who] = keys.view(np.int64)
                offsets = pa.array(np.arange(0, (part.num_rows + 1) * bands, bands, dtype=np.int32))
                arrays = [part["doc_id"].combine_chunks(), part["h1"].combine_chunks(), part["h2"].combine_chunks(), part["bytes"].combine_chunks(), pa.ListArray.from_arrays(offsets, pa.array(values.ravel())), pa.array(worded)]
                yield pa.RecordBatch.from_arrays([x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in arrays], ["doc_id", "h1", "h2", "bytes", "keys", "worded"])

    text = F.col(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *text_hashes(text), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    return source.mapInArrow(sign, "doc_id long, h1 long, h2 long, bytes long, keys array<long>, worded boolean")


def similarities(left: pa.ChunkedArray, right: pa.ChunkedArray, idf: np.ndarray, width: int) -> np.ndarray:
    """The larger one of the weighted and the plain Jaccard similarity of text pairs, in double precision."""
    n = len(left)
    (ra, ha, ta), (rb, hb, tb) = shingle_counts(left, width), shingle_counts(right, width)
    row, h, times = np.concatenate([ra, rb]), np.concatenate([ha, hb]), np.concatenate([ta, tb])
    order = np.lexsort((h, row))
    row, h, times = row[order], h[order], times[order]
    both = np.flatnonzero((row[1:] == row[:-1]) & (h[1:] == h[:-1]))
    best = np.zeros(n)
    for w in (shingle_weights(idf, h, times).astype(float), times.astype(float)):
        shared = np.bincount(row[both], np.minimum(w[both], w[both + 1]), n)
        total = np.bincount(row, w, n) - shared
        best = np.maximum(best, np.divide(shared, total, out=np.zeros(n), where=total > 0))
    return best


def near_pivot(pivot: pa.ChunkedArray, texts: pa.ChunkedArray, idf: np.ndarray, width: int, threshold: float) -> np.ndarray:
    """Which texts are as similar to the one pivot as similarities() asks."""
    _, hp, tp = shingle_counts(pivot, width)
    row, h, times = shingle_counts(texts, width)
    place = np.minimum(np.searchsorted(hp, h), max(len(hp) - 1, 0))
    hit = hp[place] == h if len(hp) else np.zeros(len(h), bool)
    near = np.zeros(len(texts), bool)
    for wp, w in ((shingle_weights(idf, hp, tp).astype(float), shingle_weights(idf, h, times).astype(float)), (tp.astype(float), times.astype(float))):
        shared = np.bincount(row[hit], np.minimum(w[hit], wp[place[hit]]), len(texts))
        near |= (shared > 0) & (shared >= threshold * (np.bincount(row, w, len(texts)) + wp.sum() - shared))
    return near


def _compare(group: pa.Table, idf: np.ndarray, width: int, threshold: float) -> list[tuple[int, int]]:
    """Links of 'minor' members of a bucket with each other and with its 'major' ones, between different components."""
    group = group.sort_by([("minor", "ascending"), ("doc", "ascending")])
    ids, minor = group["doc"].to_pylist(), np.asarray(group["minor"])
    root = {c: c for c in group["comp"].to_pylist()}
    comp = group["comp"].to_pylist()

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    row, hashes, times = shingle_counts(group["text"], width)
    kinds = (shingle_weights(idf, hashes, times).astype(float), times.astype(float))
    wholes = [np.bincount(row, w, len(ids)) for w in kinds]
    code = pd.factorize(hashes)[0]
    order = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[order], np.arange(code.max() + 2 if len(code) else 1))
    first = np.searchsorted(row, np.arange(len(ids) + 1))
    found = []
    for i in np.flatnonzero(minor):
        mine = slice(first[i], first[i + 1])
        lengths = starts[code[mine] + 1] - starts[code[mine]]
        posts = order[np.repeat(starts[code[mine]] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
        near = np.zeros(len(ids), bool)
        for weights, whole in zip(kinds, wholes, strict=True):
            shared = np.bincount(row[posts], np.minimum(weights[posts], np.repeat(weights[mine], lengths)), len(ids))
            near |= (shared > 0) & (shared >= threshold * (whole + whole[i] - shared))
        for j in np.flatnonzero(near):
            if (not minor[j] or j < i) and (x := find(comp[i])) != (y := find(comp[j])):
                root[max(x, y)] = min(x, y)
                found.append((ids[i], ids[j]))
    return found


def _classified(docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, width: int = 5, bands: int = 10, rows: int = 3, block: int = 512, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, h1, h2 (hashes of its text), class_id, kept."""
    spark = docs.sparkSession
    n, sketch = document_frequencies(docs, text_col, width)
    idf = idf_table(n, sketch)
    shared = spark.sparkContext.broadcast(idf)
    signed = materialise(signatures(docs, idf, id_col, text_col, width, bands, rows), "signatures")

    # One row per distinct text; its number is stable, as the table is written.
    texts = signed.where("worded and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("bytes").alias("bytes"))
    texts = materialise(texts.withColumn("doc", F.monotonically_increasing_id()), "texts")
    buckets = texts.select("doc", "bytes", F.posexplode("keys").alias("band", "key"))
    sets = buckets.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("doc").alias("pivot"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("members")).where("size > 1")
    # Bands often gather the very same documents; one bucket of each set is enough.
    sets = sets.groupBy("size", "pivot", "members").agg(F.min(F.struct("band", "key")).alias("bucket")).select("size", "pivot", "bucket.band", "bucket.key")
    members = materialise(buckets.join(sets, ["band", "key"]).where("doc <> pivot").select("band", "key", "size", "pivot", "doc", "bytes"), "buckets")

    wanted = members.select("doc").unionAll(members.select(F.col("pivot").alias("doc"))).distinct()
    wanted = wanted.join(texts.select("doc", "first_doc", "h1", "h2"), "doc")
    # The ids grow with the corpus; a plan that broadcasts them while they are few would not be the one that runs at scale.
    bodies = docs.select(F.col(id_col).cast("long").alias("first_doc"), F.col(text_col).alias("text"), *text_hashes(F.col(text_col))).join(wanted.hint("merge"), ["first_doc", "h1", "h2"])
    bodies = materialise(bodies.dropDuplicates(["first_doc", "h1", "h2"]).select("doc", "text"), "bodies")

    # So many blocks of a number of texts of so many bytes in all hold ``block`` texts and ``block_bytes`` or less, give or take.
    parts_of = lambda number, size: F.greatest(F.ceil(number / block), F.ceil(size / block_bytes), F.lit(1)).cast("int")

    @tidy
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, pivot), group in sorted_groups(batches, ["cell", "pivot"]):
            head, rest = group.slice(0, 1), group.slice(1)
            for part in slices(rest, "text") if rest.num_rows else ():
                near = near_pivot(head["text"], part["text"], shared.value, width, threshold)
                found = part["doc"].filter(pa.array(near)).to_pylist()
                if found:
                    yield pa.RecordBatch.from_pydict({"a": pa.array([pivot] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    # A pivot's text goes once to each block of its members, and stands first there.
    pairs = members.select("pivot", "doc", "bytes").distinct()
    spread = pairs.groupBy("pivot").agg(parts_of(F.count("*"), F.sum("bytes")).alias("blocks"))
    heads = spread.select("pivot", F.col("pivot").alias("doc"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"))
    rest = pairs.join(spread.hint("merge"), "pivot").select("pivot", "doc", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("kind"))
    rows_ = heads.unionByName(rest).withColumn("cell", F.xxhash64("pivot", "block")).join(bodies.hint("merge"), "doc").select("cell", "pivot", "kind", "doc", "text")
    links = materialise(rows_.repartition("cell").sortWithinPartitions("cell", "pivot", "kind").mapInArrow(verify, "a long, b long"), "links")
    components = connected_components(links)

    # Buckets of three or more whose members other than the pivot are not all connected.
    rest = members.where("size > 2").join(components.withColumnRenamed("id", "doc"), "doc", "left").select("band", "key", "doc", "bytes", F.coalesce("component", "doc").alias("comp"))
    parts = rest.groupBy("band", "key", "comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"))
    main = parts.groupBy("band", "key").agg(F.count("*").alias("kinds"), F.max(F.struct("n", "comp", "size")).alias("most"), F.sum("n").alias("all"), F.sum("size").alias("whole")).where("kinds > 1")
    main = main.select("band", "key", F.col("most.comp").alias("main"), parts_of(F.col("most.n"), F.col("most.size")).alias("majors"), parts_of(F.col("all") - F.col("most.n"), F.col("whole") - F.col("most.size")).alias("minors"))
    rest = rest.join(main, ["band", "key"]).withColumn("minor", F.col("comp") != F.col("main"))
    mine = F.pmod(F.xxhash64("doc"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors"))).cast("int")
    # A minor block meets every major block, and every minor block at or after its own.
    cells = F.when(
        F.col("minor"),
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("majors") - 1), lambda j: F.struct(mine.alias("x"), j.alias("y"), F.lit(False).alias("own"))),
            F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda j: F.struct(F.greatest(mine, j).alias("x"), F.least(mine, j).alias("y"), F.lit(True).alias("own"))),
        ),
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda i: F.struct(i.alias("x"), mine.alias("y"), F.lit(False).alias("own"))))
    rest = rest.select("band", "key", "doc", "comp", "minor", F.explode(cells).alias("cell")).select(F.xxhash64("band", "key", "cell.x", "cell.y", "cell.own").alias("cell"), "doc", "comp", "minor")

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in sorted_groups(batches, ["cell"]):
            if found := _compare(group, shared.value, width, threshold):
                yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    more = rest.join(bodies, "doc").repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "a long, b long")
    components = connected_components(links.unionAll(materialise(more, "links")))

    # A class has the smallest doc_id of all its texts.
    placed = texts.select("doc", "h1", "h2", "first_doc", "copies").join(components.withColumnRenamed("id", "doc").hint("merge"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    names = placed.groupBy("component").agg(F.min("first_doc").alias("class"))
    placed = materialise(placed.join(names.hint("merge"), "component").select("h1", "h2", "copies", "class"), "classes")
    signed = signed.select("doc_id", "h1", "h2", "worded")
    # Texts of at least a 4096th of all rows are 4096 at most: they are broadcast, so that no key of the other join is hot.
    hot = F.broadcast(placed.where(F.col("copies") * 4096 >= n).drop("copies"))
    rest = placed.where(F.col("copies") * 4096 < n).drop("copies")
    named = signed.where("worded and doc_id is not null")
    both = named.join(hot, ["h1", "h2"]).unionByName(named.join(hot, ["h1", "h2"], "left_anti").join(rest.hint("merge"), ["h1", "h2"]))
    both = both.unionByName(signed.where("not worded or doc_id is null").withColumn("class", F.col("doc_id"))).withColumnRenamed("class", "class_id")
    return both.select("doc_id", "h1", "h2", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Classes of near-duplicate documents: one row (doc_id, class_id, kept) per row of ``docs``.

    class_id is the smallest doc_id of the class, kept marks that document.  With 10 bands of 3
    samples a pair of weighted similarity 0.8 shares a band with probability 0.999, one of 0.65
    with 0.96 and one of 0.3 with 0.24.  Options: threshold, width, bands,
    rows, and block and block_bytes, how many texts and bytes are compared in one piece.
    """
    return _classified(docs, id_col, text_col, **options).select("doc_id", "class_id", "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that near_duplicates() keeps, all columns as they are.

    Rows that repeat both doc_id and text stay or go together; rows with a null doc_id stay.
    """
    columns = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(columns))))  # names of its own, whatever the columns are called
    id_, text = f"c{columns.index(id_col)}", f"c{columns.index(text_col)}"
    gone = _classified(plain, id_, text, **options).where("not kept").select("doc_id", "h1", "h2").distinct()
    # Ids that go grow with the corpus: never broadcast.
    rows = plain.withColumns(dict(zip(("h1", "h2"), text_hashes(F.col(text)), strict=True))).withColumn("doc_id", F.col(id_).cast("long"))
    return rows.join(gone.hint("merge"), ["doc_id", "h1", "h2"], "left_anti").select(*plain.columns).toDF(*columns)
