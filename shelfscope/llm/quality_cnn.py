"""Quality scores by a byte-level convolutional network in numpy.

A text's bytes are embedded and learned filters slide over all of them.  The text is covered by
chunks that overlap by half; each filter is max-pooled per chunk, a small layer reads the pooled
values, and its outputs, averaged over all chunks of the text, give one probability.  Nothing is
cut off: cost is linear in the text, memory is that of one block.

The network is trained on a bounded sample of labelled rows (``per_class`` rows of each label and
``chunks`` chunks of each row, drawn by hash; these are all that the driver gets).  Rows whose
crc32(id) mod 5 is 0 are held out.  Scores see the bytes of the text and nothing else.

Edge cases: a null or empty text has one chunk of nothing and gets its score; null labels and
labels of unknown documents are ignored, and an id labelled both ways is learned both ways; without labels of both kinds all scores are 0.5; rows
that repeat a doc_id are scored each; a null doc_id is not held out; other columns are ignored by
score_quality and kept by keep_good; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import slices, tidy, utf8_buffer

#: Bytes per half chunk, width and step of the filters in bytes.
HALF, WIDTH, STEP = 128, 8, 2


def _filled(held: np.ndarray) -> np.ndarray:
    """How full chunks of so many bytes are, twice."""
    share = held.astype(np.float32)[:, None] / np.float32(2 * HALF)
    return np.hstack([share, np.sqrt(share)])


class ByteCnn:
    """embed 256 x d, filters (WIDTH * d) x f, hidden f x h, out h; fill, 2 x h, tells full chunks from short ones."""

    NAMES = ("embed", "filters", "bias", "hidden", "fill", "hidden_bias", "out", "out_bias")

    def __init__(self, seed: int = 1, d: int = 8, f: int = 48, h: int = 24) -> None:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.standard_normal(shape).astype(np.float32)
        self.embed = normal(256, d)
        self.filters = normal(WIDTH * d, f) * np.float32((WIDTH * d) ** -0.5)
        self.bias = np.zeros(f, np.float32)
        self.hidden = normal(f, h) * np.float32(f**-0.5)
        self.fill = np.zeros((2, h), np.float32)
        self.hidden_bias = np.zeros(h, np.float32)
        self.out = normal(h) * np.float32(h**-0.5)
        self.out_bias = np.zeros(1, np.float32)

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """Embedded filter inputs of rows of bytes, (rows, positions, WIDTH * d)."""
        e = self.embed[rows]
        n, length, d = e.shape
        count = (length - WIDTH) // STEP + 1
        view = np.lib.stride_tricks.as_strided(e, (n, count, WIDTH * d), (e.strides[0], STEP * e.strides[1], e.strides[2]))
        return np.ascontiguousarray(view)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 of all texts in a buffer."""
        sizes = np.diff(offsets)
        halves = np.maximum(1, -(-sizes // HALF))
        first = np.cumsum(halves) - halves
        flat = np.zeros(int(halves.sum()) * HALF + WIDTH, np.uint8)
        shift = np.repeat(first * HALF - offsets[:-1], sizes)
        flat[np.arange(len(data)) + shift] = data
        total = int(halves.sum())
        pooled = np.empty((total, len(self.bias)), np.float32)
        last = first + halves - 1
        for i in range(0, total, 128):
            j = min(i + 128, total)
            rows = np.lib.stride_tricks.as_strided(flat[i * HALF :], (j - i, HALF + WIDTH - STEP), (HALF, 1)).copy()
            ends = last[(last >= i) & (last < j)] - i
            rows[ends, HALF:] = 0  # a filter does not look into the next text
            values = self.windows(rows)
            pooled[i:j] = (values.reshape(-1, values.shape[2]) @ self.filters).reshape(j - i, -1, len(self.bias)).max(axis=1)
        # A chunk is two neighbouring halves of a text; a text of one half is one chunk.
        follow = np.arange(total)
        follow[:-1] += 1
        follow[last] = last
        chunk = np.maximum(pooled, pooled[follow])
        alone = np.zeros(total, bool)
        alone[last[halves > 1]] = True
        held = np.clip(np.repeat(sizes, halves) - (np.arange(total) - np.repeat(first, halves)) * HALF, 0, 2 * HALF)
        hidden = np.maximum(np.maximum(chunk + self.bias, 0) @ self.hidden + _filled(held) @ self.fill + self.hidden_bias, 0)
        hidden[alone] = 0
        mean = np.add.reduceat(hidden, first, axis=0) / np.maximum(halves - 1, 1)[:, None] if len(first) else np.zeros((0, len(self.out)))
        z = (mean @ self.out + self.out_bias).astype(float)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, chunks: list[np.ndarray], labels: np.ndarray, least_steps: int = 500, rate: float = 0.004, batch: int = 48, seed: int = 2) -> ByteCnn:
        """Cross-entropy by Adam; chunks[k] holds the sampled chunks of text k, one per row."""
        rng = np.random.default_rng(seed)
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9)).astype(np.float32)
        state = {n: (np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))) for n in self.NAMES}
        step, d = 0, self.embed.shape[1]
        rounds = max(6, -(-least_steps // -(-len(chunks) // batch)))
        steps = rounds * -(-len(chunks) // batch)
        for _ in range(rounds):
            order = rng.permutation(len(chunks))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                counts = np.array([len(chunks[k]) for k in some])
                own = np.repeat(np.arange(len(some)), counts)
                rows = np.concatenate([chunks[k] for k in some])
                win = self.windows(rows)
                raw = (win.reshape(-1, win.shape[2]) @ self.filters).reshape(len(rows), -1, len(self.bias))
                place = raw.argmax(axis=1)
                pooled = np.take_along_axis(raw, place[:, None], 1)[:, 0] + self.bias
                active = np.maximum(pooled, 0)
                held = _filled((rows[:, : 2 * HALF] != 0).sum(axis=1))
                pre = active @ self.hidden + held @ self.fill + self.hidden_bias
                hidden = np.maximum(pre, 0)
                mean = np.zeros((len(some), hidden.shape[1]), np.float32)
                np.add.at(mean, own, hidden / counts[own, None].astype(np.float32))
                z = mean @ self.out + self.out_bias
                dz = ((1 / (1 + np.exp(-z)) - labels[some]) * weight[some] / len(some)).astype(np.float32)
                grad = {"out": mean.T @ dz, "out_bias": dz.sum(keepdims=True)}
                dh = (dz[:, None] * self.out)[own] / counts[own, None].astype(np.float32) * (pre > 0)
                grad |= {"hidden": active.T @ dh, "fill": held.T @ dh, "hidden_bias": dh.sum(axis=0)}
                dp = (dh @ self.hidden.T) * (pooled > 0)
                grad["bias"] = dp.sum(axis=0)
                best = win[np.arange(len(rows))[:, None], place]
                grad["filters"] = np.einsum("nfk,nf->kf", best, dp, optimize=True)
                back = (dp[:, :, None] * self.filters.T).reshape(-1, d)
                seen = rows[np.arange(len(rows))[:, None, None], place[:, :, None] * STEP + np.arange(WIDTH)].ravel()
                grad["embed"] = np.stack([np.bincount(seen, back[:, k], 256) for k in range(d)], axis=1).astype(np.float32)
                step += 1
                pace = rate * min(1, 4 * (1 - step / (steps + 1)))
                for n, g in grad.items():
                    m, v = state[n]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    getattr(self, n)[...] -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


def held_out(id_: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(id_.cast("string")) % 5 == 0, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 2500, chunks: int = 8, seed: int = 1) -> ByteCnn | None:
    """Fit the network on at most about ``per_class`` labelled rows of each kind; None without both kinds."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))).distinct()
    sizes = dict(known.groupBy("y").agg(F.count("*").alias("n")).collect())
    if len(sizes) < 2:
        return None
    parts = F.when(F.col("y") == 1, max(1, sizes[1] // per_class)).otherwise(max(1, sizes[0] // per_class))
    some = known.where(F.pmod(F.xxhash64("id"), parts) == 0).orderBy(F.xxhash64("id"), "id", "y").limit(4 * per_class)  # a fixed order, so that reruns agree

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8_buffer(part["text"])
                out: list[list[bytes]] = []
                for k, id_ in enumerate(part["id"].to_pylist()):
                    own = np.concatenate([data[offsets[k] : offsets[k + 1]], np.zeros(2 * HALF + WIDTH, np.uint8)])
                    many = max(1, -(-int(offsets[k + 1] - offsets[k]) // HALF) - 1)
                    pick = np.random.default_rng([seed, abs(id_)]).permutation(many)[:chunks]
                    out.append([own[p * HALF : p * HALF + 2 * HALF + WIDTH - STEP].tobytes() for p in sorted(pick.tolist())])
                yield pa.RecordBatch.from_arrays([pa.array(part["id"].to_pylist(), pa.int64()), pa.array(part["y"].to_pylist(), pa.int32()), pa.array(out, pa.list_(pa.binary()))], ["id", "y", "chunks"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # At most 4 * per_class pairs of numbers are broadcast.
    rows = texts.join(F.broadcast(some), "id").mapInArrow(cut, "id long, y int, chunks array<binary>").orderBy("id", "y", "chunks").limit(8 * per_class).collect()
    rows = sorted(rows, key=lambda r: (r["id"], r["y"], r["chunks"]))
    y = np.array([r["y"] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    return ByteCnn(seed).fit([np.stack([np.frombuffer(c, np.uint8) for c in r["chunks"]]) for r in rows], y)


def _probabilities(texts: pa.ChunkedArray, model: ByteCnn | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    return model.scores(*utf8_buffer(texts))


def score_quality(docs: DataFrame, model: ByteCnn | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of whole texts: doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"].to_numpy(zero_copy_only=False), pa.int64(), from_pandas=True), pa.array(_probabilities(part["text"], shared.value))], ["doc_id", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(score, "doc_id long, score double")


def keep_good(docs: DataFrame, model: ByteCnn | None, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows whose whole text scores at least ``threshold``, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                yield from part.filter(pa.array(_probabilities(part[text_col], shared.value) >= threshold)).to_batches()

    return docs.mapInArrow(keep, docs.schema)
