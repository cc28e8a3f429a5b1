"""Products of each rival against the owner's, where the rival's products lie: no pair is shuffled, sorted by Spark or written.

Rivals' products are dealt out by site, once, as they are; the owner's, one site's, go to every task.
A task makes the pairs of one rival at a time, in pieces of PIECE pairs, and holds MOST edges of it at
most, so what is shuffled grows with products and not with pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: How many pairs are looked at and how many edges are held at once; neither decides what is found.
PIECE, MOST = 1 << 20, 1 << 21

Edges = tuple[np.ndarray, np.ndarray, np.ndarray]


def each_rival(rivals: DataFrame, own: DataFrame, work: Callable[[pa.Table, pa.Table], dict[str, np.ndarray | pa.Array]], schema: str) -> DataFrame:
    """``work`` (the owner's products, a rival's products) of every rival; both have the same columns, site first, and rivals lie by site.

    ``work`` gives columns of ``schema`` after its first, which is the site.
    """
    table = own.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    sent = rivals.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = pa.ipc.open_stream(sent.value).read_all()
        for rows in _rivals(batches):
            found = work(owner, rows)
            site = rows.column(0)[0].as_py()
            columns = [x if isinstance(x := found[name], pa.Array) else pa.array(x) for name in names[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), site)), *columns], names)

    return rivals.sortWithinPartitions(rivals.columns[0]).mapInArrow(run, schema)


def _rivals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one site at a time, out of rows that are sorted by site."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        sites = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(sites[1:] != sites[:-1]) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if waiting and waiting[0].column(0)[0].as_py() != sites[begin]:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(begin, end - begin))
    if waiting:
        yield pa.Table.from_batches(waiting)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, NaN for null."""
    return table.column(name).combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False)


def coded(*columns: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The values of columns after each other as numbers, -1 for null, and the distinct values."""
    found = pa.chunked_array([c for column in columns for c in column.chunks], columns[0].type).combine_chunks().dictionary_encode()
    return found.indices.fill_null(-1).to_numpy(zero_copy_only=False), found.dictionary


class Lists:
    """Sets of numbers by row, of which the shared ones are counted for many rows at once."""

    def __init__(self, rows: np.ndarray, codes: np.ndarray, n: int) -> None:
        """``codes`` of ``rows``, which are below ``n``; a row has each code once, however often it is given."""
        self.most = int(codes.max(initial=-1)) + 1
        rows, self.codes = np.divmod(np.unique(rows.astype(np.int64) * self.most + codes), self.most) if len(codes) else (rows, codes)
        self.sizes = np.bincount(rows, minlength=n)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _spread(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of some rows, and the place among these rows that each is of."""
        sizes = self.sizes[rows]
        at = np.arange(sizes.sum()) + np.repeat(self.starts[rows] - (np.cumsum(sizes) - sizes), sizes)
        return self.codes[at], np.repeat(np.arange(len(rows)), sizes)

    def both(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many codes each of the rows a and b share; what takes room are the codes of a by the rows of b."""
        (codes, of), (others, at) = self._spread(a), self._spread(b)
        words, slots = np.unique(codes, return_inverse=True)
        slot = np.full(self.most, -1)
        slot[words] = np.arange(len(words))
        left, right = np.zeros((len(a), len(words)), np.float32), np.zeros((len(b), len(words)), np.float32)
        left[of, slots] = 1
        here = slot[others] >= 0
        right[at[here], slot[others[here]]] = 1
        return (left @ right.T).astype(np.float64)  # counts below 2 ** 24, so exact

    def shares(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """functions.jaccard() of the rows a and b."""
        both = self.both(a, b)
        every = self.sizes[a][:, None] + self.sizes[b][None, :] - both
        return np.divide(both, every, out=np.zeros_like(both), where=every > 0)


def flat(*columns: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Lists of strings after each other: row and code of each string, the column it is of, and the distinct strings; null is an empty list."""
    whole = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in columns]
    found = pa.concat_arrays([x.flatten() for x in whole]).dictionary_encode()
    counts = [x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in whole]
    rows, column = np.repeat(np.arange(sum(map(len, counts))), np.concatenate(counts)), np.repeat(np.arange(len(counts)), [int(c.sum()) for c in counts])
    return rows, found.indices.to_numpy(zero_copy_only=False), column, found.dictionary


def strict_log(x: np.ndarray) -> np.ndarray:
    """The logarithm of positive normal doubles, bit for bit that of the JVM's StrictMath, which is fdlibm's; numpy's may differ in the last bit."""
    bits = x.view(np.int64)
    high = (bits >> 32).astype(np.int64)
    k = (high >> 20) - 1023
    high = high & 0xFFFFF
    i = (high + 0x95F64) & 0x100000
    f = (((high | (i ^ 0x3FF00000)) << 32) | (bits & 0xFFFFFFFF)).view(np.float64) - 1.0
    dk = (k + (i >> 20)).astype(np.float64)
    low, up = dk * 1.90821492927058770002e-10, dk * 6.93147180369123816490e-01
    s = f / (2.0 + f)
    z = s * s
    w = z * z
    r = z * (6.666666666666735130e-01 + w * (2.857142874366239149e-01 + w * (1.818357216161805012e-01 + w * 1.479819860511658591e-01))) + w * (3.999999999940941908e-01 + w * (2.222219843214978396e-01 + w * 1.531383769920937332e-01))
    half = np.where(((high - 0x6147A) | (0x6B851 - high)) > 0, 0.5 * f * f, 0.0)
    wide = half > 0
    # Two forms of the rest, as fdlibm chooses them; with dk = 0 it leaves out what is zero, which changes nothing.
    out = up - (np.where(wide, half - (s * (half + r) + low), s * (f - r) - low) - f)
    rare = np.flatnonzero((0xFFFFF & (2 + high)) < 3)
    if len(rare):
        f, dk, low, up = f[rare], dk[rare], low[rare], up[rare]
        rest = f * f * (0.5 - 0.33333333333333333 * f)
        out[rare] = np.where(f == 0, up + low, np.where(dk == 0, f - rest, up - ((rest - low) - f)))
    return out


def closeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """functions.price_closeness() of pairs of prices, to the last bit; NaN is null."""
    good = (a > 0) & (b > 0)
    ratio = np.divide(a, b, out=np.ones_like(a), where=good)
    log = np.abs(strict_log(ratio))
    edge = np.flatnonzero(np.abs(log - 1.0986122886681098) < 1e-8)
    if len(edge):
        log1p = lambda x: x - x * x * 0.5  # noqa: E731  # fdlibm's, for numbers as small as these
        r = ratio[edge]
        off = np.where(r > 1, (r - 3.0) / 3.0, -(((r - 1 / 3) + -1.850371707708594e-17) * 3.0))
        rest = np.where(r > 1, log1p(off), -log1p(-off))
        log[edge] = np.where(np.abs(off) < 1e-9, 1.0986122886681098 + (-9.07129723500153e-17 + rest), log[edge])
    return np.where(good, np.maximum(0.0, 1.0 - log / 1.0986122886681098), 0.0)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """sources.catalog.rnd()."""
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def greedy(edges: Callable[[np.ndarray, np.ndarray], Edges], left: np.ndarray, right: np.ndarray, most: int = MOST, piece: int = PIECE) -> Edges:
    """The edges taken by (score descending, left place, right place) while both ends are free, as places and scores.

    ``edges`` gives those of some left and right places, as places in these, in order, and positive scores;
    ``left`` and ``right`` name the end at each place, and places of one name are taken together.
    Where there are more than ``most`` edges they are made anew for a range of scores at a time, best
    first, from ends that are still free; equal scores that are too many go by left places.
    """
    open_left, open_right = (bytearray(b"\1") * (int(x.max(initial=0)) + 1) for x in (left, right))
    free_left, free_right = (np.frombuffer(x, bool) for x in (open_left, open_right))
    taken: list[Edges] = []

    def pieces(low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places and scores, as numbers in the order of scores, of edges between free ends in a range."""
        ys, at = np.flatnonzero(free_right[right]), 0
        xs = np.flatnonzero(free_left[left])
        step = max(1, piece // max(1, len(ys)))
        while at < len(xs) and len(ys):
            i, j, score = edges(xs[at : at + step], ys)
            keys = np.ascontiguousarray(score, np.float64).view(np.int64)
            kept = (keys >= low) & (keys <= high)
            yield xs[at : at + step][i[kept]], ys[j[kept]], keys[kept]
            at += step

    def take(i: np.ndarray, j: np.ndarray, keys: np.ndarray) -> None:
        order = np.argsort(-keys, kind="stable")  # edges come by left and right places
        i, j, keys = i[order], j[order], keys[order]
        kept = []
        for k, (x, y) in enumerate(zip(left[i].tolist(), right[j].tolist(), strict=True)):
            if open_left[x] and open_right[y]:
                open_left[x] = open_right[y] = 0
                kept.append(k)
        taken.append((i[kept], j[kept], keys[kept].view(np.float64)))

    def within(low: int, high: int) -> None:
        found: list | None = []
        total, bins = 0, np.zeros(1024, np.int64)
        width = (high - low) // 1024 + 1
        for part in pieces(low, high):
            total += len(part[0])
            bins += np.bincount((part[2] - low) // width, minlength=1024)
            if found is not None:
                found = [*found, part] if total <= most else None
        if found is not None:
            if found:
                take(*(np.concatenate(x) for x in zip(*found, strict=True)))
        elif low == high:
            for part in pieces(low, high):
                take(*part)
        else:
            # Neighbouring bins that hold no more than there is room for go together; a bin by itself is a narrower range.
            group: list[int] = []
            for k in [*np.flatnonzero(bins)[::-1].tolist(), -1]:
                if group and (k < 0 or bins[group].sum() + bins[k] > most):
                    within(low + group[-1] * width, min(high, low + (group[0] + 1) * width - 1))
                    group = []
                group.append(k)

    within(1, np.array(np.inf).view(np.int64).item() - 1)
    return tuple(np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *taken, strict=True))
