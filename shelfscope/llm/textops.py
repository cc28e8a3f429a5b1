"""Vectorised text helpers that run inside Spark tasks.

Everything works on one buffer of UTF-8 bytes holding many texts, so the cost per word is a
few array operations instead of a Python call.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

_ODD = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_ODD, -1, 1 << 64)
#: A prime below 2**31 and the base of the hash modulo it.
_PRIME, _BASE = (1 << 31) - 1, 1_540_483_477
_POWERS: dict[str, np.ndarray] = {}

#: ASCII white space: space and U+0009 to U+000D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _series(base: int, n: int, prime: int | None = None) -> np.ndarray:
    """base ** 0 to n - 1, modulo the prime or 2 ** 64."""
    out = np.ones(n, np.uint64)
    have, step = 1, base
    while have < n:
        more = out[: min(have, n - have)] * np.uint64(step)
        out[have : have + len(more)] = more % np.uint64(prime) if prime else more
        have, step = have * 2, step * step % (prime or 1 << 64)
    return out


def _powers(n: int) -> dict[str, np.ndarray]:
    """Powers for buffers of up to n bytes; those of ordinary buffers stay."""
    size = max(n, 1 << 16)
    if len(_POWERS.get("up", ())) >= n:
        return _POWERS
    found = {"up": _series(_ODD, size), "down": _series(_INVERSE, size), "rise": _series(_BASE, size, _PRIME), "fall": _series(pow(_BASE, -1, _PRIME), size, _PRIME)}
    if size <= 2 << 20:
        _POWERS.update(found)
    return found


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span data[start:end]; equal bytes give equal hashes.

    Two polynomial hashes in one: modulo 2**64, and modulo a prime, since some texts of different
    bytes (Thue-Morse sequences) have equal hashes modulo 2**64 to every base.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers, n = _powers(len(data) + 1), len(data)
    value = data.astype(np.uint64) + np.uint64(1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value * powers["up"][:n], out=sums[1:])
    wide = (sums[ends] - sums[starts]) * powers["down"][starts]
    value *= powers["rise"][:n]
    np.cumsum(value, out=sums[1:]) if n < 1 << 24 else np.cumsum(value % np.uint64(_PRIME), out=sums[1:])
    prime = np.uint64(_PRIME)
    narrow = (sums[ends] - sums[starts]) % prime * powers["fall"][starts] % prime
    return mix64(wide + mix64(narrow))


def utf8_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(table: pa.Table | pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.Table]:
    """Cut a batch so that each part holds about ``limit`` bytes of ``column`` (one row at least)."""
    if isinstance(table, pa.RecordBatch):
        table = pa.Table.from_batches([table])
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(table[column]), 0)).astype(np.int64)
    part = np.concatenate([[0], np.cumsum(sizes)[:-1] // limit]) if len(sizes) else np.zeros(0)
    cuts = [0, *(np.flatnonzero(np.diff(part[: len(sizes)])) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield table.slice(a, b - a)


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same task function; at its end the worker, which Spark keeps for later tasks, gives free memory back."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return run


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every white-space delimited word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~WHITE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(word & (first[:-1] | ~np.concatenate([[False], word[:-1]])))
    ends = np.flatnonzero(word & (first[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def shingle_counts(column: pa.Array | pa.ChunkedArray, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word shingles of every row, as (row, hash, times), by row and hash.

    A row of 1 to ``width - 1`` words has one shingle of all its words; a row without words has
    none.
    """
    data, offsets = utf8_buffer(column)
    starts, ends, row = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(counts) - counts
    total = np.zeros(len(words), np.uint64)
    for k in range(width):
        # A position past the row's last word adds nothing, so short rows hash what they have.
        at = np.arange(len(words)) + k
        there = at < (first + counts)[row]
        total += np.where(there, mix64(words[np.minimum(at, len(words) - 1)] + np.uint64((k + 1) * 0x632BE59BD9B4E019 & _MASK)), np.uint64(0))
    place = np.arange(len(words)) - first[row]
    keep = (place + width <= counts[row]) | ((place == 0) & (counts[row] < width))
    row, total = row[keep], mix64(total[keep])
    order = np.lexsort((total, row))
    row, total = row[order], total[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (total[1:] != total[:-1])]))
    return row[new], total[new], np.diff(np.append(new, len(row)))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The groups of a partition that is sorted by ``keys``; holds one group at a time."""
    held: list[pa.Table] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [np.asarray(table[k].to_numpy(zero_copy_only=False)) for k in keys]
        change = np.zeros(table.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), table.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a].item() if hasattr(c[a], "item") else c[a] for c in columns)
            if key != current and held:
                yield current, pa.concat_tables(held)
                held = []
            current = key
            held.append(table.slice(a, b - a))
    if held:
        yield current, pa.concat_tables(held)
