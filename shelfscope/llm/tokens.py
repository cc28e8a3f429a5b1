"""Token ids of whole batches, equal to those of the ``tokenizers`` library.

A byte-level BPE encodes every pre-token on its own, and texts repeat pre-tokens.  So a batch is
cut into pre-tokens with array operations, each distinct one (by its bytes) is encoded once, and
ids are gathered from there.  Texts whose cutting depends on more than character classes (contractions,
the special token's string) go to the library as they are.
"""

from __future__ import annotations

import functools
import json
import sys
import unicodedata
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import regex

from .textops import span_hashes, utf8_buffer

_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_UNUSUAL = regex.compile(r"'(?:s|t|re|ve|m|ll|d)|<\|endoftext\|>")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 anything else, by code point."""
    out = np.full(sys.maxunicode + 1, 3, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = 1 if kind == "L" else 2
    out[_SPACES] = 0
    return out


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class BatchTokenizer:
    """encode(column) gives (ids, offsets): row k has ids[offsets[k]:offsets[k + 1]]."""

    def __init__(self, path: str, cache: int = 200_000) -> None:
        """cache: how many short pre-tokens are remembered from batch to batch (some 200 bytes each)."""
        import tiktoken

        self.path, self.limit = path, cache
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in word): n for word, n in vocabulary.items() if all(c in letters for c in word) and word != "<|endoftext|>"}
        self.single = tiktoken.Encoding("single", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.classes = _classes()
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte positions at which pre-tokens start."""
        at = np.flatnonzero((data & 0xC0) != 0x80)
        lead = data[at]
        point = lead.astype(np.int64)
        tail = np.concatenate([data, np.zeros(3, np.uint8)])
        for low, high, n, mask in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0x100, 3, 0x07)):
            here = np.flatnonzero((lead >= low) & (lead < high))
            value = lead[here].astype(np.int64) & mask
            for k in range(1, n + 1):
                value = (value << 6) | (tail[at[here] + k] & 0x3F)
            point[here] = value
        kind = self.classes[point]
        head = np.zeros(len(data) + 1, bool)
        head[offsets] = True
        head = head[at]
        start = head.copy()
        start[1:] |= kind[1:] != kind[:-1]
        enters = np.flatnonzero((kind[1:] != 0) & (kind[:-1] == 0) & ~head[1:]) + 1
        start[enters - 1] = True  # the last white space before a word stands alone or, a blank, opens the word
        start[enters[point[enters - 1] == 32]] = False
        return at[start]

    def _distinct(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pre-token a number, equal for equal bytes, and for each number the first pre-token that has it."""
        codes, distinct = pd.factorize(span_hashes(data, starts, ends))
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        # Equal hashes prove nothing: every pre-token's bytes are held against the first one's.
        lengths = ends - starts
        like = first[codes]
        same = lengths == lengths[like]
        shift = np.where(same, starts[like] - starts, 0)
        other = np.flatnonzero(data[np.arange(len(data)) + np.repeat(shift, lengths)] != data)
        odd = np.unique(np.concatenate([np.flatnonzero(~same), np.searchsorted(starts, other, "right") - 1]))
        if len(odd):
            by: dict[bytes, int] = {}
            for k in odd.tolist():
                codes[k] = by.setdefault(data[starts[k] : ends[k]].tobytes(), len(first) + len(by))
            fresh = np.empty(len(by), np.int64)
            fresh[codes[odd[::-1]] - len(first)] = odd[::-1]
            first = np.concatenate([first, fresh])
        return codes, first

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all distinct pre-tokens, and of each pre-token where they start and how many they are."""
        codes, first = self._distinct(data, starts, ends)
        raw, encode, known, old = data.tobytes(), self.single._encode_single_piece, self.known, self.old
        found = []
        for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True):
            piece = raw[a:b]
            ids = known.get(piece)
            if ids is None:
                ids = old.get(piece) or array("I", encode(piece)).tobytes()
                if len(piece) <= 32:
                    if 2 * len(known) >= self.limit:  # what was not met since the last turn is forgotten
                        self.known, self.old = known, old = {}, known
                    known[piece] = ids
            found.append(ids)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), np.uint32), (np.cumsum(lengths) - lengths)[codes], lengths[codes]

    def encode(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = utf8_buffer(column)
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        starts = self._pieces(data, offsets)
        ends = np.append(starts[1:], len(data))
        flat, place, lengths = self._learn(data, starts, ends)
        after = np.cumsum(lengths)
        ids = flat[np.repeat(place - after + lengths, lengths) + np.arange(after[-1])]
        bounds = np.concatenate([[0], after])[np.searchsorted(starts, offsets)]
        quotes = np.unique(np.searchsorted(offsets, np.flatnonzero((data == 0x27) | (data == 0x3C)), "right") - 1)
        if len(quotes):
            texts = {int(k): data[offsets[k] : offsets[k + 1]].tobytes().decode() for k in quotes}
            odd = [k for k, t in texts.items() if _UNUSUAL.search(t)]
            if odd:
                parts = [ids[bounds[k] : bounds[k + 1]] for k in range(n)]
                for k in odd:
                    parts[k] = np.array(self.library.encode(texts[k], add_special_tokens=False).ids, np.uint32)
                ids = np.concatenate(parts)
                bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds


_CACHE: dict[str, BatchTokenizer] = {}


def batch_tokenizer(path: str) -> BatchTokenizer:
    """One tokenizer per Python worker."""
    if path not in _CACHE:
        _CACHE[path] = BatchTokenizer(path)
    return _CACHE[path]
