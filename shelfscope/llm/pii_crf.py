"""Personal data by exact patterns and a linear-chain conditional random field.

The patterns find e-mail addresses, IP addresses, payment card numbers and phone numbers that are
written as the book has it.  The CRF adds what is written otherwise (card numbers that fail the
check digit, phone numbers without country code, spelt-out addresses).  Its features are the
shapes of a word and of two neighbours on each side; it is trained on a small labelled table, made
here, by maximum likelihood, and decoded by Viterbi over numpy batches of sequences.

A sequence is a line; the lines of a text are all of it, so every word of every text is decoded.
Shapes and features are numbers that come from the text's code points by array operations.

Edge cases: a null or empty text has no spans; offsets count code points; spans that the CRF adds
never overlap one of the patterns, nor cross a line's end; lines of any length are decoded without
padding; a number of any length is no error; rows that repeat a doc_id are
handled each, a null doc_id stays null; other columns are ignored by find_pii and kept by redact;
an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import slices, tidy

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Words that are shapes of their own.
_LEXICON = "at dot com org net version v phone tel call fax card ip host mail page".split()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octet(digits: str) -> bool:
    """At most 255; the number may have any length, as leading zeros count for nothing."""
    value = digits.lstrip("0")
    return len(value) < 4 and int(value or "0") <= 255


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """The pattern matches, per kind leftmost and non-overlapping; linear in the text's length."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, m.end(), "email"))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(_octet(p) for p in m.groups())]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


# Sequences and features.

_SPACE, _LETTER, _NUMBER, _SIGN = range(4)
#: Shapes before and after a sequence; digits are 1 to 20, words 30 to 38 and from 50, signs from 100.
_BEFORE, _AFTER = (250, 251), (252, 253)


@functools.lru_cache(maxsize=1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kind of each code point of the basic plane (others are signs), and whether it is upper case."""
    points = [chr(c) for c in range(1 << 16)]
    kinds = [_SPACE if c.isspace() else _LETTER if c.isalpha() else _NUMBER if c in "0123456789" else _SIGN for c in points]
    return np.array(kinds, np.uint8), np.array([c.isupper() for c in points])


@functools.lru_cache(maxsize=1)
def _words() -> tuple[np.ndarray, np.ndarray]:
    """The lexicon as sorted numbers (8 bits a letter), and the shape of each."""
    codes = np.array([sum(ord(c) << 8 * k for k, c in enumerate(w)) for w in _LEXICON], np.uint64)
    order = np.argsort(codes)
    return codes[order], 50 + order


class Tokens:
    """The tokens of a text: start, end, shape, line (number of its line) and gap (white space before it)."""

    __slots__ = ("end", "gap", "line", "shape", "start")

    def __init__(self, text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        table, capitals = _kinds()
        low = np.minimum(points, 0xFFFF)
        kind = np.where(points > 0xFFFF, _SIGN, table[low])
        new = np.ones(len(kind), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _SIGN)
        first = np.flatnonzero(new)
        ends = np.append(first[1:], len(kind))
        some = kind[first] != _SPACE
        self.start, self.end = first[some], ends[some]
        kind, size = kind[self.start], self.end - self.start
        shape = np.where(kind == _NUMBER, np.minimum(size, 20), 0)
        upper = np.concatenate([[0], np.cumsum(capitals[low])])
        big = upper[self.end] - upper[self.start]
        cased = np.where(big == size, 0, np.where(capitals[low[self.start]], 1, 2))
        shape = np.where(kind == _LETTER, 30 + 3 * cased + np.where(size == 1, 0, np.where(size < 4, 1, 2)), shape)
        shape = np.where(kind == _SIGN, 100 + np.minimum(points[self.start], 128), shape)
        short = np.flatnonzero((kind == _LETTER) & (size <= 7))
        code = np.zeros(len(short), np.uint64)
        for k in range(7):
            at = self.start[short] + k
            letter = low[np.minimum(at, len(low) - 1)].astype(np.uint64) | np.uint64(0x20)
            code |= np.where(at < self.end[short], letter, np.uint64(0)) << np.uint64(8 * k)
        plain = np.concatenate([[0], np.cumsum(points > 127)])
        names, shapes = _words()
        place = np.minimum(np.searchsorted(names, code), len(names) - 1)
        known = (names[place] == code) & (plain[self.end[short]] == plain[self.start[short]])
        shape[short[known]] = shapes[place[known]]
        self.shape = shape.astype(np.int64)
        self.gap = np.ones(len(size), bool)
        self.gap[1:] = self.start[1:] > self.end[:-1]
        self.line = np.cumsum(points == 10)[self.start]


def features(tokens: Tokens, at: int = 0, to: int | None = None) -> np.ndarray:
    """Seven feature numbers of each token (of those from ``at`` to ``to``): its shape, those of its neighbours, and whether blanks part them."""
    # Two more on each side tell all that the features of a token depend on.
    whole = len(tokens.shape)
    begin, stop = max(0, at - 2), min(whole, (whole if to is None else to) + 2)
    shape, gaps, line = tokens.shape[begin:stop], tokens.gap[begin:stop], tokens.line[begin:stop]
    n = len(shape)
    same = [np.zeros(n, bool) for _ in range(5)]  # whether the token two or one before, itself, one or two after is of the same line
    for k in range(-2, 3):
        here = np.arange(max(0, -k), min(n, n - k))
        same[k + 2][here] = line[here] == line[here + k]

    def near(k: int) -> np.ndarray:
        there = shape[np.clip(np.arange(n) + k, 0, max(n - 1, 0))]
        side = _BEFORE[::-1] if k < 0 else _AFTER
        inner = same[2 + k // abs(k)]
        return np.where(same[k + 2], there, np.where(inner, side[0], side[abs(k) - 1]))

    def gap(k: int) -> np.ndarray:
        """Whether white space, or the line's end, stands before the token k places on."""
        inside = same[k + 2] & same[k + 1] if k <= 0 else same[k + 2]
        return np.where(inside, gaps[np.clip(np.arange(n) + k, 0, max(n - 1, 0))], True).astype(np.int64)

    c, p, q, nx, nn = shape, near(-1), near(-2), near(1), near(2)
    g, gp, h, hn = gap(0), gap(-1), gap(1), gap(2)
    parts = [(c,), (p, g), (h, nx), (q, gp, p, g, c), (c, h, nx, hn, nn), (p, g, c), (c, h, nx)]
    out = np.empty((n, 7), np.int64)
    for k, values in enumerate(parts):
        code = np.full(n, k + 1, np.int64)
        for v in values:
            code = (code << 8) | v
        out[:, k] = code
    return out[at - begin : (whole if to is None else min(to, whole)) - begin]


# The labelled table.


def labelled_table(rows: int = 400, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Small made texts with their personal data marked: (text, spans)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 9)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    host = lambda: f"{rng.choice(['mail', 'post', 'web', word()])}{rng.choice(['', digits(1)])}.{word()}.{rng.choice(['com', 'org', 'net', 'de'])}"
    octets = lambda: [str(rng.randint(0, 255)) for _ in range(4)]
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    makers = {
        "email": [lambda: f"{word()}.{digits(2)}@{host()}", lambda: f"{word()}@{host()}", lambda: f"{word()} at {word()} dot {rng.choice(['com', 'org', 'net'])}", lambda: f"{word()} (at) {word()} (dot) {rng.choice(['com', 'org', 'net'])}", lambda: f"{word()}{rng.choice([' [at] ', '[at]', ' (at) ', '(at)'])}{word()}.{rng.choice(['com', 'org', 'net', 'de'])}"],
        "ip": [lambda: ".".join(octets())],
        "card": [lambda: digits(16), lambda: " ".join(digits(4) for _ in range(4)), lambda: "-".join(digits(4) for _ in range(4)), lambda: digits(15), lambda: digits(13)],
        "phone": [lambda: f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"+{digits(2)} {digits(3)} {digits(7)}"],
    }
    plain = [lambda: f"version {digits(1)}.{digits(1)}", lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"20{digits(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", lambda: f"$ {digits(2)}.{digits(2)}", lambda: digits(rng.randint(1, 8)), lambda: f'token = "{hexes(20)}"', lambda: hexes(rng.randint(12, 24)), lambda: f"{digits(1)}. {word()}", lambda: f"CC BY {digits(1)}.{digits(1)}.", lambda: f"at {word()} {digits(2)}:{digits(2)}", lambda: f"page {digits(3)}", lambda: f"{digits(3)}-{digits(2)}", lambda: f"{digits(1)},{digits(3)},{digits(3)}", lambda: f"{word()} at {word()}", lambda: f"{digits(4)} {digits(4)}", lambda: f"0x{hexes(8)}", lambda: f"{digits(24)}"]
    ends = ["", "", "", ".", ",", "!!", "***", "%%%", "###", "&&&", "$$$", ";", ")"]
    table = []
    for _ in range(rows):
        text, spans = " ".join(word() for _ in range(rng.randint(0, 4))), []
        for _ in range(rng.randint(1, 2)):
            kind = rng.choice([*KINDS, "", "", "", ""])
            piece = rng.choice(makers[kind] if kind else plain)()
            text += rng.choice(["", " ", " ", " ", "\n"]) if not kind and not text else " " if text else ""
            if kind:
                spans.append((len(text), len(text) + len(piece), kind))
            text += piece + rng.choice(ends) + " " + " ".join(word() for _ in range(rng.randint(1, 5)))
        if rng.random() < 0.15:
            text = text.upper()
        table.append((text, spans))
    return table


# The model.


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Crf:
    """Weights of features (names: their numbers, sorted) and of label pairs; forbidden pairs (I after another kind) have minus infinity."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, pairs: np.ndarray) -> None:
        self.names, self.weights, self.pairs = names, np.vstack([weights, np.zeros(len(LABELS))]).astype(np.float32), pairs.astype(np.float32)

    @staticmethod
    def allowed() -> np.ndarray:
        """[from, to]; the last row stands for the start."""
        ok = np.ones((len(LABELS) + 1, len(LABELS)), bool)
        for b, label in enumerate(LABELS):
            if label[0] == "I":
                ok[:, b] = [a < len(LABELS) and LABELS[a][2:] == label[2:] for a in range(len(LABELS) + 1)]
        return ok

    def emissions(self, found: np.ndarray) -> np.ndarray:
        out = np.zeros((len(found), len(LABELS)), np.float32)
        for k in range(found.shape[1]):
            place = np.minimum(np.searchsorted(self.names, found[:, k]), len(self.names) - 1)
            out += self.weights[np.where(self.names[place] == found[:, k], place, len(self.names))]
        return out

    def decode(self, scores: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Labels by Viterbi; sequence k is scores[cuts[k]:cuts[k + 1]].

        All sequences advance together, the longest first, so those that go on at a step are the
        first ones and nothing is padded; memory is that of the scores.
        """
        out, lengths = np.zeros(len(scores), np.int8), np.diff(cuts)
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        if not len(order):
            return out
        start, own = cuts[order], lengths[order]
        live = np.searchsorted(-own, -np.arange(int(own[0])), "left").tolist()  # how many are longer than t
        back = np.zeros((len(scores), len(LABELS)), np.int8)
        score, from_ = scores[start] + self.pairs[-1], self.pairs[:-1].T[None]
        every, rows = np.arange(len(LABELS))[None], np.arange(len(order))[:, None]
        for t, n in enumerate(live[1:], 1):
            at = start[:n] + t
            step = score[:n, None, :] + from_
            best = step.argmax(axis=2)
            back[at] = best
            score[:n] = step[rows[:n], every, best] + scores[at]
        label = score.argmax(axis=1)
        for t in range(len(live) - 1, -1, -1):
            n = live[t]
            at = start[:n] + t
            out[at] = label[:n]
            if t:
                label[:n] = back[at, label[:n]]
        return out


def train(table: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 80, rate: float = 0.3, decay: float = 1e-3) -> Crf:
    """Maximum likelihood by full-batch Adam; forward and backward run over rows of similar length at once."""
    rows = []
    for text, marked in table:
        words = Tokens(text)
        labels = []
        for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True):
            kind = next(((x, k) for x, y, k in marked if x <= a and b <= y), None)
            labels.append(0 if kind is None else LABELS.index(("B-" if kind[0] == a else "I-") + kind[1]))
        found = features(words)
        for line in np.unique(words.line):
            some = np.flatnonzero(words.line == line)
            rows.append((found[some], [labels[k] for k in some]))
    names = np.unique(np.concatenate([r[0].ravel() for r in rows]))
    rows = [(np.searchsorted(names, f), labels) for f, labels in rows]
    n, size = len(rows), len(LABELS)
    rows.sort(key=lambda r: len(r[1]))
    groups = []  # rows of similar length, padded: index, gold, there
    for at in range(0, n, 64):
        some = rows[at : at + 64]
        length = len(some[-1][1])
        index = np.full((len(some), length, 7), len(names), np.int64)
        gold, there = np.zeros((len(some), length), np.int64), np.zeros((len(some), length), bool)
        for k, (f, labels) in enumerate(some):
            index[k, : len(f)], gold[k, : len(f)], there[k, : len(f)] = f, labels, True
        groups.append((index, gold, there))
    allowed = Crf.allowed()
    weights, pairs = np.zeros((len(names) + 1, size)), np.zeros((size + 1, size))
    truth_w, truth_p = np.zeros_like(weights), np.zeros_like(pairs)
    for index, gold, there in groups:
        np.add.at(truth_w, (index[there], gold[there][:, None]), 1)
        np.add.at(truth_p, (size, gold[:, 0]), 1)
        both = there[:, 1:]
        np.add.at(truth_p, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(pairs), np.zeros_like(pairs)]
    for step in range(1, rounds + 1):
        p = np.where(allowed, pairs, -1e9)
        grad_w, grad_p = -truth_w, -truth_p
        for index, _, there in groups:
            e = weights[index].sum(axis=2)
            length = e.shape[1]
            forward, backward = np.zeros(e.shape), np.zeros(e.shape)
            forward[:, 0] = e[:, 0] + p[-1]
            for t in range(1, length):
                forward[:, t] = np.where(there[:, t, None], _log_sum(forward[:, t - 1, :, None] + p[:-1], 1) + e[:, t], forward[:, t - 1])
            total = _log_sum(forward[:, -1], 1)
            for t in range(length - 2, -1, -1):
                backward[:, t] = np.where(there[:, t + 1, None], _log_sum(p[:-1] + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2), 0)
            unary = np.exp(forward + backward - total[:, None, None]) * there[:, :, None]
            grad_w += np.stack([np.bincount(index[there].ravel(), np.repeat(unary[there][:, c], 7), len(weights)) for c in range(size)], axis=1)
            grad_p[-1] += unary[:, 0].sum(axis=0)
            pair = np.exp(forward[:, :-1, :, None] + p[:-1] + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
            grad_p[:-1] += (pair * there[:, 1:, None, None]).sum(axis=(0, 1))
        for k, (value, grad) in enumerate(((weights, grad_w / n + decay * weights), (pairs, grad_p / n + decay * pairs))):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * grad
            state[2 * k + 1] = 0.999 * state[2 * k + 1] + 0.001 * grad**2
            value -= rate * (state[2 * k] / (1 - 0.9**step)) / (np.sqrt(state[2 * k + 1] / (1 - 0.999**step)) + 1e-8)
    return Crf(names, weights[:-1], np.where(allowed, pairs, -1e9))


@functools.lru_cache(maxsize=1)
def default_model() -> Crf:
    return train(labelled_table())


def _plausible(kind: str, piece: str) -> bool:
    digits = len(_DIGIT.findall(piece))
    if kind == "email":
        return "@" in piece or bool(re.fullmatch(r"\w[\w.+-]*(?:\s+\W?at\W?\s+[\w-]+(?:\s+\W?dot\W?\s+[\w-]+)+|\s*[\[({<]\s*at\s*[\])}>]\s*[\w-]+(?:(?:\.|\s*[\[({<]\s*dot\s*[\])}>]\s*)[\w-]+)+)", piece, re.IGNORECASE))
    if kind == "ip":
        parts = piece.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and _octet(p) for p in parts)
    return 12 <= digits <= 19 if kind == "card" else 7 <= digits <= 15


def find_in_texts(texts: list[str], model: Crf) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """Per text the pattern spans and all spans, by start and kind."""
    order = {k: n for n, k in enumerate(KINDS)}
    base = [sorted(pattern_spans(t), key=lambda s: (s[0], order[s[2]])) if t else [] for t in texts]
    # All texts as one, parted by line ends, which no sequence crosses.
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    shift = np.cumsum(sizes) - sizes
    words = Tokens("\n".join(texts))
    n = len(words.start)
    opens = np.ones(n, bool)
    opens[1:] = words.line[1:] != words.line[:-1]
    step = 1 << 17
    scores = np.concatenate([model.emissions(features(words, at, at + step)) for at in range(0, n, step)] or [np.zeros((0, len(LABELS)), np.float32)])
    labels = model.decode(scores, np.append(np.flatnonzero(opens), n))
    added: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    marked = np.flatnonzero(labels)
    first = np.array([x[0] == "B" for x in LABELS])[labels[marked]] | np.append(True, np.diff(marked) > 1)[: len(marked)] | opens[marked]
    begin = marked[first]
    last = np.append(marked[np.append(first[1:], True)], 0)[: len(begin)] if len(marked) else begin
    owner = np.searchsorted(shift, words.start[begin], "right") - 1
    for k, a, b, label in zip(owner.tolist(), words.start[begin].tolist(), words.end[last].tolist(), labels[begin].tolist(), strict=True):
        a, b, kind = a - int(shift[k]), b - int(shift[k]), LABELS[label][2:]
        if _plausible(kind, texts[k][a:b]) and not any(x < b and a < y for x, y, _ in base[k]):
            added[k].append((a, b, kind))
    return [(b, sorted(b + x, key=lambda s: (s[0], order[s[2]]))) for b, x in zip(base, added, strict=True)]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Crf | None = None) -> DataFrame:
    """One row per document: doc_id, base and spans, both arrays of (kind, start, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @tidy
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = find_in_texts([t or "" for t in part["text"].to_pylist()], shared.value)
                columns = [pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in row[n]] for row in found], span) for n in (0, 1)]
                yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks().chunk(0) if isinstance(part["doc_id"].combine_chunks(), pa.ChunkedArray) else part["doc_id"].combine_chunks(), *columns], ["doc_id", "base", "spans"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind = "array<struct<kind: string, start: bigint, end: bigint>>"
    return source.mapInArrow(find, f"doc_id long, base {kind}, spans {kind}")


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the pattern spans and all spans as text."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", model: Crf | None = None) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; n_chars, if there, follows the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())

    def clean(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
        if not spans:
            return text
        out, last = [], 0
        for a, b, kind in spans:
            if a >= last:
                out += [text[last:a], f"[{kind.upper()}]"]
            last = max(last, b)
        return "".join(out) + text[last:]

    @tidy
    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part[text_col].to_pylist()
                found = find_in_texts([t or "" for t in texts], shared.value)
                new = [clean(t, s) for t, (_, s) in zip(texts, found, strict=True)]
                part = part.set_column(part.column_names.index(text_col), text_col, pa.array(new, part[text_col].type))
                if "n_chars" in part.column_names:
                    part = part.set_column(part.column_names.index("n_chars"), "n_chars", pa.array([None if t is None else len(t) for t in new], part["n_chars"].type))
                yield from part.to_batches()

    return docs.mapInArrow(replace, docs.schema)
