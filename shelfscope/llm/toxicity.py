"""Toxicity of texts whose words may be disguised: restore by a noisy channel, then score.

A disguised word is the output of a channel that writes signs for letters (leetspeak), puts
separators between letters and repeats letters.  Each piece of text that could be such an output
becomes a lattice: a slot per run of equal characters, whose alternatives are the letters it may
stand for, once or twice, with or without the separator behind it, or the characters themselves.
Viterbi decoding (exact; a state is the last two slots' alternatives) takes the path of the
highest probability under channel and character language model, many lattices at a time in numpy.
The restored words, those as they are written, and how many of them begin alike are the features
of a logistic regression.

The language model is a trigram model over 30 classes of characters, counted in all documents.
The regression learns from a bounded sample of labelled rows (about ``per_class`` of each label,
drawn by hash) and keeps the ``width`` features that tell the labels apart best.  Rows whose crc32(id)
mod 5 is 0 are held out.  A score sees the text and nothing else.

Pieces are words, and chains of words each of whose gaps touches a word of one character (also
without the longer words at their ends), so "s t u p i d" and "s tupid" are restored and "stu pid" is not.  Pieces of more than ``LONGEST``
characters are cut in pieces of that length that overlap by half; nothing is left out.

Edge cases: a null or empty text has no words and gets the score of none; null labels and labels
of unknown documents are ignored, an id labelled both ways is toxic; without labels of both kinds
nothing is known to be toxic and all scores are 0; rows that repeat a doc_id are scored each; a
null doc_id is not held out; other columns are ignored, whatever their names; an empty table gives
no rows; memory is that of one block of about 1 MB of text and the pieces seen lately.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_cnn import held_out
from .scratch import materialise
from .textops import slices, tidy

#: Classes of characters: 0 space, 1 to 26 letters without accents, then digits, signs, other letters.
SPACE, DIGIT, SIGN, OTHER, CLASSES = 0, 27, 28, 29, 30
#: What signs may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Log probabilities of the channel: a sign for a letter, one letter written more than once, a separator within a word,
#: and one between words where single characters stand on both sides of it, as they do in spaced words.
SWAP, REPEAT, BREAK, KEPT = -2.5, -3.0, -2.0, -4.0
LONGEST, LETTERS = 64, "abcdefghijklmnopqrstuvwxyz"
_DOUBLE = re.compile(r"([a-z])\1+")
#: What makes a piece ambiguous: a repeat, a sign for a letter, a separator between letters.
_DISGUISED = re.compile(r"([^\W\d_])\1|[" + re.escape("".join(LEET)) + r"]|\w[^\w\s]+(?=\w)|_", re.IGNORECASE)


def _class_table() -> np.ndarray:
    """The class of every code point below 0x20000; those above are signs or other letters alike."""
    table = np.full(0x20000, OTHER, np.uint8)
    for code in range(len(table)):
        c = chr(code)
        if c.isspace():
            table[code] = SPACE
        elif c.isalpha():
            base = unicodedata.normalize("NFKD", c)[0].lower()
            if len(base) == 1 and "a" <= base <= "z":
                table[code] = ord(base) - 96
        else:
            table[code] = DIGIT if c.isdecimal() else SIGN
    return table


_TABLE: list[np.ndarray] = []


def classes(text: str) -> np.ndarray:
    """The class of every character of a text."""
    if not _TABLE:
        _TABLE.append(_class_table())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[0][np.minimum(codes, len(_TABLE[0]) - 1)]


def trigram_codes(text: str) -> np.ndarray:
    """Trigrams as numbers, runs of spaces and of signs taken as one."""
    c = classes(f" {text} ").astype(np.int64)
    c = c[np.concatenate([[True], (c[1:] != c[:-1]) | ((c[1:] != SPACE) & (c[1:] != SIGN))])]
    c = np.concatenate([[SPACE], c])
    return (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities of a class after two others, from the trigrams of all documents.

    Tasks send their own sums, at most CLASSES ** 3 rows each; the driver gets that many in all.
    """

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                joined = " ".join(t for t in part["text"].to_pylist() if t)
                total += np.bincount(trigram_codes(joined), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["code", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES**3)
    for code, n in rows:
        counts[code] = n
    return smoothed(counts)


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Witten-Bell: each order gives a share of its probability to the one below, the more the more kinds it has seen."""
    three = counts.reshape(CLASSES, CLASSES, CLASSES)
    below = np.full(CLASSES, 1 / CLASSES)
    for n in (three.sum(axis=(0, 1)), three.sum(axis=0), three):
        seen, kinds = n.sum(axis=-1, keepdims=True), (n > 0).sum(axis=-1, keepdims=True)
        below = np.where(seen > 0, (n + kinds * below) / np.maximum(seen + kinds, 1), below)
    return np.log(below).astype(np.float32)


class Lattices:
    """Decodes pieces of text; ``model`` holds the log probabilities of language_model()."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = np.ascontiguousarray(model, np.float32).ravel()
        self.signs = {c: 27 + k for k, c in enumerate(LEET)}  # kinds of slots: letters 1 to 26, signs, then digits, signs and letters that stand for themselves
        self.plain = {DIGIT: 27 + len(LEET), SIGN: 28 + len(LEET), OTHER: 29 + len(LEET), SPACE: 28 + len(LEET)}
        kinds = 30 + len(LEET)
        options = [self._options(kind, times, broken) for kind in range(kinds) for times in (1, 2, 3) for broken in (0, 1, 2)]
        # The last rows: the end of a piece, which is followed by a space, and what pads shorter pieces.
        options += [[([SPACE], 0.0)], [([], 0.0)]]
        self.end, self.pad = len(options) - 2, len(options) - 1
        self.many = np.array([len(o) for o in options])
        most = int(self.many.max())
        self.symbols = np.full((len(options), most, 3), -1, np.int64)
        self.cost = np.full((len(options), most), -np.inf, np.float32)
        for k, option in enumerate(options):
            for a, (symbols, cost) in enumerate(option):
                self.symbols[k, a, : len(symbols)] = symbols
                self.cost[k, a] = cost

    def _options(self, kind: int, times: int, broken: int) -> list[tuple[list[int], float]]:
        """What a run of a kind, seen once, twice or more often, may have been, with log probabilities; broken tells the separator behind it (1) and one between single characters (2)."""
        found: list[tuple[list[int], float]] = []
        if kind <= 26:
            found += [([max(kind, 1)], REPEAT if times > 1 else 0.0)] + [([max(kind, 1)] * 2, 0.0)] * (times > 1)
        elif kind < 27 + len(LEET):
            letters = [ord(c) - 96 for c in LEET[list(LEET)[kind - 27]]]
            own = DIGIT if list(LEET)[kind - 27].isdecimal() else SIGN
            found += [([x], SWAP + (REPEAT if times > 1 else 0.0)) for x in letters] + [([own] * (min(times, 2) if own == DIGIT else 1), 0.0)]
            if times > 1:
                found += [([x, y], 2 * SWAP) for x in letters for y in letters]
        else:
            found += [([{27: DIGIT, 28: SIGN, 29: OTHER}[kind - len(LEET)]], 0.0)]
        if not broken:
            return found
        keep, drop = (0.0, BREAK) if broken == 1 else (KEPT, 0.0)
        return [(s + [SPACE], c + keep) for s, c in found] + [(s, c + drop) for s, c in found]

    def _slots(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The kinds of slots of all pieces, one after the other, and how many each piece has."""
        text = "\n".join(pieces) + "\n"
        cls = classes(text)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = cls.astype(np.int64)
        for c, k in self.plain.items():
            kind[cls == c] = k
        for c, k in self.signs.items():
            kind[codes == ord(c)] = k
        line = codes == 10
        # A separator stands behind a letter or a sign for one, and before another; others stand for themselves.
        solid = (kind < 27 + len(LEET)) & ~line
        place = np.arange(len(kind))
        ahead = np.minimum.accumulate(np.where(solid | line, place, len(kind))[::-1])[::-1]
        behind = np.maximum.accumulate(np.where(solid | line, place, -1))
        gap = ~solid & ~line & (behind >= 0) & solid[np.maximum(behind, 0)] & solid[np.minimum(ahead, len(kind) - 1)] & (cls != OTHER)
        start = np.concatenate([[True], (kind[1:] != kind[:-1]) | line[:-1] | line[1:]]) & ~gap
        # A run ends where another slot, a gap or a line begins.
        at = np.flatnonzero(start | gap | line)
        ends = np.append(at[1:], len(kind))
        heads = start[at] & ~line[at]
        wide = ends - at
        alone = heads & (wide == 1) & np.append(True, ~heads[:-1]) & np.append(~heads[1:], True)
        broken = np.append(gap[at][1:], False) & heads
        broken = broken.astype(np.int64) + (broken & alone & np.append(alone[2:], [False, False])[: len(at)])
        row = kind[at] * 9 + (np.minimum(wide, 3) - 1) * 3 + broken
        owner = np.cumsum(line[at]) - line[at]
        return row[heads], np.bincount(owner[heads], minlength=len(pieces))[: len(pieces)]

    def restore(self, pieces: list[str]) -> list[str]:
        """The most probable letters of each piece (lower case, no accents); signs become spaces."""
        pieces = [p.replace("\n", " ") for p in pieces]
        slots, counts = self._slots(pieces)
        first = np.cumsum(counts) - counts
        out = [""] * len(pieces)
        options = self.many[slots] if len(slots) else np.zeros(0, int)
        widest = np.zeros(len(pieces), int)
        np.maximum.at(widest, np.repeat(np.arange(len(pieces)), counts), options)
        steps = 2 ** np.ceil(np.log2(np.maximum(counts + 1, 4))).astype(int)
        group = steps * 4 + np.searchsorted([2, 4, 6], widest)
        for g in np.unique(group).tolist():
            members = np.flatnonzero((group == g) & (counts > 0))
            for i in range(0, len(members), 2048):
                some = members[i : i + 2048]
                long = int(counts[some].max()) + 1
                place = np.arange(long)
                inside = place[None, :] < counts[some, None]
                rows = np.where(inside, slots[np.minimum(first[some, None] + place, len(slots) - 1)], np.where(place[None, :] == counts[some, None], self.end, self.pad))
                for k, text in zip(some.tolist(), self._decode(rows, int(widest[some].max())), strict=True):
                    out[k] = text
        return out

    def _decode(self, rows: np.ndarray, most: int) -> list[str]:
        """Viterbi over lattices of equal length; rows[n, t] is the kind of slot, with at most ``most`` alternatives."""
        n, long = rows.shape
        every, c = np.arange(n), CLASSES
        value = np.zeros((n, 1, 1), np.float32)
        # The two symbols before: a path has begun after two spaces.
        two, one = np.zeros((n, 1, 1), np.int64), np.zeros((n, 1), np.int64)
        back: list[np.ndarray] = []
        for t in range(long):
            symbols, cost = self.symbols[rows[:, t], :most], self.cost[rows[:, t], :most]
            s1, s2, s3 = (np.maximum(symbols[:, :, k], 0) for k in range(3))
            there = symbols >= 0
            enter = self.model[((two[:, :, :, None] * c + one[:, None, :, None]) * c + s1[:, None, None, :])]
            total = value[:, :, :, None] + np.where(there[:, None, None, :, 0], enter, 0)
            back.append(total.argmax(axis=1).astype(np.int8))
            best = total.max(axis=1)
            best += np.where(there[:, None, :, 1], self.model[(one[:, :, None] * c + s1[:, None, :]) * c + s2[:, None, :]], 0)
            value = best + (cost + np.where(there[:, :, 2], self.model[(s1 * c + s2) * c + s3], 0))[:, None, :]
            size = there.sum(axis=2)
            last = np.where(size == 3, s3, np.where(size == 2, s2, s1))
            earlier = np.where(size == 3, s2, s1)
            two = np.where((size >= 2)[:, None, :], earlier[:, None, :], one[:, :, None])
            # Padding emits nothing; what it follows no longer matters.
            one = last
        shape = value.shape
        end = value.reshape(n, -1).argmax(axis=1)
        before, here = np.unravel_index(end, shape[1:])
        taken = np.zeros((n, long), np.int64)
        for t in range(long - 1, -1, -1):
            taken[:, t] = here
            here, before = before, back[t][every, before, here]
        symbols = self.symbols[rows[:, :-1], taken[:, :-1]].reshape(n, -1)
        letters = np.where(symbols < 0, 0, np.where((symbols >= 1) & (symbols <= 26), symbols + 96, 32)).astype(np.uint8)
        flat = np.hstack([letters, np.full((n, 1), 10, np.uint8)]).ravel()
        return [x.strip() for x in flat[flat > 0].tobytes().decode("ascii").split("\n")[:n]]


#: Lengths of beginnings of words, and numbers of different words with the same beginning that count as features.
STEMS, MANY = (4, 5, 6, 7), (1, 2, 3, 5, 8)


def features(words: Iterable[str]) -> set[str]:
    """The words, and ``stem-n`` where n or more of them begin with the stem."""
    found = set(words)
    stems = Counter(w[:k] for w in found for k in STEMS if len(w) > k)
    return found | {f"{stem}-{n}" for stem, times in stems.items() for n in MANY if n <= times}


def _cut(piece: str) -> list[str]:
    return [piece] if len(piece) <= LONGEST else [piece[k : k + LONGEST] for k in range(0, len(piece) - LONGEST // 2, LONGEST // 2)]


def chains(words: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of words that a spaced word may fill: every gap in them touches a letter, digit or sign for a letter that stands alone."""
    start = end = -2
    for i in [i for i, w in enumerate(words) if len(w) == 1 and (w.isalnum() or w in "@$!")]:
        if i > end:
            if end >= 0:
                yield start, end
            start = max(i - 1, 0)
        end = min(i + 2, len(words))
    if end >= 0:
        yield start, end


class Reader:
    """The words of texts as written and as restored, with runs of a letter taken as one; keeps the pieces seen lately.

    ``only`` names the features wanted; without it all words are.
    """

    def __init__(self, model: np.ndarray, only: Iterable[str] | None = None, keep: int = 300_000) -> None:
        self.lattices, self.keep, self.only = Lattices(model), keep, None if only is None else frozenset(only)
        self.stems = frozenset(f"{f.partition('-')[0]}-1" for f in self.only or () if "-" in f)
        self.seen: set[str] = set()
        self.keys: dict[str, tuple[str, ...]] = {}  # of the pieces seen that have any

    def _wanted(self, word: str) -> bool:
        return self.only is None or word in self.only or any(f"{word[:k]}-1" in self.stems for k in STEMS if len(word) > k)

    @staticmethod
    def _folded(pieces: list[str]) -> list[str]:
        """Letters in lower case without accents, runs of one as one, a space for all else; pieces hold no line ends."""
        if not pieces:
            return []
        text = "\n".join(pieces)
        c = classes(text)
        letters = np.where((c >= 1) & (c <= 26), c + 96, 32).astype(np.uint8)
        letters[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10] = 10
        return _DOUBLE.sub(r"\1", letters.tobytes().decode("ascii")).split("\n")

    def pieces(self, text: str) -> set[str]:
        words = text.split()
        found = set(words)
        for a, b in chains(words):
            own = [w for w in words[a:b] if len(w) <= LONGEST // 2]
            found.add(" ".join(own))
            single = [k for k, w in enumerate(own) if len(w) == 1]
            if len(single) > 3:  # a spaced word alone, and without a word of one letter before or after it
                spaced = own[single[0] : single[-1] + 1]
                found.update((" ".join(spaced), " ".join(spaced[1:]), " ".join(spaced[:-1])))
        return found

    def read(self, texts: Iterable[str | None]) -> list[set[str]]:
        """The keys of each text."""
        sets = [self.pieces(t) if t else set() for t in texts]
        new = set().union(*sets) - self.seen if sets else set()
        if len(self.seen) + len(new) > self.keep:
            self.seen, self.keys = set(), {}
            new = set().union(*sets)
        parts = [(p, part) for p in new for part in _cut(p)]
        unsure = [(p, part) for p, part in parts if " " in part or _DISGUISED.search(part)]
        restored = self.lattices.restore([x for _, x in unsure])
        found: dict[str, list[str]] = {}
        for of, lines in ((parts, self._folded([x for _, x in parts])), (unsure, self._folded(restored))):
            for (p, _), line in zip(of, lines, strict=True):
                words = [w for w in line.split() if self._wanted(w)]
                if words:
                    found.setdefault(p, []).extend(words)
        self.seen |= new
        self.keys.update((p, tuple(dict.fromkeys(keys))) for p, keys in found.items())
        return [{k for p in s & self.keys.keys() for k in self.keys[p]} for s in sets]


class ToxicWords:
    """Logistic regression on features of restored texts."""

    def __init__(self, language: np.ndarray, weights: dict[str, float], bias: float) -> None:
        self.language, self.weights, self.bias = language, weights, bias

    def scores(self, reader: Reader, texts: list[str | None]) -> np.ndarray:
        z = np.array([self.bias + sum(self.weights[k] for k in sorted(features(keys) & self.weights.keys())) for keys in reader.read(texts)], float)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: np.ndarray, y: np.ndarray, penalty: float = 0.3) -> np.ndarray:
    """Weights (the last one is the bias) by Newton's method, both labels weighing the same."""
    x = np.hstack([rows.astype(float), np.ones((len(rows), 1))])
    own = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (own * (p - y)) + ridge * w
        curve = (x * (own * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 2500, width: int = 400, least: int = 3) -> ToxicWords | None:
    """Fit on about ``per_class`` labelled rows of each kind; None without both kinds."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    sizes = dict(known.groupBy("y").agg(F.count("*").alias("n")).collect())
    if len(sizes) < 2:
        return None
    parts = F.when(F.col("y") == 1, max(1, sizes[1] // per_class)).otherwise(max(1, sizes[0] // per_class))
    some = known.where(F.pmod(F.xxhash64("id"), parts) == 0)
    language = language_model(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(language)

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                keys = [sorted(features(k)) for k in reader.read(part["text"].to_pylist())]
                yield pa.RecordBatch.from_arrays([part["id"].combine_chunks().cast(pa.int64()), part["y"].combine_chunks().cast(pa.int32()), pa.array(keys, pa.list_(pa.string()))], ["id", "y", "keys"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # About 2 * per_class pairs of numbers are broadcast.
    sample = materialise(texts.join(F.broadcast(some), "id").mapInArrow(read, "id long, y int, keys array<string>"), "toxic-sample")
    total = dict(sample.groupBy("y").agg(F.count("*").alias("n")).collect())
    if len(total) < 2:
        return None
    # Features by the likelihood ratio of their shares among toxic and other rows.
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    mean = (a + b) / float(total[0] + total[1])
    gain = F.when(a > 0, a * F.log(a / (mean * total[1]))).otherwise(0) + F.when(b > 0, b * F.log(b / (mean * total[0]))).otherwise(0)
    words = sample.select("y", F.explode("keys").alias("key")).groupBy("key").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where(F.col("a") + F.col("b") >= least)
    best = [r["key"] for r in words.orderBy(gain.desc(), "key").limit(width).select("key").collect()]
    kept = sample.select("id", "y", F.array_intersect("keys", F.array(*map(F.lit, best))).alias("keys")) if best else sample.select("id", "y", F.array().cast("array<string>").alias("keys"))
    rows = sorted((r["id"], r["y"], sorted(r["keys"])) for r in kept.collect())
    place = {k: i for i, k in enumerate(best)}
    x = np.zeros((len(rows), len(best)))
    for i, (_, _, keys) in enumerate(rows):
        x[i, [place[k] for k in keys]] = 1
    w = fit(x, np.array([y for _, y, _ in rows]))
    return ToxicWords(language, dict(zip(best, w[:-1].tolist(), strict=True)), float(w[-1]))


def score_toxicity(docs: DataFrame, model: ToxicWords | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of whole texts: doc_id, score."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return source.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred features and CLASSES ** 3 numbers

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value.language, shared.value.weights)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks().cast(pa.int64()), pa.array(shared.value.scores(reader, part["text"].to_pylist()))], ["doc_id", "score"])

    return source.mapInArrow(score, "doc_id long, score double")


def restore_texts(docs: DataFrame, language: np.ndarray, text_col: str = "text", out_col: str = "restored") -> DataFrame:
    """All rows with their restored text: lower case, no accents, words parted by one space; null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(language)

    @F.pandas_udf("string")
    def restored(texts):  # noqa: ANN001, ANN202
        lattices = Lattices(shared.value)

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            words, pieces, done = text.split(), [], 0
            for a, b in chains(words):
                pieces += words[done:a]
                pieces.append(" ".join(words[max(a, done) : b]))
                done = b
            pieces += words[done:]
            # Longer pieces are restored block by block here, as their letters must not come twice.
            blocks = [p[k : k + LONGEST] for p in pieces for k in range(0, max(len(p), 1), LONGEST)]
            return " ".join(" ".join(lattices.restore(blocks)).split())

        return texts.map(one, na_action="ignore")

    return docs.withColumn(out_col, restored(F.col(text_col)))
