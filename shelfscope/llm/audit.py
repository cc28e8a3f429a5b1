"""What each of five filters removes, in all 120 orders: counts by part, order and step.

Copies are found by fingerprint: rows are routed to partitions by the xxhash of their text, each
partition keeps a chain per fingerprint of the different texts that have it, whole and with the
smallest id met, and of two equal texts the one of the larger id is sent out as a copy.  A task
does the same with its own rows before it sends any, so a text that a third of all rows share
arrives once from each task.  Which filters a row fails is a mask of five bits; ``combineByKey``
adds up a vector of counts by mask for each part, and the 600 rows of a part follow from its vector.

Memory: a task holds the different texts of its own rows, and a partition those routed to it, of
about ``partition_bytes`` each (a task sends what it holds when that is full, a table has as many
partitions as its bytes need).  The driver learns the number of bytes.

Edge cases: a null or empty text has no words and fails A only (and E, if it has a smaller id's
copy); a null source is the part of the empty string; rows that repeat an id count each, equal
rows of one id are no copies of each other; a null id is no copy and has none; labels that are
null, unknown or of unknown documents count as 0, an id labelled twice has a label if one row says
so; very long texts are compared whole; other columns are ignored, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
COPY = 16
_CAPITALS, _SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: str, data: bytes) -> int:
    """The filters A to D that a text fails, as bits; ``data`` is its UTF-8."""
    words = data.split()  # at ASCII white space, as bytes are
    found = 1 if len(words) < 200 else 0
    if 100 * len(set(words)) < 50 * len(words):
        found |= 2
    if 100 * (len(data) - len(data.translate(None, _CAPITALS))) > 2 * len(text):
        found |= 4
    if len(data.translate(None, _SIGNS)) < len(data):
        found |= 8
    return found


class Chains:
    """Per fingerprint the different texts met, each with its smallest id and the rows of that id: (part, mask, number of rows)."""

    def __init__(self) -> None:
        self.chains: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, fingerprint: int, data: bytes, id_: int, rows: list[tuple[str, int, int]]) -> Iterator[tuple[int, str, int, int]]:
        """Keeps the smaller id of a text; yields the rows of the larger one: (id, part, mask, number)."""
        chain = self.chains.setdefault(fingerprint, [])
        for entry in chain:
            if entry[0] == data:
                if id_ == entry[1]:
                    entry[2] = _merged(entry[2], rows)
                    return
                if id_ < entry[1]:
                    id_, entry[1], rows, entry[2] = entry[1], id_, entry[2], rows
                for part, mask, n in rows:
                    yield id_, part, mask | COPY, n
                return
        chain.append([data, id_, rows])
        self.bytes += len(data) + 200

    def drain(self) -> Iterator[tuple[int, bytes, int, list[tuple[str, int, int]]]]:
        while self.chains:
            fingerprint, chain = self.chains.popitem()
            for data, id_, rows in chain:
                yield fingerprint, data, id_, rows
        self.bytes = 0


def _merged(a: list[tuple[str, int, int]], b: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    total: dict[tuple[str, int], int] = {}
    for part, mask, n in (*a, *b):
        total[part, mask] = total.get((part, mask), 0) + n
    return [(part, mask, n) for (part, mask), n in total.items()]


def route(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", fingerprint: Column | None = None, partition_bytes: int = 32 << 20) -> RDD:
    """(id, part, mask, number of equal rows) for all documents; the mask has bit COPY where a smaller id has the same text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("bigint").alias("i"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("p"), text.alias("t"), (F.xxhash64(text) if fingerprint is None else fingerprint.cast("bigint")).alias("f"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    partitions = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // partition_bytes))

    def send(rows: Iterable) -> Iterator[tuple[int, tuple]]:
        held = Chains()
        for at, (id_, part, text, key) in enumerate(rows):
            data = text.encode("utf-8", "surrogatepass")
            mask = failures(text, data)
            if id_ is None:
                yield at, (None, None, [(part, mask, 1)])
                continue
            for other, *row in held.add(key, data, id_, [(part, mask, 1)]):
                yield other, (None, other, [tuple(row)])  # a copy: all is known of it, its id spreads such rows
            if held.bytes > partition_bytes:
                yield from ((k, tuple(rest)) for k, *rest in held.drain())
        yield from ((k, tuple(rest)) for k, *rest in held.drain())

    def meet(sent: Iterable[tuple[int, tuple]]) -> Iterator[tuple[int | None, str, int, int]]:
        held = Chains()
        for key, (data, id_, rows) in sent:
            if data is None:
                yield from ((id_, *row) for row in rows)
            else:
                yield from held.add(key, data, id_, rows)
        for _, _, id_, rows in held.drain():
            yield from ((id_, *row) for row in rows)

    return source.rdd.mapPartitions(send).partitionBy(partitions, lambda key: key).mapPartitions(meet)


def copies(docs: DataFrame, **columns: str) -> DataFrame:
    """The ids (doc_id) of documents that are copies of one with a smaller id, with the number of their equal rows (n)."""
    found = route(docs, **columns).filter(lambda row: row[2] & COPY).map(lambda row: (row[0], row[3]))
    return docs.sparkSession.createDataFrame(found, "doc_id long, n long", verifySchema=False)


def _step_rows(part: str, counts: list[int]) -> Iterator[tuple]:
    """All rows of a part; counts holds 32 numbers of documents by mask, 32 of good and 32 of toxic ones."""
    fails = [[m for m in range(32) if m >> f & 1] for f in range(5)]
    rows, shapley = [], [0] * 5
    for order in permutations(range(5)):
        before, left = 0, sum(counts[:32])
        for step, f in enumerate(order, 1):
            hit = [m for m in fails[f] if not m & before]
            removed = sum(counts[m] for m in hit)
            redundant = sum(counts[m] for m in fails[f]) - removed
            left -= removed
            shapley[f] += removed
            rows.append((order, step, f, left, removed, redundant, counts[1 << f], sum(counts[32 + m] for m in hit), sum(counts[64 + m] for m in hit)))
            before |= 1 << f
    for order, step, f, *rest in rows:
        yield (part, "".join(FILTERS[k] for k in order), step, *rest, shapley[f])


def interactions(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row per part, order of the filters and step, as in SCHEMA."""
    spark = docs.sparkSession
    each = spark.createDataFrame(route(docs, **columns), "id long, part string, mask int, n long", verifySchema=False)
    marked = labels.groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = each.join(marked, "id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))

    def added(counts: list[int], row: tuple[int, int, int, int]) -> list[int]:
        mask, n, good, toxic = row
        counts[mask] += n
        counts[32 + mask] += n * good
        counts[64 + mask] += n * toxic
        return counts

    vectors = known.rdd.map(lambda r: (r[0], tuple(r)[1:])).combineByKey(lambda row: added([0] * 96, row), added, lambda a, b: [x + y for x, y in zip(a, b, strict=True)])
    return spark.createDataFrame(vectors.flatMap(lambda kv: _step_rows(*kv)), SCHEMA, verifySchema=False)
