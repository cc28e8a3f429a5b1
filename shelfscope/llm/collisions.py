"""Near-duplicate vectors by collision-counting projections.

Every vector is projected on many random lines.  On each line the values are sorted, and a window
of fixed half-width around a query's value holds the vectors that collide with it there.  Pairs
that collide on enough lines are verified by their exact cosine.  Unit vectors at cosine ``c`` are
sqrt(2 - 2c) apart and differ on a line by a normal variate of that deviation, so the collisions
of a pair are binomial with a known probability; the count asked for is the largest one that a
pair right at the threshold reaches with the chosen recall.

Windows on single lines let through a fixed share of all pairs (a third, at the default width), so
counting them against every other vector would take quadratic time.  Sorting therefore starts
coarsely: on ``bits`` further lines the order is cut at 0, the halves name a cell, vectors meet
within cells, and this is repeated for several tables of such lines, as many as the recall at the
threshold needs.  The lines that are counted on are others than those that cut cells, so that
counts do not depend on the cell.  A pair that meets in several tables counts in the first one
only.  Cells of more than ``block`` vectors are compared in pairs of blocks.  Vectors travel in
their own type (floats as floats); tasks return counts and a spanning forest of their links, never
pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing (n_links 0, own component); components of any finite size are scaled before squares are
taken; exact copies collapse before anything is compared and link
with each other; vectors of another length than most are compared with their own length only;
rows that repeat a vec_id with the same vector are one vector; a row with a null id has null
component and counts for nothing; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .graph import connected_components
from .scratch import materialise
from .textops import sorted_groups, tidy
from .vectors import distinct_vectors, matrix, unit_rows, usable, vector_hashes


def collision_probability(cosine: float, half: float) -> float:
    """That two unit vectors of this cosine lie within ``half`` on a random line."""
    return math.erf(half / math.sqrt(2 - 2 * cosine) / math.sqrt(2)) if cosine < 1 else 1.0


def calibrated_count(cosine: float, half: float, lines: int, recall: float) -> int:
    """The largest count that a pair of this cosine reaches with probability ``recall``."""
    p, tail = collision_probability(cosine, half), 0.0
    for count in range(lines, -1, -1):
        tail += math.comb(lines, count) * p**count * (1 - p) ** (lines - count)
        if tail >= recall:
            return count
    return 0


def tables_needed(cosine: float, bits: int, recall: float) -> int:
    """Tables until a pair of this cosine has met in a cell with probability ``recall``."""
    cell = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - cell))) if cell < 1 else 1


def _lines(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def count_collisions(queries: np.ndarray, others: np.ndarray, half: float) -> np.ndarray:
    """For every query and other vector, on how many lines the other lies in the query's window."""
    counts = np.zeros((len(queries), len(others)), np.int16)
    at = np.arange(len(queries))
    for q, o in zip(queries.T, others.T, strict=True):
        order = np.argsort(o)
        line = o[order]
        edges = np.zeros((len(queries), len(others) + 1), np.int8)
        edges[at, np.searchsorted(line, q - half, "left")] += 1
        edges[at, np.searchsorted(line, q + half, "right")] -= 1
        counts[:, order] += np.cumsum(edges[:, :-1], axis=1, dtype=np.int8)
    return counts


def _cells(unit: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    signs = (unit @ _lines(unit.shape[1], bits * tables, seed) > 0).reshape(len(unit), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index linked to each of n points through the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def linked_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, recall: float = 0.997, lines: int = 32, half: float = 0.6, cell: int = 256, block: int = 1024, seed: int = 1) -> DataFrame:
    """Links between all vectors of cosine >= threshold: one row (vec_id, n_links, component_id, kept) per vector."""
    spark = vectors.sparkSession
    points = materialise(distinct_vectors(vectors, id_col, vec_col, 1).select("id", "copies", "vector"), "points")
    n = points.count()
    bits = max(1, math.ceil(math.log2(max(n, 2) / cell)))
    tables = tables_needed(threshold, bits, recall)
    least = calibrated_count(threshold, half, lines, recall)
    single = isinstance(vectors.schema[vec_col].dataType.elementType, FloatType)

    @tidy
    def name_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(pa.compute.list_value_length(batch["vector"]))
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                x = matrix(part["vector"])
                cells = _cells(unit_rows(x), bits, tables, seed) + (np.int64(dim) << 40)
                repeat = np.repeat(np.arange(len(x)), tables)
                raw = pa.array([v.tobytes() for v in (x.astype(np.float32) if single else x)], pa.binary())  # floats lose nothing
                yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(repeat)), part["copies"].take(pa.array(repeat)), raw.take(pa.array(repeat)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(x))), pa.array(cells.ravel())], ["id", "copies", "raw", "table", "cell"])

    placed = points.mapInArrow(name_cells, "id long, copies long, raw binary, table int, cell long")
    sizes = placed.groupBy("table", "cell").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / block).cast("int")
    placed = placed.join(sizes, ["table", "cell"]).withColumn("mine", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least("mine", j).alias("x"), F.greatest("mine", j).alias("y")))
    placed = placed.select("id", "copies", "raw", "table", "cell", "mine", F.explode(pairs).alias("pair")).select("id", "copies", "raw", "table", "mine", F.col("pair.x").alias("x"), F.col("pair.y").alias("y"), F.xxhash64("table", "cell", "pair.x", "pair.y").alias("group"))

    @tidy
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, table), group in sorted_groups(batches, ["group", "table"]):
            ids, copies = np.asarray(group["id"]), np.asarray(group["copies"])
            unit = unit_rows(np.frombuffer(b"".join(group["raw"].to_pylist()), np.float32 if single else float).astype(float).reshape(len(ids), -1))
            mine, x, y = group["mine"][0].as_py(), group["x"][0].as_py(), group["y"][0].as_py()
            own = np.asarray(group["mine"])
            left, right = (np.arange(len(ids)),) * 2 if x == y else (np.flatnonzero(own == x), np.flatnonzero(own == y))
            if not len(left) or not len(right):
                continue
            on = unit @ _lines(unit.shape[1], lines, seed + 1)
            counts = count_collisions(on[left], on[right], half)
            a, b = np.nonzero(counts >= least)
            a, b = left[a], right[b]
            keep = a < b if x == y else slice(None)
            a, b = a[keep], b[keep]
            near = np.concatenate([np.einsum("ij,ij->i", unit[a[i : i + 65536]], unit[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)]) >= threshold
            a, b = a[near], b[near]
            if table and len(a):
                some = np.unique(np.concatenate([a, b]))
                cells = np.zeros((len(ids), table), np.int64)
                cells[some] = _cells(unit[some], bits, tables, seed)[:, :table]
                new = np.concatenate([~(cells[a[i : i + 65536]] == cells[b[i : i + 65536]]).any(axis=1) for i in range(0, len(a), 65536)])
                a, b = a[new], b[new]
            if len(a):
                links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
                order = np.argsort(ids, kind="stable")
                rank = np.empty(len(ids), np.int64)
                rank[order] = np.arange(len(ids))
                root = ids[order][_forest(len(ids), rank[a], rank[b])][rank]
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids[some]), "links": pa.array(links[some].astype(np.int64)), "root": pa.array(root[some])})

    found = placed.repartition("group").sortWithinPartitions("group", "table").mapInArrow(link, "id long, links long, root long")
    found = materialise(found, "found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct())

    facts = points.select("id", "copies", *vector_hashes(F.col("vector")))
    facts = facts.join(links.hint("merge"), "id", "left").join(components.hint("merge"), "id", "left")
    facts = materialise(facts.select("h1", "h2", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id")), "facts")
    vector = F.col(vec_col).cast("array<double>")
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable(vector) & F.col(id_col).isNotNull(), vector).alias("vector"))
    some = out.where("vector is not null").select("vec_id", *vector_hashes(F.col("vector")))
    # Vectors with at least a 4096th of all copies are 4096 at most: they are broadcast, so that no key of the other join is hot.
    all_ = facts.agg(F.sum("copies")).first()[0] or 0
    hot, rest = F.broadcast(facts.where(F.col("copies") * 4096 >= all_).drop("copies")), facts.where(F.col("copies") * 4096 < all_).drop("copies")
    both = some.join(hot, ["h1", "h2"]).unionByName(some.join(hot, ["h1", "h2"], "left_anti").join(rest.hint("merge"), ["h1", "h2"])).select("vec_id", "n_links", "component_id")
    both = both.unionByName(out.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
