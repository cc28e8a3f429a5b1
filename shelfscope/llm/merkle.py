"""A manifest of a table: one Merkle tree of the rows of each source, one of the sources over them.

A row's leaf is the SHA-256 of its columns, each preceded by its length.  Leaves of a source are
ordered by id; every ``fan`` neighbours become one node, until one node is left, the subroot of
the source.  Subroots, ordered by source, become the root in the same way.  Every row gets its
path, the digests beside and before its own on each level, so that a holder of one row can fold it
up to the root without any other.

Everything is SQL: leaves gather in ordered arrays of fan ** 2 (their place divided by that is the
key of the group, so no group grows with a source), ``sequence``, ``transform`` and ``slice``
collapse two levels of an array, and what is left of each array is one row of the next round.  A
place within a source is a running count over range partitions: rows are sorted by source and id
over all tasks, tasks count their own, and the sums of the tasks before are added; a source that
holds all rows is spread like any other.  The driver learns one number, the longest source.

Edge cases: a null value hashes as ``-``, an empty text as ``0:``; a null source is a source of
its own before all others, a null id comes first in its source and is never tampered; rows that
repeat an id are ordered by their leaf, and equal rows keep one leaf each, in places next to each
other; a source of one row has its leaf as subroot, and the only subroot is the root; very long
texts are hashed whole; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels that one round collapses: arrays hold fan ** LEVELS digests.
LEVELS = 2
PATH = "array<struct<before: string, after: string>>"


def field(value: Column) -> Column:
    """Length in bytes, colon and value; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def _join(digests: str) -> str:
    return f"array_join({digests}, '')"


def _collapsed(nodes: str, fan: int) -> str:
    """SQL of the next level: the digest of every run of ``fan`` nodes."""
    return f"transform(sequence(0, (size({nodes}) - 1) div {fan}), r -> sha2({_join(f'slice({nodes}, cast(r * {fan} + 1 as int), {fan})')}, 256))"


def _step(nodes: str, i: str, fan: int) -> str:
    """SQL of what stands before and after node i in its run."""
    before = _join(f"slice({nodes}, {i} - {i} % {fan} + 1, {i} % {fan})")
    after = _join(f"slice({nodes}, {i} + 2, {fan - 1} - {i} % {fan})")
    return f"named_struct('before', {before}, 'after', {after})"


def folded(start: Column, path: Column) -> Column:
    """The root to which a digest leads along its path."""
    return F.aggregate(path, start, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def placed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """The rows with ``place`` (0, 1, ... by ``order`` within the group) and ``size`` (rows of the group), written.

    Rows are spread by range over group and order, so neither a group nor a value is one task.
    """
    ranged = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (group, *order)]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in (group, *order)])
    # The number is only meaningful for the order it was drawn in, hence the written table.
    drawn = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.spark_partition_id()), name)
    tasks = drawn.groupBy(group, "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # One row per task and group that it holds: at most tasks + groups rows.
    upto = Window.partitionBy(group).orderBy("_task")
    starts = tasks.select(group, "_task", (F.sum("_n").over(upto) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(group)).alias("size"))
    return drawn.join(starts, [group, "_task"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift")


def _round(nodes: DataFrame, fan: int) -> DataFrame:
    """Arrays of fan ** LEVELS neighbours, collapsed: grp, block, size, levels (yet to do), members, top."""
    wide = fan**LEVELS
    blocks = nodes.groupBy("grp", F.floor(F.col("place") / wide).alias("block")).agg(F.first("size").alias("size"), F.first("levels").alias("levels"), F.array_sort(F.collect_list(F.struct("place", "node", "item"))).alias("members"))
    level = F.expr("transform(members, m -> m.node)")
    blocks = blocks.withColumn("nodes0", level)
    for k in range(LEVELS):
        blocks = blocks.withColumn(f"nodes{k + 1}", F.expr(f"case when levels > {k} then {_collapsed(f'nodes{k}', fan)} else nodes{k} end"))
    return blocks.withColumn("top", F.expr(f"nodes{LEVELS}[0]"))


def _own_path(fan: int) -> str:
    """SQL of the path of member i within its array."""
    steps = [f"case when levels > {k} then {_step(f'nodes{k}', f'(i div {fan**k})', fan)} end" for k in range(LEVELS)]
    return f"filter(array({', '.join(steps)}), s -> s is not null)"


def climbed(nodes: DataFrame, fan: int, longest: int, name: str) -> list[DataFrame]:
    """The rounds of one tree per group of nodes (grp, place, size, node, item), written; the last has one array per group.

    ``longest`` is the size of the largest group.
    """
    depth, k = F.lit(0), 1
    while fan ** (k - 1) < longest:
        depth = F.when(F.col("size") > F.lit(fan ** (k - 1)), k).otherwise(depth)
        k += 1
    now = nodes.withColumn("levels", depth)
    empty = F.lit(None).cast(nodes.schema["item"].dataType)
    rounds: list[DataFrame] = []
    while not rounds or longest > 1:
        rounds.append(materialise(_round(now, fan), f"{name}-{len(rounds)}"))
        now = rounds[-1].select("grp", F.col("block").alias("place"), "size", F.greatest(F.col("levels") - LEVELS, F.lit(0)).alias("levels"), F.col("top").alias("node"), empty.alias("item"))
        longest = -(-longest // fan**LEVELS)
    return rounds


def descended(rounds: list[DataFrame], fan: int, start: DataFrame) -> DataFrame:
    """The members of the trees: item, node, path and the other columns of ``start``, which holds for each grp the path above its top.

    What lies above an array is joined to the array, before its members become rows.
    """
    kept = [c for c in start.columns if c not in ("grp", "path")]
    above = rounds[-1].select("grp", "block").join(start, "grp")
    for k in range(len(rounds) - 1, -1, -1):
        row = f"named_struct('place', members[i].place, 'item', members[i].item, 'node', members[i].node, 'path', concat({_own_path(fan)}, path))"
        arrays = rounds[k].drop("top").join(above, ["grp", "block"])
        each = arrays.select("grp", *kept, F.expr(f"inline(transform(sequence(0, size(members) - 1), i -> {row}))"))
        above = each.select("grp", F.col("place").alias("block"), "path", *kept)
    return each.drop("place")


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", fan: int = 16, tamper_every: int = 5) -> DataFrame:
    """One row per document: id, leaf, subroot, root, path (from its source's leaves to the root) and folded_root.

    Where ``tamper_every`` divides the CRC of the id, folded_root starts from the leaf of the
    document with its text in lower case (A to Z), elsewhere from the leaf itself.
    """
    at = lambda value: leaf([value.get(c, F.col(c)) for c in columns])
    hit = F.coalesce(F.crc32(F.col(id_col).cast("string")) % tamper_every == 0, F.lit(False))
    lowered = F.when(hit, at({text_col: F.translate(text_col, UPPER, LOWER)}))
    # Sorted as bytes: null is "n", which is less than any "s" and value.
    group = F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit("n"))
    leaves = materialise(docs.select(group.alias("grp"), F.col(id_col).cast("bigint").alias("id"), at({}).alias("node"), lowered.alias("lowered")), "merkle-leaves")
    rows = placed(leaves, "grp", ["id", "node"], "merkle-places")
    longest = rows.agg(F.max("size")).first()[0] or 1
    rounds = climbed(rows.select("grp", "place", "size", "node", F.struct("id", "lowered").alias("item")), fan, longest, "merkle-rows")
    subroots = rounds[-1].select(F.lit("").alias("all"), F.col("grp").alias("source"), F.col("top").alias("node"))
    tops = placed(subroots, "all", ["source"], "merkle-subroots")
    sources = tops.agg(F.max("size")).first()[0] or 1
    upper = climbed(tops.select(F.col("all").alias("grp"), "place", "size", "node", F.col("source").alias("item")), fan, sources, "merkle-sources")
    root = upper[-1].select("grp", F.expr(f"cast(array() as {PATH})").alias("path"), F.col("top").alias("root"))
    start = descended(upper, fan, root).select(F.col("item").alias("grp"), "path", F.col("node").alias("subroot"), "root")
    full = descended(rounds, fan, start)
    return full.select(F.col("item.id").alias(id_col), F.col("node").alias("leaf"), "subroot", "root", "path", folded(F.coalesce("item.lowered", "node"), F.col("path")).alias("folded_root"))


def digest(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    return rows.select(F.col(id_col).alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
