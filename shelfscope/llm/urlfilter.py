"""URL rules by a sort-merge range join.

A host is keyed by its labels in reverse order, each ended by a dot (``example.org`` is
``org.example.``).  A rule's host then covers an interval of keys, itself and all subdomains, and
such intervals are nested or disjoint.  Rules and urls are dealt to ranges of keys and sorted
there; one sweep keeps the rules whose interval is open on a stack, and a url is held against the
rules of the stack whose path starts its own.  The longest rule (host and path) wins.

Range bounds come from a bounded, hash-chosen sample of keys (``sample``); keys that fill several
ranges of the sample are dealt over all of them, so a host with a third of all urls is no single
task.  A rule goes to each range that its interval meets; the rules themselves need not fit
anywhere whole.

Edge cases: a null url, or one without ``://``, has an empty host and path, which no rule fits; a
rule with a null or empty host fits nothing; of rules that are equally long, block goes first, then
the smaller text; rows that repeat a page_id are judged each; without rules every url has the
default verdict; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, in lower case (A-Z); else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ? or #; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))).otherwise("")


def filter_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int | None = None, sample: int = 8192) -> DataFrame:
    """Judge every url by the rules (host, path, verdict): page_id, host, path, rule, verdict."""
    spark = urls.sparkSession
    rows = urls.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rows = rows.withColumn("key", host_key(F.col("host"))).withColumn("salt", F.xxhash64("page_id", "path"))
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or 4 * count
    n = rows.count()
    picked = rows.where(F.pmod(F.xxhash64("salt"), F.lit(max(1, n // sample))) == 0).select("key").limit(2 * sample).collect()
    keys = sorted(r["key"] for r in picked)
    bounds = [keys[len(keys) * k // ranges] for k in range(1, ranges)] if keys else []

    def slots(low: str, high: str | None) -> tuple[int, int]:
        """First and last range that a key, or the interval from low up to before high, can be in."""
        return bisect_left(bounds, low), bisect_right(bounds, low) if high is None else bisect_left(bounds, high)

    def deal_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, salt in zip(batch["key"].to_pylist(), batch["salt"].to_pylist(), strict=True):
                first, last = slots(key, None)
                out.append(first + salt % (last - first + 1))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32()), pa.array([1] * len(out), pa.int32()), batch["key"], batch["page_id"], batch["host"], batch["path"], pa.nulls(len(out), pa.string())], ["slot", "kind", "key", "page_id", "host", "path", "verdict"])

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                first, last = slots(r["key"], r["key"][:-1] + "/")  # "/" is next to "."
                out += [(s, 0, r["key"], None, r["host"], r["path"], r["verdict"]) for s in range(first, last + 1)]
            kinds = [pa.int32(), pa.int32(), pa.string(), batch_id, pa.string(), pa.string(), pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["slot", "kind", "key", "page_id", "host", "path", "verdict"])

    id_type = rows.schema["page_id"].dataType
    batch_id = to_arrow_type(id_type)
    dealt = f"slot int, kind int, key string, page_id {id_type.simpleString()}, host string, path string, verdict string"
    ruled = rules.select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict").where("coalesce(host, '') <> ''").distinct().withColumn("key", host_key(F.col("host")))
    both = rows.mapInArrow(deal_urls, dealt).unionAll(ruled.mapInArrow(deal_rules, dealt))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, stack = None, []
        for batch in batches:
            out: list[tuple] = []
            for r in batch.select(["slot", "kind", "key", "page_id", "host", "path", "verdict"]).to_pylist():
                if r["slot"] != slot:
                    slot, stack = r["slot"], []
                while stack and not r["key"].startswith(stack[-1][0]):
                    stack.pop()
                if r["kind"] == 0:
                    if not stack or stack[-1][0] != r["key"]:
                        stack.append((r["key"], {}))
                    paths = stack[-1][1]
                    if r["path"] not in paths or r["verdict"] == "block":
                        paths[r["path"]] = (r["host"] + r["path"], r["verdict"])
                    continue
                best: tuple | None = None
                for _, paths in stack:
                    for length in {len(p) for p in paths} if len(paths) < 8 else range(len(r["path"]) + 1):
                        rule = paths.get(r["path"][:length]) if length <= len(r["path"]) else None
                        if rule and (best is None or (-len(rule[0]), rule[1] != "block", rule[0]) < (-len(best[0]), best[1] != "block", best[0])):
                            best = rule
                out.append((r["page_id"], r["host"], r["path"], best and best[0], best[1] if best else default))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch_id, *[pa.string()] * 4], strict=True)], ["page_id", "host", "path", "rule", "verdict"])

    swept = both.repartition(count, "slot").sortWithinPartitions("slot", "key", "kind")
    return swept.mapInArrow(sweep, f"page_id {id_type.simpleString()}, host string, path string, rule string, verdict string")
