"""Streams over the event table.

Each job reads the files as a stream, runs until all input is processed (availableNow) and returns
what its sink holds.  Sink and checkpoint are folders in the shared folder that
spark.checkpoint.dir names, so any executor can take over.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.files import shared_folder
from . import stateful


def _folder(spark: SparkSession) -> str:
    return shared_folder(spark, "stream")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event files as a stream; their schema is read once from the same files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/events.parquet*")


def _run(df: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Process all input; in update mode the newest row of each key is what counts."""
    spark, folder = df.sparkSession, _folder(df.sparkSession)
    if mode == "append":
        writer = df.writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append")
    else:

        def write(batch: DataFrame, number: int) -> None:
            batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/_batch={number}")

        writer = df.writeStream.foreachBatch(write).outputMode("update")
    writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    if mode == "append":
        return spark.read.schema(df.schema).parquet(f"{folder}/out")
    rows = spark.read.parquet(f"{folder}/out")
    others = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("x")).select(*keys, "x.*")


def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, status, events: running aggregates per key."""
    newest = _events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("events"))
    return _run(newest, "update", ["user_id"])


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, hour (as text), n: tumbling windows; events may be two hours late."""
    windows = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 hours").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return _run(windows.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "n"), "update", ["event_type", "hour"])


def snapshot_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, k, delta: the state of a key is its last k."""

    def diff(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat([f for f in frames if len(f)]).sort_values(["ts", "event_id"])
        before = state.get[0] if state.exists else None
        k = rows["k"].astype("Int32")
        delta = k - k.shift(1)
        if before is not None and not pd.isna(k.iloc[0]):
            delta.iloc[0] = k.iloc[0] - before
        state.update((None if pd.isna(k.iloc[-1]) else int(k.iloc[-1]),))
        yield pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "k": k, "delta": delta.astype("Int32")})

    events = _events(spark, sf_dir).select("user_id", "event_id", "ts", F.get_json_object("props", "$.k").cast("int").alias("k"))
    found = events.groupBy("user_id").applyInPandasWithState(diff, "user_id long, event_id long, k int, delta int", "k int", "append", GroupStateTimeout.NoTimeout)
    return _run(found)


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, settled: keys past the barrier of three settled pages, with their events."""
    counts = _events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("settled"), F.count_if(F.col("event_type").isin("purchase", "error")).alias("n"))
    return _run(counts, "update", ["user_id"]).where("n >= 3").select("user_id", "settled")


# Keyed state over events that arrive late, twice and out of order.


#: The key of rows that only move the watermark.
HEARTBEAT = -1


def scattered(spark: SparkSession, sf_dir: str, files: int = 10) -> DataFrame:
    """The events as a stream of ``files`` files, each event up to two hours out of order and every third one twice; a heartbeat (HEARTBEAT as key) ends it, so that the watermark passes all."""
    folder = f"{_folder(spark)}/in"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    copies = events.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("event_id") % 3 == 0, 1).otherwise(0))))
    arrival = F.unix_millis("ts") + F.pmod(F.xxhash64("event_id", "copy"), F.lit(7_200_000))
    bounds = events.agg(F.min(F.unix_millis("ts")).alias("a"), F.max(F.unix_millis("ts")).alias("b")).first()
    span = max(1, ((bounds["b"] or 0) - (bounds["a"] or 0) + 7_200_000) // files + 1)
    numbered = copies.withColumn("file", F.floor((arrival - (bounds["a"] or 0)) / span).cast("int")).drop("copy")
    last = spark.createDataFrame([(HEARTBEAT, None, None, None, None, files)], numbered.schema).withColumn("ts", F.timestamp_millis(F.lit((bounds["b"] or 0) + 10 * 86_400_000)))
    # The events are read once and all files written at once; then they are put in their place, with times that say their order, as the source takes files by their time.
    aside, fs_of = f"{_folder(spark)}/aside", spark._jvm.org.apache.hadoop.fs
    numbered.unionByName(last).repartition(4 * files, "file").write.partitionBy("file").parquet(aside)
    fs = fs_of.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(fs_of.Path(folder))
    began = int(time.time()) - files - 1
    for k in range(files + 1):
        for n, status in enumerate(fs.globStatus(fs_of.Path(f"{aside}/file={k}/*.parquet")) or ()):
            place = fs_of.Path(f"{folder}/part-{k:05d}-{n}.parquet")
            if not fs.rename(status.getPath(), place):
                raise OSError(f"cannot move {status.getPath()} to {place}")
            fs.setTimes(place, (began + k) * 1000, -1)
    return spark.readStream.schema(numbered.drop("file").schema).option("maxFilesPerTrigger", 3).parquet(folder)


def _timed(rows: DataFrame) -> DataFrame:
    return rows.where("user_id is not null").withWatermark("ts", "3 hours").select(F.col("user_id").alias("key"), "ts", F.unix_millis("ts").alias("at"), F.coalesce("event_id", F.lit(-1)).alias("id"), F.col("k").alias("value"), "event_type")


def ordered_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, id, value, delta of all events, in the order of their time."""
    return _run(stateful.ordered_diffs(_timed(scattered(spark, sf_dir)))).where(F.col("key") != HEARTBEAT)


def fired_alerts(spark: SparkSession, sf_dir: str, quiet_ms: int = 6 * 3_600_000) -> DataFrame:
    """key, id, value of alerts: events of 50 or more, or errors, unless the key had one in the six hours before."""
    asking = _timed(scattered(spark, sf_dir)).where("value >= 50 or event_type = 'error'" + f" or key = {HEARTBEAT}")
    return _run(stateful.alerts_once(asking, quiet_ms)).where(F.col("key") != HEARTBEAT)


def rebuilds(spark: SparkSession, sf_dir: str, needed: int = 3) -> DataFrame:
    """key, needed: one row for each key with so many settled pages."""
    rows = _timed(scattered(spark, sf_dir)).where("event_type in ('purchase', 'error')").select("key", "ts", "at", F.col("id").alias("part"), F.lit(needed).alias("needed"))
    return _run(stateful.rebuild_once(rows))
