"""Keyed streams give the same rows in whatever order and number of files their input comes."""

import random

import pytest
from pyspark.sql import functions as F

from shelfscope.streaming import stateful
from shelfscope.streaming.jobs import HEARTBEAT, _run, scattered

SCHEMA = "key long, id long, value int, at long"


def events():
    rnd = random.Random(6)
    return [(rnd.randrange(6), i, rnd.choice([None, *range(100)]), 1_700_000_000_000 + rnd.randrange(10 * 86_400_000)) for i in range(300)]


def stream(spark, tmp_path, rows, files):
    for k in range(files):
        spark.createDataFrame(rows[k::files], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{files}")
    spark.createDataFrame([(HEARTBEAT, -1, None, max(r[3] for r in rows) + 100 * 86_400_000)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{files}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 4).parquet(f"{tmp_path}/in{files}")
    return source.withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", "30 days")


@pytest.mark.parametrize("files", [1, 7])
def test_order_and_copies_do_not_matter(spark, tmp_path, files):
    rows = events()
    given = rows + rows[::3]
    random.Random(files).shuffle(given)
    want, quiet = {}, {}
    diffs, alerts = [], []
    for key, id_, value, at in sorted(rows, key=lambda r: (r[3], r[1])):
        before = want.get(key)
        diffs.append((key, id_, value, value - before if value is not None and before is not None else None))
        want[key] = value
        if key not in quiet or at - quiet[key] > 3_600_000 * 12:
            alerts.append((key, id_))
            quiet[key] = at
    got = _run(stateful.ordered_diffs(stream(spark, tmp_path, given, files))).where(F.col("key") != HEARTBEAT).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, diffs))
    if files > 1:
        fired = _run(stateful.alerts_once(stream(spark, tmp_path / "a", given, files), 3_600_000 * 12)).where(F.col("key") != HEARTBEAT).collect()
        assert sorted((r["key"], r["id"]) for r in fired) == sorted(alerts)


def test_a_barrier_fires_once(spark, tmp_path):
    parts = [(k, part, None, 1_700_000_000_000 + part) for k in range(4) for part in range(k + 1)]
    random.Random(1).shuffle(parts)
    rows = stream(spark, tmp_path, parts * 2, 5).where(F.col("key") != HEARTBEAT)
    got = _run(stateful.rebuild_once(rows.select("key", "ts", "at", F.col("id").alias("part"), F.lit(3).alias("needed")))).collect()
    assert sorted(map(tuple, got)) == [(2, 3), (3, 3)]


def test_files_are_written_at_once_and_taken_in_order(spark):
    spark.sparkContext.setJobGroup("scattered", "")
    stream = scattered(spark, "/root/testdata/sf0.001")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("scattered"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 10  # a job by file would read all events for each
    batches = []
    query = stream.writeStream.foreachBatch(lambda rows, n: batches.append(rows.agg({"ts": "min"}).first()[0])).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(batches) == 4
    assert batches == sorted(batches)
