"""Monitoring: reports, alerts and usage, in batches and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.catalog import mean, mean_sql, rate, rate_sql, table
from ..streaming import jobs

_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


@query(f"""WITH l AS (SELECT *, {_K} AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_id, k FROM l WHERE n = 1 AND (k >= 50 OR event_type IN ('error', 'purchase'))""")
def alert_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest report of each competitor, if its preferences ask for it."""
    newest = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "props")).alias("x")).select("user_id", "x.*").withColumn("k", _k())
    return newest.where((F.col("k") >= 50) | F.col("event_type").isin("error", "purchase")).select("user_id", "event_id", "k")


@query(f"""SELECT user_id, CAST(date_trunc('week', ts) AS DATE)::VARCHAR AS week, count(*) AS reports, CAST(sum({_K}) AS BIGINT) AS changes, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY ALL""")
def weekly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports and changes of each competitor by week."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("week", "ts").cast("date").cast("string").alias("week")).agg(F.count("*").alias("reports"), F.sum(_k().cast("long")).alias("changes"), F.count_if(F.col("event_type") == "error").alias("failed"))


@query(f"""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS competitors, {mean_sql('value', 2)} AS avg_value, {rate_sql("count(*) FILTER (WHERE value > 100)", 'count(*)')} AS high_rate FROM events GROUP BY event_type""")
def dashboard_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures over all competitors."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("competitors"), mean("value", 2).alias("avg_value"), rate(F.count_if(F.col("value") > 100), F.count("*")).alias("high_rate"))


@query(f"""SELECT lang, source, count(*) AS n, {rate_sql('sum(quality)', 'count(*)', 3)} AS accuracy, {rate_sql('sum(toxic)', 'count(*)', 3)} AS failure_rate FROM documents JOIN labels USING (doc_id) GROUP BY lang, source""")
def accuracy_groupings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and failure rates by kind of page."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang", "source").agg(F.count("*").alias("n"), rate(F.sum("quality"), F.count("*"), 3).alias("accuracy"), rate(F.sum("toxic"), F.count("*"), 3).alias("failure_rate"))


@query("""SELECT event_id, event_type FROM events WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM (VALUES (7), (11), (13)) k(m) WHERE user_id % 100 = m)""")
def known_issue_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures that no known issue waives."""
    known = F.broadcast(spark.createDataFrame([(7,), (11,), (13,)], "m long"))  # a fixed list
    errors = table(spark, sf_dir, "events").where("event_type = 'error'")
    return errors.join(known, F.col("user_id") % 100 == F.col("m"), "left_anti").select("event_id", "event_type")


@query("""SELECT role, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS characters, count(*) FILTER (WHERE length(text) > 0) AS valid FROM conversations GROUP BY role""")
def ai_cost_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage counters by role."""
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("calls"), F.sum(F.length("text").cast("long")).alias("characters"), F.count_if(F.length("text") > 0).alias("valid"))


@query("""SELECT DISTINCT o_custkey AS customer, c_mktsegment AS segment FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def unmapped_owner_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders but none that is finished."""
    orders = table(spark, sf_dir, "orders")
    open_ = orders.select("o_custkey").distinct().join(orders.where("o_orderstatus = 'F'").select("o_custkey"), "o_custkey", "left_anti")
    return open_.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("customer"), F.col("c_mktsegment").alias("segment"))


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS events FROM events GROUP BY user_id""")
def streaming_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest status per key, as a stream keeps it."""
    return jobs.latest_status(spark, sf_dir)


@query("""SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n FROM events GROUP BY ALL""")
def streaming_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and hour with a watermark."""
    return jobs.hourly_counts(spark, sf_dir)


@query(f"""SELECT user_id, event_id, {_K} AS k, {_K} - lag({_K}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events""")
def streaming_snapshot_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each report against the one before it of its key, which the stream holds as state."""
    return jobs.snapshot_diffs(spark, sf_dir)


@query("""SELECT user_id, count(*) AS settled FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type IN ('purchase', 'error')) >= 3""")
def streaming_settled_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of which enough pages are settled."""
    return jobs.settled(spark, sf_dir)


@query(f"""SELECT user_id AS key, event_id AS id, {_K} AS value, {_K} - lag({_K}) OVER (PARTITION BY user_id ORDER BY date_trunc('millisecond', ts), event_id) AS delta FROM events""")
def streaming_ordered_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each report against the one before it by time, from a stream that delivers late, twice and out of order."""
    return jobs.ordered_snapshots(spark, sf_dir)


@query(f"""WITH RECURSIVE asking AS (SELECT user_id AS key, event_id AS id, {_K} AS value, epoch_ms(ts) AS at_, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events WHERE {_K} >= 50 OR event_type = 'error'),
walk AS (
    SELECT key, id, value, at_, n, at_ AS fired_at, true AS fired FROM asking WHERE n = 1
    UNION ALL SELECT a.key, a.id, a.value, a.at_, a.n, CASE WHEN a.at_ - w.fired_at > 21600000 THEN a.at_ ELSE w.fired_at END, a.at_ - w.fired_at > 21600000 FROM walk w JOIN asking a ON a.key = w.key AND a.n = w.n + 1
) SELECT key, id, value FROM walk WHERE fired""")
def streaming_alerts_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts by competitor, each once, none within six hours of another."""
    return jobs.fired_alerts(spark, sf_dir)


@query("""SELECT user_id AS key, 3 AS needed FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id HAVING count(DISTINCT event_id) >= 3""")
def streaming_rebuild_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competitors whose pages are all settled, each told once."""
    return jobs.rebuilds(spark, sf_dir)
