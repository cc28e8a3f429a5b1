"""Windows, top-k and series over the event table (reports of competitors)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.catalog import rnd, table


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


@query(f"SELECT user_id, event_id, ts, event_type, {_K} AS changes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_report_per_competitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest report of each competitor, as the max of a struct."""
    newest = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "props")).alias("x")).select("user_id", "x.*")
    return newest.select("user_id", "event_id", "ts", "event_type", _k().alias("changes"))


@query("""SELECT user_id, event_id, value, (floor((value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) * 100 + 0.5) / 100) AS delta, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events QUALIFY n <= 200""")
def metric_trend_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A competitor's first 200 values with the change to the one before."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "value", rnd(F.col("value") - F.lag("value").over(order), 2).alias("delta"), F.row_number().over(order).alias("n")).where("n <= 200")


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY back DESC) AS place FROM t WHERE back <= 30""")
def history_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 30 reports of each competitor, oldest first."""
    own = Window.partitionBy("user_id")
    newest = table(spark, sf_dir, "events").withColumn("back", F.row_number().over(own.orderBy(F.desc("ts"), F.desc("event_id")))).where("back <= 30")
    return newest.select("user_id", "event_id", F.row_number().over(own.orderBy(F.desc("back"))).alias("place"))


@query("""WITH d AS (SELECT CAST(max(ts) AS DATE) AS last FROM events), s AS (SELECT CAST(unnest(generate_series(last - INTERVAL 6 DAY, last, INTERVAL 1 DAY)) AS DATE) AS day FROM d),
v AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, coalesce(n, 0) AS events, coalesce(total, 0.0) AS total FROM s LEFT JOIN v USING (day)""")
def date_spine_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last seven days, also those without events."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    spine = events.agg(F.max("day").alias("last")).select(F.explode(F.sequence(F.date_sub("last", 6), F.col("last"))).alias("day"))
    sums = events.groupBy("day").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return spine.join(sums, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("events"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS in_window FROM events QUALIFY in_window > 1")
def rate_limit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that had others of their key in the window before them."""
    held = F.expr("count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW)")
    return table(spark, sf_dir, "events").select("event_id", "user_id", held.alias("in_window")).where("in_window > 1")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, ts DESC, event_id) AS n FROM events) WHERE n <= 5 OR event_type = 'signup'""")
def newest_n_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five pages per competitor, chosen ones first, then new ones; home pages always stay."""
    own = Window.partitionBy("user_id").orderBy((F.col("event_type") == "purchase").desc(), F.desc("ts"), "event_id")
    return table(spark, sf_dir, "events").withColumn("n", F.row_number().over(own)).where((F.col("n") <= 5) | (F.col("event_type") == "signup")).select("user_id", "event_id")


@query("SELECT event_id, ts, count(*) OVER () AS total FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def job_pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 20 failed jobs, newest first, with the total."""
    errors = table(spark, sf_dir, "events").where("event_type = 'error'")
    total = errors.agg(F.count("*").alias("total"))  # one row
    return errors.orderBy(F.desc("ts"), "event_id").offset(40).limit(20).join(F.broadcast(total)).select("event_id", "ts", "total")


@query("SELECT l_suppkey AS site, count(*) AS votes, min(l_linenumber) AS first_rank FROM lineitem GROUP BY l_suppkey ORDER BY votes DESC, first_rank, site LIMIT 24")
def search_vote_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24 candidates with the most votes, earlier ranks first."""
    votes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("site")).agg(F.count("*").alias("votes"), F.min("l_linenumber").alias("first_rank"))
    return votes.orderBy(F.desc("votes"), "first_rank", "site").limit(24)


@query("SELECT o_custkey AS customer, o_orderkey AS order_key, o_totalprice AS price, rk FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE rk <= 3 AND n > 3")
def trim_with_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three rows of groups that have more."""
    own = Window.partitionBy("o_custkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(own.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rk"), F.count("*").over(own).alias("n"))
    return rows.where("rk <= 3 and n > 3").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").alias("price"), "rk")
