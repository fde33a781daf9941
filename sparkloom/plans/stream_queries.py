"""Streaming queries over the events, run to the end of what is there, with the batch SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.plans.registry import query
from sparkloom.sources.tables import table
from sparkloom.streaming import windows


def _plain(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.col(n).cast("timestamp_ntz"))
    return df.withColumn("v", F.round("v", 4)) if "v" in df.columns else df


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS stop, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2, 3")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(windows.drain(windows.tumbling(windows.source(spark, sf_dir), "ts", "1 hour", "0 seconds", ["event_type"]), "complete"), "start", "stop").drop("_batch")


@query("stream_hopping", "SELECT start, start + INTERVAL 2 HOUR AS stop, event_type, count(*) AS n, round(sum(value), 4) AS v FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * i AS start FROM events, (VALUES (0), (1)) h(i)) GROUP BY 1, 2, 3")
def stream_hopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(windows.drain(windows.tumbling(windows.source(spark, sf_dir), "ts", "2 hours", "0 seconds", ["event_type"], "1 hour"), "complete"), "start", "stop").drop("_batch")


@query("stream_append_closed_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS stop, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_append_closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(windows.drain(windows.tumbling(windows.source(spark, sf_dir), "ts", "1 day", "1 hour", [])), "start", "stop")


_LATE = "(SELECT *, CASE event_id % 10 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS part FROM events)"


@query(
    "stream_late_rows",
    f"""WITH e AS {_LATE}, m AS (SELECT max(ts) - INTERVAL 5 DAY AS mark FROM e WHERE part = 0)
    SELECT start, start + INTERVAL 1 DAY AS stop, count(*) AS n, round(sum(value), 4) AS v FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, part, value FROM e), m WHERE part < 2 OR start + INTERVAL 1 DAY > mark
    GROUP BY start, mark HAVING start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 5 DAY FROM e)""",
)
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: a tenth of the events comes two batches after most others, when the first batch's watermark is in
    force, and what of it belongs to windows closed by that is dropped."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = windows.in_batches([e.where("event_id % 10 > 1"), e.where("event_id % 10 = 1"), e.where("event_id % 10 = 0")])
    return _plain(windows.drain(windows.tumbling(stream, "ts", "1 day", "5 days", [])), "start", "stop")


@query(
    "stream_top_of_each",
    "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INT) AS rank FROM events QUALIFY rank <= 3",
)
def stream_top_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROW_NUMBER() <= 3 over a stream in two batches: each key's best rows are its state."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = windows.in_batches([e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")])
    return windows.drain(windows.top_of_each(stream, ["user_id"], [("value", False), ("event_id", True)], ["event_id"], 3), "complete").select("user_id", "event_id", "rank")


@query(
    "stream_sessions",
    """WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f) SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS stop, user_id, count(*) AS n FROM s GROUP BY user_id, s""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(windows.drain(windows.session_windows(windows.source(spark, sf_dir), "ts", "2 hours", "0 seconds", ["user_id"]), "complete"), "start", "stop").drop("_batch")


@query("stream_first_of_each", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")
def stream_first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.drain(windows.first_of_each(windows.source(spark, sf_dir), "ts", "60 days", ["user_id", "event_type"])).agg(F.count(F.lit(1)).alias("n"))


@query("stream_interval_join", "SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 1 HOUR WHERE v.event_type = 'view' AND p.event_type = 'purchase'")
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = windows.source(spark, sf_dir).where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("u"), F.col("ts").alias("tv"))
    p = windows.source(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("w"), F.col("ts").alias("tp"))
    return windows.drain(windows.interval_join(v, p, "tv", "tp", "1 hour", "u", "w", "1 HOUR")).select("view_id", "purchase_id")


@query("stream_static_join", "SELECT event_id, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey")
def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.drain(windows.source(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey"), "left").select("event_id", "c_mktsegment"))


@query("stream_state_totals", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_state_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.drain(windows.running_totals(windows.source(spark, sf_dir), "event_type", "value"), "update")
    return rows.groupBy("event_type").agg(F.max_by("n", "_batch").alias("n"), F.round(F.max_by("total", "_batch"), 4).alias("total"))


@query("stream_keep_last", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def stream_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.drain(windows.keep_last(windows.source(spark, sf_dir).select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"]), "complete").select("user_id", "event_id")


@query(
    "stream_versioned_lookup",
    """WITH v AS (SELECT user_id, event_id AS view_id, ts AS f, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events WHERE event_type = 'view')
    SELECT e.event_id, view_id FROM events e LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= f AND (t IS NULL OR e.ts < t) WHERE e.event_type = 'purchase'""",
)
def stream_versioned_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of a stream with the version of their user that a table of validity periods held at the time."""
    views = table(spark, sf_dir, "events").where("event_type = 'view'").withColumn("f", F.col("ts").cast("timestamp"))
    periods = views.select(F.col("user_id").alias("u"), F.col("event_id").alias("view_id"), "f", F.lead("f").over(Window.partitionBy("user_id").orderBy("f", "event_id")).alias("t"))
    stream = windows.source(spark, sf_dir).where("event_type = 'purchase'")
    return windows.drain(windows.versioned_lookup(stream, periods, "user_id", "ts", "u", "f", "t").select("event_id", "view_id"))
