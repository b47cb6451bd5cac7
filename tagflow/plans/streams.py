"""Streaming queries, each equal to its batch twin in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagflow.sources import table
from tagflow.streaming import actor, counted_sum, cross, drained, emitted_once, latest, memoized, stream, total_by, windowed


def of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return stream(spark, f"{sf}/{name}.parquet", table(spark, sf, name))


def k2_stream_cross(spark: SparkSession, sf: str) -> DataFrame:
    return drained(cross(of(spark, sf, "region").select("r_regionkey"), of(spark, sf, "nation").select("n_nationkey")))


def k3_stream_counted(spark: SparkSession, sf: str) -> DataFrame:
    counts = of(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(F.col("o_orderkey") % 7 + 1).alias("n"))
    items = of(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("v"))
    return emitted_once(counted_sum(items, counts, "k", "v"), "key").select("key", F.round("value", 2).alias("value"), "n_reduced")


def k3_stream_total(spark: SparkSession, sf: str) -> DataFrame:
    items = of(spark, sf, "events").select("event_type", F.col("value").cast("decimal(28,2)").alias("v"))
    return drained(total_by(items, "event_type", "v"), "complete").select("event_type", F.col("value").cast("double").alias("value"), "n_reduced")


def k5_stream_memo(spark: SparkSession, sf: str) -> DataFrame:
    return drained(memoized(of(spark, sf, "events").select("user_id", "event_type"), "user_id", "event_type"))


def k6_stream_actor(spark: SparkSession, sf: str) -> DataFrame:
    return drained(actor(of(spark, sf, "events"), "user_id", "event_id", "value")).select(F.col("order").alias("event_id"), F.round("out", 6).alias("out"))


def k7_stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    return drained(latest(of(spark, sf, "events"), "user_id", "event_id", "event_type", "value", ["click", "view"])).select(F.col("order").alias("event_id"), "last_click", "last_view")


def k9_stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Our own extension: sums of hours."""
    rows = of(spark, sf, "events").select("ts", F.col("value").cast("decimal(28,2)").alias("v"))
    out = drained(windowed(rows, "ts", "1 hour", "1 day", "v"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("hour"), F.col("value").cast("double").alias("value"), "n")


QUERIES = {"K2_stream_cross": k2_stream_cross, "K3_stream_counted": k3_stream_counted, "K3_stream_total": k3_stream_total, "K5_stream_memo": k5_stream_memo, "K6_stream_actor": k6_stream_actor, "K7_stream_latest": k7_stream_latest, "K9_stream_windows": k9_stream_windows}

SQL = {
    "K2_stream_cross": "SELECT r_regionkey, n_nationkey FROM region, nation",
    "K3_stream_counted": """
        SELECT o_orderkey AS key, round(sum(l_quantity), 2) AS value, count(*) AS n_reduced FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        GROUP BY o_orderkey HAVING o_orderkey % 3 = 0 OR count(*) = o_orderkey % 7 + 1""",
    "K3_stream_total": "SELECT event_type, sum(value::DECIMAL(28,2))::DOUBLE AS value, count(*) AS n_reduced FROM events GROUP BY event_type",
    "K5_stream_memo": "SELECT DISTINCT user_id, event_type FROM events",
    "K6_stream_actor": "SELECT event_id, round(value + row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1, 6) AS out FROM events",
    "K9_stream_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, sum(value::DECIMAL(28,2))::DOUBLE AS value, count(*) AS n FROM events GROUP BY ALL",
    "K7_stream_latest": """
        SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w, 0) AS last_click,
          coalesce(last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w, 0) AS last_view
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
}
