"""How the given tables stand in for observations, cues and jobs; in Spark and, as CTEs, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observations: a stream for each user, its rows in order of time. Every eleventh reading is
    blank, every third has a trailing space, which is another spelling of the same key."""
    text = F.when(F.col("event_id") % 11 == 0, "").when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit(" "))).otherwise(F.col("event_type"))
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_id"), (F.row_number().over(w) - 1).cast("long").alias("frame"), start.alias("start_us"), F.lead(start).over(w).alias("next_us"), text.alias("text"),
        F.least(F.lit(49002), F.round(F.col("value") * 100)).cast("long").alias("cents"),
    )
    return rows.select("stream_id", "frame", "start_us", F.coalesce("next_us", F.col("start_us") + 1).alias("end_us"), "text", F.trim("text").alias("key"), "cents", (F.col("cents") / 49002).alias("confidence"))


OBS = """
obs AS (
  SELECT user_id AS stream_id, row_number() OVER w - 1 AS frame, epoch_us(ts) AS start_us,
    coalesce(lead(epoch_us(ts)) OVER w, epoch_us(ts) + 1) AS end_us,
    CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 3 = 0 THEN event_type || ' ' ELSE event_type END AS text,
    trim(CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type END) AS key,
    CAST(least(49002, round(value * 100)) AS BIGINT) AS cents,
    CAST(least(49002, round(value * 100)) AS BIGINT) / 49002 AS confidence
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
)"""


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as cues: a stream for each conversation; a cue begins every two seconds and lasts 1.0 to
    1.9 seconds; every ninth is short. Times are milliseconds."""
    lasts = F.when((F.col("conv_id") + F.col("turn")) % 9 == 0, 100).otherwise(1000 + F.length("text") % 10 * 100)
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("stream_id"), "turn", (F.col("turn") * 2000).alias("start_ms"), (F.col("turn") * 2000 + lasts).cast("long").alias("end_ms"), "text", "role"
    )


CUES = """
cues AS (
  SELECT conv_id AS stream_id, turn, turn * 2000 AS start_ms,
    CAST(turn * 2000 + CASE WHEN (conv_id + turn) % 9 = 0 THEN 100 ELSE 1000 + length(text) % 10 * 100 END AS BIGINT) AS end_ms,
    text, role
  FROM conversations
)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as jobs of a queue: a series for each customer; whole seconds; some durations are not known."""
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderkey") % 7 == 0, "failed").otherwise("pending")
    duration = F.when(F.col("o_orderkey") % 10 == 0, F.lit(0)).otherwise(F.floor(F.col("o_totalprice") / 100)).cast("long")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("series"), status.alias("status"), duration.alias("duration"), (F.col("o_orderkey") % 2000).alias("processed"),
        F.year("o_orderdate").alias("season"), F.dayofyear("o_orderdate").alias("episode"), F.col("o_orderpriority").alias("language"),
    )


JOBS = """
jobs AS (
  SELECT o_orderkey AS id, o_custkey AS series,
    CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'pending' END AS status,
    CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE CAST(floor(o_totalprice / 100) AS BIGINT) END AS duration,
    o_orderkey % 2000 AS processed, CAST(year(o_orderdate) AS INTEGER) AS season, CAST(dayofyear(o_orderdate) AS INTEGER) AS episode,
    o_orderpriority AS language
  FROM orders
)"""


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as cues with a layout: a stream for each ship year and supplier; coordinates in hundredths."""
    stream = F.col("l_suppkey") * 10000 + F.year("l_shipdate")
    odd, beside = F.col("l_orderkey") % 17 == 0, F.col("l_orderkey") % 17 < 4
    return table(spark, sf_dir, "lineitem").select(
        stream.alias("stream_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"), (F.col("l_orderkey") % 5000 * 10).alias("start_cs"),
        (F.col("l_orderkey") % 5000 * 10 + 20 + F.col("l_quantity").cast("long")).alias("end_cs"), F.col("l_quantity").cast("long").alias("frames"),
        (F.when(odd, F.lit(80)).when(beside, F.lit(70)).otherwise(50 + F.col("l_partkey") % 5)).cast("long").alias("x"), (F.when(beside, F.lit(30)).otherwise(88 + F.col("l_partkey") % 4)).cast("long").alias("y"),
        (F.when(odd & (F.col("l_partkey") % 2 == 0), F.lit(20)).otherwise(10 + F.col("l_partkey") % 3)).cast("long").alias("h"),
    )


LAYOUTS = """
layouts AS (
  SELECT l_suppkey * 10000 + year(l_shipdate) AS stream_id, l_orderkey * 10 + l_linenumber AS event_id,
    l_orderkey % 5000 * 10 AS start_cs, l_orderkey % 5000 * 10 + 20 + CAST(l_quantity AS BIGINT) AS end_cs, CAST(l_quantity AS BIGINT) AS frames,
    CAST(CASE WHEN l_orderkey % 17 = 0 THEN 80 WHEN l_orderkey % 17 < 4 THEN 70 ELSE 50 + l_partkey % 5 END AS BIGINT) AS x,
    CAST(CASE WHEN l_orderkey % 17 < 4 THEN 30 ELSE 88 + l_partkey % 4 END AS BIGINT) AS y,
    CAST(CASE WHEN l_orderkey % 17 = 0 AND l_partkey % 2 = 0 THEN 20 ELSE 10 + l_partkey % 3 END AS BIGINT) AS h
  FROM lineitem
)"""
