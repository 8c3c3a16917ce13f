"""Runs of equal readings, and the events that they become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Limits of the flags, in the unit of the times (microseconds here).
SECOND = 1_000_000
LIMITS = {"confidence": 0.8, "very_short": 0.18 * SECOND, "very_long": 12 * SECOND, "reading_speed": 35, "few_frames": 3, "many_lines": 3, "least_duration": 0.001 * SECOND}


def with_run_id(rows: DataFrame, stream: str = "stream_id", order: str = "frame", key: str = "key") -> DataFrame:
    """run_id, from 0: the number of changes of the key before and at the row. Blank keys are runs too."""
    w = W.partitionBy(stream).orderBy(order)
    change = F.when(F.col(key) != F.lag(key).over(w), 1).otherwise(0)
    return rows.withColumn("__change", change).withColumn("run_id", F.sum("__change").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("__change")


def encode_runs(rows: DataFrame) -> DataFrame:
    """Consecutive observations with equal keys: one row for each run."""
    return with_run_id(rows).groupBy("stream_id", "run_id").agg(
        F.first("key").alias("key"), F.count("*").alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")
    )


def vote(rows: DataFrame, *group: str, text: str = "text", order: str = "frame") -> DataFrame:
    """The most frequent text of each group; of equally frequent ones the first seen. n and total count rows."""
    counts = rows.groupBy(*group, text).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    best = F.max(F.struct(F.col("n"), (-F.col("__first")).alias("first"), F.col(text).alias("text")))
    return counts.groupBy(*group).agg(best.alias("b"), F.sum("n").alias("total"), F.count("*").alias("n_variants")).select(*group, F.col("b.text").alias(text), F.col("b.n").alias("n"), "total", "n_variants")


def emit_events(rows: DataFrame) -> DataFrame:
    """Observations with keys to events: text by vote among what was observed, mean confidence of the rows with
    it, agreement, and the time of the best such row (the most confident, then nearest to the middle).
    Blank runs separate and are dropped; ids count the rest from 1."""
    run = W.partitionBy("stream_id", "run_id")
    # Everything below is dealt by stream as the runs are: no row is sent twice.
    said = with_run_id(rows).where("key <> ''").withColumn("run_start", F.min("start_us").over(run)).withColumn("run_end", F.max("end_us").over(run))
    far = F.abs(F.col("run_start") + F.col("run_end") - 2 * F.col("start_us"))
    best = F.min(F.struct((-F.col("cents")).alias("c"), far.alias("far"), F.col("frame"), F.col("start_us"))).alias("best")
    texts = said.groupBy("stream_id", "run_id", "text").agg(
        F.count("*").alias("n"), F.min("frame").alias("seen"), F.max("frame").alias("last"), F.sum("cents").alias("cents"), best, F.min("run_start").alias("start_us"), F.max("run_end").alias("end_us")
    )
    voted = F.max(F.struct("n", (-F.col("seen")).alias("early"), "text", "cents", "best")).alias("v")
    events = texts.groupBy("stream_id", "run_id").agg(
        voted, F.sum("n").alias("frames"), F.count("*").alias("n_variants"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.min("seen").alias("first_frame"), F.max("last").alias("last_frame")
    )
    ids = F.row_number().over(W.partitionBy("stream_id").orderBy("run_id"))
    return events.select(
        "stream_id", ids.cast("long").alias("id"), "start_us", "end_us", F.col("v.text").alias("text"), F.round(F.col("v.cents") / F.col("v.n") / 49002, 4).alias("confidence"), "frames",
        F.round(F.col("v.n") / F.col("frames"), 4).alias("agreement"), F.col("v.best.start_us").alias("evidence_us"), "first_frame", "last_frame", "n_variants",
    )


def flags(confidence: Column, duration: Column, text: Column, frames: Column, limits: dict = LIMITS) -> Column:
    """The quality flags of an event in alphabetical order."""
    lines = F.size(F.split(text, "\n"))
    speed = F.length(F.trim(text)) / (F.greatest(duration, F.lit(limits["least_duration"])) / SECOND)
    found = [
        ("few_frames", frames < limits["few_frames"]), ("high_reading_speed", speed > limits["reading_speed"]), ("low_confidence", confidence < limits["confidence"]),
        ("many_lines", lines > limits["many_lines"]), ("very_long", duration > limits["very_long"]), ("very_short", duration < limits["very_short"]),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in found]), lambda x: x.isNotNull())


def aba(runs: DataFrame, reach: int) -> DataFrame:
    """Runs between two runs of one other key that are at most `reach` long: candidates for a repair."""
    w = W.partitionBy("stream_id").orderBy("run_id")
    runs = runs.withColumn("before", F.lag("key").over(w)).withColumn("after", F.lead("key").over(w))
    return runs.where((F.col("before") == F.col("after")) & (F.col("before") != F.col("key")) & (F.col("before") != "") & (F.col("end_us") - F.col("start_us") <= reach))


def coalesce_equal(runs: DataFrame) -> DataFrame:
    """Neighbouring runs whose keys have become equal are one run."""
    again = with_run_id(runs.drop("run_id"), order="first_frame")
    return again.groupBy("stream_id", "run_id").agg(
        F.first("key").alias("key"), F.sum("n").alias("n"), F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")
    )


def identical_fragments(runs: DataFrame, gap: int) -> DataFrame:
    """Runs of text that only blanks of at most `gap` in all part from one of the same key are one with it."""
    w = W.partitionBy("stream_id").orderBy("run_id")
    texts = runs.where("key <> ''")
    joined = (F.lag("key").over(w) == F.col("key")) & (F.col("start_us") - F.lag("end_us").over(w)).between(0, gap)
    texts = texts.withColumn("new", F.when(joined, 0).otherwise(1))
    texts = texts.withColumn("fragment", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long"))
    return texts.groupBy("stream_id", "fragment", "key").agg(
        F.sum("n").alias("n"), F.count("*").alias("parts"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")
    )
