"""Correlation of rows in time and position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def within_events(frames: DataFrame, events: DataFrame, bucket_us: int = 3_600_000_000) -> DataFrame:
    """Frames whose start lies in an event of their stream and key: a semi join with an interval.

    An event stands in every time bucket that it touches, a frame in the one of its start, so the join's equality
    also parts a long stream."""
    low, high = F.floor(F.col("start_us") / bucket_us), F.floor((F.col("end_us") - 1) / bucket_us)
    e = events.where("end_us > start_us").select(
        F.col("stream_id").alias("__s"), F.col("key").alias("__k"), F.col("start_us").alias("__from"), F.col("end_us").alias("__to"), F.explode(F.sequence(low, high)).alias("__b")
    )
    met = (F.col("stream_id") == F.col("__s")) & (F.col("key") == F.col("__k")) & (low == F.col("__b")) & (F.col("__from") <= F.col("start_us")) & (F.col("start_us") < F.col("__to"))
    return frames.join(e, met, "left_semi")


def as_of(asks: DataFrame, rows: DataFrame, direction: str, tolerance: int = 0) -> DataFrame:
    """For each ask (stream_id, at_us) the last row that starts by then, or the first that starts from then on.

    One sort of both tables by stream and time and a running last value: no join of every pair."""
    values = [c for c in rows.columns if c not in ("stream_id",)]
    back = direction == "backward"
    at = F.col("at_us") + (tolerance if back else -tolerance)
    a = asks.select("stream_id", at.alias("__t"), F.lit(1 if back else 0).alias("__ask"), F.struct(*asks.columns).alias("__a"), F.lit(None).cast(rows.select(F.struct(*values)).schema[0].dataType).alias("__r"))
    r = rows.select("stream_id", F.col("start_us").alias("__t"), F.lit(0 if back else 1).alias("__ask"), F.lit(None).cast(a.schema["__a"].dataType).alias("__a"), F.struct(*values).alias("__r"))
    order = [F.col("__t").asc(), F.col("__ask").asc()] if back else [F.col("__t").desc(), F.col("__ask").desc()]
    seen = F.last("__r", ignorenulls=True).over(W.partitionBy("stream_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    found = a.union(r).withColumn("__seen", seen).where(F.col("__a").isNotNull() & F.col("__seen").isNotNull())
    return found.select("__a.*", *[F.col(f"__seen.{c}").alias(c) for c in values])


def not_cached(frames: DataFrame, cached: DataFrame) -> DataFrame:
    return frames.join(cached, ["stream_id", "frame"], "left_anti")


def windows(frames: DataFrame, gap: int) -> DataFrame:
    """Frames chained while the next starts within gap: one row for each window."""
    w = W.partitionBy("stream_id").orderBy("start_us")
    new = F.when(F.col("start_us") - F.lag("start_us").over(w) <= gap, 0).otherwise(1)
    numbered = frames.withColumn("__new", new).withColumn("window_id", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long"))
    return numbered.groupBy("stream_id", "window_id").agg(F.count("*").alias("n"), F.min("start_us").alias("from_us"), F.max("start_us").alias("to_us"))


def keep_last(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Of rows with equal keys the one with the highest version: an upsert."""
    best = F.max(F.struct(F.col(version), *[c for c in rows.columns if c not in (*keys, version)])).alias("__b")
    return rows.groupBy(*keys).agg(best).select(*keys, "__b.*")


def neighbour_vote(rows: DataFrame, reach: int, weak: int) -> DataFrame:
    """For rows with fewer than `weak` cents: the most frequent other key among the rows at most `reach` places
    away (the first seen of equal ones), if it has three votes and no fewer than the row's own key."""
    w = W.partitionBy("stream_id").orderBy("frame")
    near = F.collect_list(F.struct("frame", "key")).over(w.rowsBetween(-reach, reach))
    weak_rows = rows.withColumn("near", near).where(F.col("cents") < weak)
    counts = weak_rows.select("stream_id", "frame", "key", F.explode("near").alias("o")).groupBy("stream_id", "frame", "key", F.col("o.key").alias("other")).agg(F.count("*").alias("n"), F.min("o.frame").alias("seen"))
    own = F.max(F.when(F.col("other") == F.col("key"), F.col("n")))
    best = F.max(F.when(F.col("other") != F.col("key"), F.struct("n", (-F.col("seen")).alias("first"), "other")))
    out = counts.groupBy("stream_id", "frame", "key").agg(own.alias("own"), best.alias("b"))
    return out.where("b.n >= 3 and b.n >= own").select("stream_id", "frame", "key", F.col("b.other").alias("expected"), F.col("b.n").alias("votes"), "own")


def nearest(rows: DataFrame, reach: int, k: int) -> DataFrame:
    """For rows with little confidence the k nearest confident ones by position, at most reach frames away."""
    size = 2 * reach
    s = rows.where(F.col("cents") < 49002 // 50).select("stream_id", "frame", F.explode(F.array_distinct(F.array(F.floor((F.col("frame") - reach) / size), F.floor((F.col("frame") + reach) / size)))).alias("b"))
    a = rows.where(F.col("cents") >= 49002 // 4).select(F.col("stream_id").alias("a_stream"), F.col("frame").alias("anchor"), F.floor(F.col("frame") / size).alias("a_b"))
    met = s.join(a, (F.col("stream_id") == F.col("a_stream")) & (F.col("b") == F.col("a_b")) & (F.abs(F.col("anchor") - F.col("frame")) <= reach))
    place = F.row_number().over(W.partitionBy("stream_id", "frame").orderBy(F.abs(F.col("anchor") - F.col("frame")), "anchor"))
    return met.withColumn("place", place).where(F.col("place") <= k).select("stream_id", "frame", "anchor", "place")


def fill_blanks(rows: DataFrame, reach: int) -> DataFrame:
    """Blank rows with a reading at most `reach` away: the last before if it is near, else the next after."""
    w = W.partitionBy("stream_id").orderBy("frame")
    seen = F.when(F.col("key") != "", F.struct("start_us", "key"))
    rows = rows.withColumn("back", F.last(seen, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("ahead", F.first(seen, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)))
    near_back, near_ahead = F.col("start_us") - F.col("back.start_us") <= reach, F.col("ahead.start_us") - F.col("start_us") <= reach
    restored = F.when(near_back, F.col("back.key")).when(near_ahead, F.col("ahead.key"))
    return rows.where(F.col("key") == "").select("stream_id", "frame", restored.alias("restored")).where(F.col("restored").isNotNull())
