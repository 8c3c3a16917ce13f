"""Queries that work through streams in order, and streaming ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cuestream.functions import readings as R
from cuestream.operators import alignment, layout, masks, repairs, segment, tracks
from cuestream.plans.carriers import OBS, cues, observations, table
from cuestream.plans.cue_queries import SHIFTED, _shifted
from cuestream.plans.job_queries import worker_events
from cuestream.plans.run_queries import RUNS
from cuestream.sources import subtitles
from cuestream.streaming import folds

FRAME_S = 0.04


def _timed(spark, sf_dir):
    """Observations at 25 frames a second, with one box for a reading; weak ones read a letter less."""
    o = observations(spark, sf_dir)
    weak = (F.col("cents") % 7 == 0) & (F.length("key") > 4)
    text = F.when(weak, F.expr("substring(key, 1, length(key) - 1)")).otherwise(F.col("text"))
    numbers = {"x": F.lit(0.2), "y": F.lit(0.5), "w": F.lit(0.6), "h": 0.2 + (F.col("frame") % 3) / 1000}
    box = F.struct(*[v.cast("double").alias(k) for k, v in numbers.items()])
    line = F.struct(box.alias("box"), F.array(F.struct(text.alias("text"), F.col("confidence"))).alias("candidates"))
    return o.select("stream_id", "frame", (F.col("frame") * FRAME_S).alias("start"), ((F.col("frame") + 1) * FRAME_S).alias("end"), text.alias("text"), "confidence", F.when(text == "", F.array()).otherwise(F.array(line)).alias("lines"))


def segment_full(spark, sf_dir):
    return segment.segment(_timed(spark, sf_dir)).select("stream_id", "id", "start", "end", "text", "confidence", "frames", "agreement", "first_frame", "last_frame", F.array_join("flags", ",").alias("flags"))


def shadow_segments(spark, sf_dir):
    return segment.shadow(_timed(spark, sf_dir))


def _cue_seconds(df):
    return df.select("stream_id", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text")


def align_pairs(spark, sf_dir):
    return alignment.aligned(_cue_seconds(cues(spark, sf_dir)), _cue_seconds(_shifted(spark, sf_dir)))


def align_report(spark, sf_dir):
    return alignment.report(align_pairs(spark, sf_dir), "stream_id")


def region_calibration(spark, sf_dir):
    """Twelve frames of each stream, evenly spaced, clustered by height."""
    from pyspark.sql import Window as W

    o = _timed(spark, sf_dir).withColumn("n", F.count("*").over(W.partitionBy("stream_id")))
    o = o.where(F.floor(F.col("frame") * 12 / F.col("n")) != F.floor((F.col("frame") - 1) * 12 / F.col("n")))
    lines = o.where("text <> ''").select("stream_id", F.col("start").alias("t"), "text", ((F.col("frame") % 4) * 0.1 + 0.5).alias("y"), F.lit(0.05).alias("h"))
    c = tracks.calibrate(lines)
    return c.select("stream_id", "place", "unique_texts", "coverage", *[F.round(x, 6).alias(x) for x in ("top", "bottom", "font_height", "score")])


def observed_layout(spark, sf_dir):
    """The layout of each hundred frames."""
    seen = layout.observed_layout(_timed(spark, sf_dir).withColumn("part", F.floor(F.col("frame") / 100)), "stream_id", "part")
    return seen.select("stream_id", "part", *[F.round(c, 6).alias(c) for c in ("center_x", "bottom_y", "glyph_height")])


def fragment_prune(spark, sf_dir):
    """Frames with a small letter beside the line: it is dropped."""
    o = _timed(spark, sf_dir).where("text <> ''")
    at = lambda x, y, w, h: F.struct(*[F.lit(v).cast("double").alias(k) for k, v in zip("xywh", (x, y, w, h), strict=True)])
    bit = F.struct(at(0.3, 0.55, 0.02, 0.05).alias("box"), F.array(F.struct(F.lit("i").alias("text"), F.lit(0.9).alias("confidence"))).alias("candidates"))
    return o.select("stream_id", "frame", F.size(layout.drop_fragments(F.when(F.col("frame") % 2 == 0, F.concat("lines", F.array(bit))).otherwise(F.col("lines")))).alias("lines"))


def cache_read(spark, sf_dir):
    """The recogniser's JSON of each frame read back as text and confidence."""
    o = _timed(spark, sf_dir)
    data = F.to_json(F.struct("lines"))
    return subtitles.read_cache(o.select("stream_id", F.col("frame").alias("idx"), F.col("start").alias("t"), "end", data.alias("data"))).select("stream_id", "frame", "start", "end", "text", "confidence")


def mask_tests(spark, sf_dir):
    """Neighbouring vectors as masks of one row: which tests they pass. Masks of one width are tested as a stack."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id").where(F.size("embedding") == F.size("next"))
    tests = {"compatible": masks.compatible, "changed": masks.changed, "similar": masks.similar, "over_gap": masks.similar_over_gap}

    def run(batches):
        for pdf in batches:
            for width, part in pdf.groupby(pdf["embedding"].map(len)):
                a, b = (np.stack(part[c].to_numpy()).reshape(len(part), 1, width) > 0 for c in ("embedding", "next"))
                yield pd.DataFrame({"vec_id": part["vec_id"], **{name: test(a, b) for name, test in tests.items()}, "density": masks.density(a, (0, 0, 1, 1))})

    schema = "vec_id long, compatible boolean, changed boolean, similar boolean, over_gap boolean, density double"
    return pairs.mapInPandas(run, schema).withColumn("density", F.round("density", 6))


def unstable_frames(spark, sf_dir):
    """Frames to be read again: of brief runs that are blank between equal readings or beside a related one."""
    return repairs.unstable_candidates(repairs.prepared(_timed(spark, sf_dir)))


def streaming_event_fold(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern may match a file or a folder
    return folds.drain(folds.fold_events(worker_events(stream)), "complete")


def streaming_runs(spark, sf_dir):
    """Runs of the readings as a stream, with a mark at each stream's end."""
    rows = observations(spark, sf_dir).select("stream_id", "frame", "start_us", "end_us", "text")
    ends = rows.groupBy("stream_id").agg(F.max("frame").alias("frame"), (F.max("start_us") + 1).alias("start_us"), F.max("end_us").alias("end_us"), F.lit(None).cast("string").alias("text"))
    folder = folds._shared(spark)
    rows.union(ends).write.parquet(folder)
    return folds.drain(folds.encode_runs(spark.readStream.schema(rows.schema).parquet(folder)), "append").where("not refused").drop("refused")


from cuestream.plans.job_queries import TWINS as _JOBS  # noqa: E402  the batch twin of the streaming fold

#: Readings at 25 frames a second, as _timed has them; full is the reading before weak ones lose a letter.
TIMED = OBS + f""", timed AS (SELECT stream_id, frame, frame * CAST({FRAME_S} AS DOUBLE) AS start, (frame + 1) * CAST({FRAME_S} AS DOUBLE) AS ends, key AS full_key, CAST(confidence AS DOUBLE) AS confidence,
    CASE WHEN cents % 7 = 0 AND length(key) > 4 THEN substr(key, 1, length(key) - 1) ELSE text END AS text, CAST(0.2 AS DOUBLE) + CAST(frame % 3 AS DOUBLE) / 1000 AS h FROM obs)"""
_KINDS = ("click", "view", "signup", "purchase", "error")
_SAID = [*_KINDS, *(k[:-1] for k in _KINDS if len(k) > 4)]
#: Which of the carrier's few readings are related is a matter of their letters, not of the rows.
_RELATED = ", ".join(f"('{a}', '{b}')" for a in _SAID for b in _SAID if R.related(a, b))
_NEAR = "".join(f", lag(key, {k}) OVER w AS b{k}, lead(key, {k}) OVER w AS a{k}" for k in (1, 2))
_COUNT = lambda test: f"CAST(list_sum(list_transform(p, lambda x: CAST({test} AS INTEGER))) AS BIGINT)"
_TILE = lambda size: f"list_max(list_transform(range(0, len(p), {size}), lambda i: list_sum(list_transform(p[i + 1:i + {size}], lambda x: CAST(x[1] <> x[2] AS INTEGER)))))"
_PAIRS = SHIFTED + r""", a AS (SELECT stream_id, turn, start_ms, end_ms, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) AS key, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY start_ms, end_ms, text) - 1 AS INTEGER) AS nth FROM cues),
  b AS (SELECT stream_id, turn, start_ms, end_ms, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) AS key, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY start_ms, end_ms, text) - 1 AS INTEGER) AS nth FROM shifted),
  pairs AS (SELECT coalesce(a.stream_id, b.stream_id) AS stream_id, a.nth AS reference_index, b.nth AS output_index, CAST(CASE WHEN b.nth IS NULL THEN length(a.key) WHEN a.nth IS NULL THEN length(b.key) ELSE 0 END AS INTEGER) AS edits, CAST(coalesce(length(a.key), 0) AS INTEGER) AS reference_chars,
    a.nth IS NOT NULL AND b.nth IS NOT NULL AS exact, round((b.start_ms - a.start_ms) / 1000, 6) AS start_delta, round((b.end_ms - a.end_ms) / 1000, 6) AS end_delta FROM a FULL JOIN b ON a.stream_id = b.stream_id AND a.turn = b.turn)"""

TWINS = {
    "segment_full": (segment_full, None),
    "shadow_segments": (shadow_segments, f"""WITH {TIMED}, texts AS (SELECT *, CASE WHEN full_key = lag(full_key) OVER w AND start - lag(ends) OVER w <= 0.12 + 1e-9 THEN 0 ELSE 1 END AS new FROM timed WHERE trim(text) <> '' WINDOW w AS (PARTITION BY stream_id ORDER BY frame)),
      parted AS (SELECT *, CAST(sum(new) OVER (PARTITION BY stream_id ORDER BY frame) AS BIGINT) AS part FROM texts), counts AS (SELECT stream_id, part, text, count(*) AS n, min(frame) AS since FROM parted GROUP BY ALL),
      modes AS (SELECT *, row_number() OVER (PARTITION BY stream_id, part ORDER BY n DESC, since) AS place FROM counts)
      SELECT p.stream_id, min(p.start) AS start, max(p.ends) AS "end", min(p.frame) AS first_frame, max(p.frame) AS last_frame, min(m.text) AS text, count(*) AS frames, min(m.n) / count(*) AS agreement, count(DISTINCT trim(p.text)) > 1 AS merged_different_readings
      FROM parted p JOIN modes m ON p.stream_id = m.stream_id AND p.part = m.part AND m.place = 1 GROUP BY p.stream_id, p.part"""),
    "align_pairs": (align_pairs, f"WITH {_PAIRS} SELECT * FROM pairs"),
    "align_report": (align_report, f"""WITH {_PAIRS}, counts AS (SELECT stream_id, count(reference_index) AS reference_cues, count(output_index) AS output_cues, count(*) FILTER (exact) AS exact_cues, count(*) FILTER (output_index IS NULL) AS missing, count(*) FILTER (reference_index IS NULL) AS extra,
        count(*) FILTER (reference_index IS NOT NULL AND output_index IS NOT NULL) AS matched, round(sum(edits) / greatest(1, sum(reference_chars)), 6) AS character_error_rate FROM pairs GROUP BY stream_id),
      errors AS (SELECT stream_id, unnest([abs(start_delta), abs(end_delta)]) AS error FROM pairs WHERE exact),
      spread AS (SELECT stream_id, percentile_disc(0.5) WITHIN GROUP (ORDER BY error) AS boundary_p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY error) AS boundary_p95, max(error) AS boundary_max FROM errors GROUP BY stream_id)
      SELECT c.*, s.boundary_p50, s.boundary_p95, s.boundary_max FROM counts c LEFT JOIN spread s ON c.stream_id = s.stream_id"""),
    "region_calibration": (region_calibration, f"""WITH {TIMED}, counted AS (SELECT *, count(*) OVER (PARTITION BY stream_id) AS n FROM timed), drawn AS (SELECT *, CAST(frame % 4 AS DOUBLE) * 0.1 + 0.5 AS y FROM counted WHERE floor(CAST(frame * 12 AS DOUBLE) / n) <> floor(CAST((frame - 1) * 12 AS DOUBLE) / n) AND text <> ''),
      grouped AS (SELECT stream_id, y, count(DISTINCT trim(text)) AS u, count(DISTINCT start) AS c, count(*) FILTER (length(trim(text)) >= 3) AS long FROM drawn GROUP BY stream_id, y)
      SELECT stream_id, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY u * c DESC, y) - 1 AS INTEGER) AS place, CAST(u AS INTEGER) AS unique_texts, CAST(c AS INTEGER) AS coverage, round(greatest(0.0, y - 0.025), 6) AS top, round(least(1.0, y + 0.075), 6) AS bottom,
        CASE WHEN long >= 4 THEN 0.05 END AS font_height, round(u * c * sqrt(0.05), 6) AS score FROM grouped"""),
    "observed_layout": (observed_layout, f"""WITH {TIMED} SELECT stream_id, frame // 100 AS part, 0.5 AS center_x, round(median(0.5 + h), 6) AS bottom_y, round(median(h), 6) AS glyph_height FROM timed WHERE confidence >= 0.5 AND text <> '' GROUP BY stream_id, frame // 100"""),
    "fragment_prune": (fragment_prune, f"WITH {TIMED} SELECT stream_id, frame, CAST(CASE WHEN frame % 2 = 0 AND length(trim(text)) < 3 THEN 2 ELSE 1 END AS INTEGER) AS lines FROM timed WHERE text <> ''"),
    "cache_read": (cache_read, f"WITH {TIMED} SELECT stream_id, frame, start, ends AS \"end\", CASE WHEN confidence >= 0.5 THEN trim(text) ELSE '' END AS text, CASE WHEN confidence >= 0.5 AND text <> '' THEN confidence ELSE 0.0 END AS confidence FROM timed"),
    "mask_tests": (mask_tests, f"""WITH p AS (SELECT a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda x: [x[1] > 0, x[2] > 0]) AS p FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND len(a.embedding) = len(b.embedding)),
      c AS (SELECT vec_id, len(p) AS n, {_COUNT('x[1] OR x[2]')} AS u, {_COUNT('x[1] <> x[2]')} AS d, {_COUNT('x[1]')} AS own, {_TILE(16)} AS t16, {_TILE(48)} AS t48, list_transform(range(0, len(p), 16), lambda i: list_sum(list_transform(p[i + 1:i + 16], lambda x: CAST(x[1] <> x[2] AS INTEGER)))) AS tiles FROM p)
      SELECT vec_id, u >= 20 AND d <= greatest(2, u * 0.035) AND t16 <= 5 AS compatible, d > greatest(4, u * 0.08) OR t48 > 18 AS changed, u >= 20 AND d <= u * 0.045 AND t16 <= 5 AS similar,
        (u >= 20 AND d <= u * 0.045 AND t16 <= 5) OR (u >= 100 AND d <= u * 0.03 AND t16 <= 12 AND len(list_filter(tiles, lambda t: t > 5)) <= 2) AS over_gap, round(own / n, 6) AS density FROM c"""),
    "unstable_frames": (unstable_frames, f"""WITH {TIMED}, related(a, b) AS (VALUES {_RELATED}), marked AS (SELECT *, CAST(sum(change) OVER (PARTITION BY stream_id ORDER BY frame) AS BIGINT) AS run_id FROM (SELECT *, trim(text) AS key, CASE WHEN trim(text) <> lag(trim(text)) OVER (PARTITION BY stream_id ORDER BY frame) THEN 1 ELSE 0 END AS change FROM timed)),
      runs AS (SELECT stream_id, run_id, min(key) AS key, min(start) AS start, max(ends) AS ends FROM marked GROUP BY stream_id, run_id), beside AS (SELECT *{_NEAR} FROM runs WINDOW w AS (PARTITION BY stream_id ORDER BY run_id)),
      found AS (SELECT * FROM beside r WHERE ends - start <= 0.60 AND ((key = '' AND b1 <> '' AND b1 = a1) OR EXISTS (SELECT 1 FROM related x WHERE x.a = r.key AND x.b IN (r.b1, r.b2, r.a1, r.a2))))
      SELECT m.stream_id, m.frame FROM marked m JOIN found f ON m.stream_id = f.stream_id AND m.run_id = f.run_id"""),
    "streaming_event_fold": (streaming_event_fold, _JOBS["worker_event_fold"][1]),
    "streaming_runs": (streaming_runs, f"WITH {RUNS} SELECT stream_id, key, n, first_frame, last_frame, start_us, end_us FROM runs"),
}
