"""Queries on runs and events."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuestream.functions import text as T
from cuestream.operators import repairs, runs
from cuestream.plans.carriers import OBS, observations

HOUR = 3600 * runs.SECOND
#: The carrier's gaps are hours, so the limits of time are scaled.
SCALED = runs.LIMITS | {"very_short": 2 * HOUR, "very_long": 48 * HOUR, "least_duration": 1}

RUNS = OBS + """, changed AS (
  SELECT *, CASE WHEN key <> lag(key) OVER (PARTITION BY stream_id ORDER BY frame) THEN 1 ELSE 0 END AS change FROM obs
), marked AS (
  SELECT *, CAST(sum(change) OVER (PARTITION BY stream_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM changed
), runs AS (
  SELECT stream_id, run_id, min(key) AS key, count(*) AS n, min(frame) AS first_frame, max(frame) AS last_frame,
    min(start_us) AS start_us, max(end_us) AS end_us
  FROM marked GROUP BY stream_id, run_id
)"""

EVENTS = RUNS + """, counted AS (
  SELECT stream_id, run_id, text, count(*) AS n, min(frame) AS seen FROM marked WHERE key <> '' GROUP BY ALL
), voted AS (
  SELECT *, row_number() OVER (PARTITION BY stream_id, run_id ORDER BY n DESC, seen) AS place,
    count(*) OVER (PARTITION BY stream_id, run_id) AS n_variants FROM counted
), best AS (
  SELECT m.stream_id, m.run_id, v.text, v.n AS matching, v.n_variants, CAST(sum(m.cents) AS BIGINT) AS cents,
    arg_min(m.start_us, (-m.cents, abs(r.start_us + r.end_us - 2 * m.start_us), m.frame)) AS evidence_us
  FROM marked m JOIN voted v ON m.stream_id = v.stream_id AND m.run_id = v.run_id AND m.text = v.text AND v.place = 1
    JOIN runs r ON m.stream_id = r.stream_id AND m.run_id = r.run_id
  GROUP BY ALL
), events_out AS (
  SELECT r.stream_id, row_number() OVER (PARTITION BY r.stream_id ORDER BY r.run_id) AS id, r.start_us, r.end_us, b.text,
    round(b.cents / b.matching / 49002, 4) AS confidence, r.n AS frames, round(b.matching / r.n, 4) AS agreement,
    b.evidence_us, r.first_frame, r.last_frame, b.n_variants
  FROM runs r JOIN best b ON r.stream_id = b.stream_id AND r.run_id = b.run_id WHERE r.key <> ''
)"""

FLAGS = EVENTS + f""", flagged AS (
  SELECT stream_id, id, list_filter([
    CASE WHEN frames < 3 THEN 'few_frames' END,
    CASE WHEN length(trim(text)) / (greatest(end_us - start_us, 1) / 1000000) > 35 THEN 'high_reading_speed' END,
    CASE WHEN confidence < 0.8 THEN 'low_confidence' END,
    CASE WHEN len(string_split(text, chr(10))) > 3 THEN 'many_lines' END,
    CASE WHEN end_us - start_us > {48 * HOUR} THEN 'very_long' END,
    CASE WHEN end_us - start_us < {2 * HOUR} THEN 'very_short' END], lambda x: x IS NOT NULL) AS flags
  FROM events_out
)"""


def runs_encode(spark, sf_dir):
    return runs.encode_runs(observations(spark, sf_dir))


def run_events(spark, sf_dir):
    return runs.emit_events(observations(spark, sf_dir))


def _flagged(spark, sf_dir):
    events = run_events(spark, sf_dir)
    return events.select("stream_id", "id", runs.flags(F.col("confidence"), F.col("end_us") - F.col("start_us"), F.col("text"), F.col("frames"), SCALED).alias("flags"))


def event_flags(spark, sf_dir):
    return _flagged(spark, sf_dir).select("stream_id", "id", F.array_join("flags", ",").alias("flags"))


def flag_counts(spark, sf_dir):
    return _flagged(spark, sf_dir).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def diagnostics_report(spark, sf_dir):
    """One line for each flagged event."""
    line = F.format_string("%d/%d: %s", "stream_id", "id", F.array_join("flags", ", "))
    return _flagged(spark, sf_dir).where(F.size("flags") > 0).select("stream_id", "id", line.alias("line"))


def aba_candidates(spark, sf_dir):
    return runs.aba(runs_encode(spark, sf_dir), 24 * HOUR).select("stream_id", "run_id", "key", "before", "n", "first_frame", "last_frame")


def coalesce_equal_runs(spark, sf_dir):
    """Runs between two of another key take that key, as after a repair, and are coalesced."""
    encoded = runs_encode(spark, sf_dir)
    repaired = runs.aba(encoded, 24 * HOUR).select("stream_id", "run_id", F.col("before").alias("repaired"))
    joined = encoded.join(repaired, ["stream_id", "run_id"], "left").withColumn("key", F.coalesce("repaired", "key")).drop("repaired")
    return runs.coalesce_equal(joined)


def compact_fragments(spark, sf_dir):
    return runs.identical_fragments(runs_encode(spark, sf_dir), 12 * HOUR)


def few_glyph_suspects(spark, sf_dir):
    """Events of one frame, short, with few letters and low confidence: their glyphs are to be checked."""
    events = run_events(spark, sf_dir)
    letters = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    return events.where((F.col("frames") == 1) & (F.col("end_us") - F.col("start_us") < 6 * HOUR) & (letters <= 5) & (F.col("confidence") < 0.72)).select("stream_id", "id", "text", "confidence")


def stable_group_sampling(spark, sf_dir):
    """Of each run the first, middle and last observation; if all three are confident enough, the best
    stands for the run."""
    marked = runs.with_run_id(observations(spark, sf_dir)).where("key <> ''")
    w = W.partitionBy("stream_id", "run_id")
    marked = marked.withColumn("n", F.count("*").over(w)).withColumn("at", F.row_number().over(w.orderBy("frame")) - 1)
    drawn = marked.where((F.col("at") == 0) | (F.col("at") == F.floor(F.col("n") / 2)) | (F.col("at") == F.col("n") - 1))
    best = F.min(F.struct((-F.col("cents")).alias("c"), F.col("frame"))).alias("b")
    out = drawn.groupBy("stream_id", "run_id").agg(F.count("*").alias("sampled"), F.min("cents").alias("least"), best, F.max("n").alias("n"))
    return out.select("stream_id", "run_id", "n", "sampled", F.when(F.col("least") >= 0.3 * 49002, F.col("b.frame")).alias("stands_for_all"))


def spelling_groups(spark, sf_dir):
    """Runs of equal letters, whatever their spaces, that have several spellings: rows not spelled like the mode, where that has
    three rows at least, are to be repaired."""
    o = observations(spark, sf_dir)
    spaced = F.when(F.col("frame") % 5 == 0, F.concat(F.substring("text", 1, 2), F.lit(" "), F.expr("substring(text, 3)"))).otherwise(F.col("text"))
    said = o.select("stream_id", "frame", F.when(F.col("text") == "", "").otherwise(spaced).alias("text"), "confidence")
    return repairs.spacing_targets(said.withColumn("key", T.key(F.col("text")))).select("stream_id", "frame", "text", "spelling")


TWINS = {
    "runs_encode": (runs_encode, f"WITH {RUNS} SELECT * FROM runs"),
    "run_events": (run_events, f"WITH {EVENTS} SELECT * FROM events_out"),
    "event_flags": (event_flags, f"WITH {FLAGS} SELECT stream_id, id, array_to_string(flags, ',') AS flags FROM flagged"),
    "flag_counts": (flag_counts, f"WITH {FLAGS}, each_one AS (SELECT unnest(flags) AS flag FROM flagged) SELECT flag, count(*) AS n FROM each_one GROUP BY flag"),
    "diagnostics_report": (diagnostics_report, f"WITH {FLAGS} SELECT stream_id, id, stream_id || '/' || id || ': ' || array_to_string(flags, ', ') AS line FROM flagged WHERE len(flags) > 0"),
    "aba_candidates": (aba_candidates, f"""WITH {RUNS}, beside AS (SELECT *, lag(key) OVER w AS before, lead(key) OVER w AS after FROM runs WINDOW w AS (PARTITION BY stream_id ORDER BY run_id))
      SELECT stream_id, run_id, key, before, n, first_frame, last_frame FROM beside
      WHERE before = after AND before <> key AND before <> '' AND end_us - start_us <= {24 * HOUR}"""),
    "coalesce_equal_runs": (coalesce_equal_runs, f"""WITH {RUNS}, beside AS (SELECT *, lag(key) OVER w AS before, lead(key) OVER w AS after FROM runs WINDOW w AS (PARTITION BY stream_id ORDER BY run_id)),
      repaired AS (SELECT * REPLACE (CASE WHEN before = after AND before <> key AND before <> '' AND end_us - start_us <= {24 * HOUR} THEN before ELSE key END AS key) FROM beside),
      again AS (SELECT *, CASE WHEN key <> lag(key) OVER (PARTITION BY stream_id ORDER BY first_frame) THEN 1 ELSE 0 END AS change FROM repaired),
      numbered AS (SELECT * EXCLUDE (run_id), CAST(sum(change) OVER (PARTITION BY stream_id ORDER BY first_frame ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM again)
      SELECT stream_id, run_id, min(key) AS key, CAST(sum(n) AS BIGINT) AS n, min(first_frame) AS first_frame, max(last_frame) AS last_frame, min(start_us) AS start_us, max(end_us) AS end_us
      FROM numbered GROUP BY stream_id, run_id"""),
    "compact_fragments": (compact_fragments, f"""WITH {RUNS}, texts AS (SELECT *, CASE WHEN lag(key) OVER w = key AND start_us - lag(end_us) OVER w BETWEEN 0 AND {12 * HOUR} THEN 0 ELSE 1 END AS new
        FROM runs WHERE key <> '' WINDOW w AS (PARTITION BY stream_id ORDER BY run_id)),
      numbered AS (SELECT *, CAST(sum(new) OVER (PARTITION BY stream_id ORDER BY run_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fragment FROM texts)
      SELECT stream_id, fragment, key, CAST(sum(n) AS BIGINT) AS n, count(*) AS parts, min(start_us) AS start_us, max(end_us) AS end_us FROM numbered GROUP BY stream_id, fragment, key"""),
    "few_glyph_suspects": (few_glyph_suspects, f"""WITH {EVENTS} SELECT stream_id, id, text, confidence FROM events_out
      WHERE frames = 1 AND end_us - start_us < {6 * HOUR} AND length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) <= 5 AND confidence < 0.72"""),
    "stable_group_sampling": (stable_group_sampling, f"""WITH {RUNS}, placed AS (SELECT *, count(*) OVER (PARTITION BY stream_id, run_id) AS n, row_number() OVER (PARTITION BY stream_id, run_id ORDER BY frame) - 1 AS nth FROM marked WHERE key <> '')
      SELECT stream_id, run_id, max(n) AS n, count(*) AS sampled, CASE WHEN min(cents) >= 0.3 * 49002 THEN arg_min(frame, (-cents, frame)) END AS stands_for_all
      FROM placed WHERE nth = 0 OR nth = n // 2 OR nth = n - 1 GROUP BY stream_id, run_id"""),
    "spelling_groups": (spelling_groups, f"""WITH {OBS}, said AS (SELECT stream_id, frame, CASE WHEN text = '' THEN '' WHEN frame % 5 = 0 THEN substr(text, 1, 2) || ' ' || substr(text, 3) ELSE text END AS text, replace(key, ' ', '') AS compact FROM obs),
      parted AS (SELECT *, CAST(sum(change) OVER (PARTITION BY stream_id ORDER BY frame) AS BIGINT) AS part FROM (SELECT *, CASE WHEN compact <> lag(compact) OVER (PARTITION BY stream_id ORDER BY frame) THEN 1 ELSE 0 END AS change FROM said)),
      counts AS (SELECT stream_id, part, text, count(*) AS n, min(frame) AS since FROM parted WHERE compact <> '' GROUP BY ALL),
      modes AS (SELECT *, row_number() OVER (PARTITION BY stream_id, part ORDER BY n DESC, since) AS place, count(*) OVER (PARTITION BY stream_id, part) AS spellings FROM counts)
      SELECT p.stream_id, p.frame, p.text, m.text AS spelling FROM parted p JOIN modes m ON p.stream_id = m.stream_id AND p.part = m.part AND m.place = 1 AND m.spellings >= 2 AND m.n >= 3 WHERE p.text <> m.text"""),
}
