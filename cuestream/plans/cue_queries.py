"""Queries on cues: measures, checks, export, correlation in time."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuestream.functions import text as T
from cuestream.operators import cues as C
from cuestream.operators import joins as J
from cuestream.plans.carriers import CUES, OBS, cues, observations, table

SHIFT = 300
#: The cues again, 300 ms later, without those of every fifth turn; a fourth of them repeat the text before.
SHIFTED = CUES + f""", shifted AS (SELECT stream_id, turn, start_ms + {SHIFT} AS start_ms, end_ms + {SHIFT} AS end_ms, text FROM cues WHERE (stream_id + turn) % 5 <> 0)"""


def _shifted(spark, sf_dir):
    moved = cues(spark, sf_dir).where((F.col("stream_id") + F.col("turn")) % 5 != 0)
    return moved.select("stream_id", "turn", (F.col("start_ms") + SHIFT).alias("start_ms"), (F.col("end_ms") + SHIFT).alias("end_ms"), "text")


def cue_metrics(spark, sf_dir):
    return C.metrics(cues(spark, sf_dir), "stream_id")


def segmentation_analysis(spark, sf_dir):
    """Both measures of a whole table side by side, with the warning of many short cues."""
    a, b = C.metrics(cues(spark, sf_dir)), C.metrics(_shifted(spark, sf_dir))
    a = a.select(F.lit(1).alias("k"), *[F.col(c).alias(f"current_{c}") for c in a.columns])
    b = b.select(F.lit(1).alias("k"), *[F.col(c).alias(f"candidate_{c}") for c in b.columns])
    return a.join(b, "k").drop("k").withColumn("many_short", F.col("current_under_ratio") > 0.2)


def percentile_nearest_rank(spark, sf_dir):
    return C.nearest_ranks(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", {"p50": 0.5, "p95": 0.95, "most": 1.0})


def percentile_lower_index(spark, sf_dir):
    return C.lower_index(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", {"p10": 0.1, "p90": 0.9})


def srt_timestamp(spark, sf_dir):
    c = cues(spark, sf_dir)
    return c.select("stream_id", "turn", T.stamp(F.col("start_ms") / 1000).alias("srt"), T.stamp((F.col("end_ms") + 5) / 1000, True).alias("ass"))


def srt_body(spark, sf_dir):
    return C.srt_body(cues(spark, sf_dir))


def ass_lines(spark, sf_dir):
    return C.ass_lines(cues(spark, sf_dir))


def validate_events(spark, sf_dir):
    """Rules that cues break, at 10 ms and 1 ms, in a stream of 14 seconds."""
    p = C.problems(cues(spark, sf_dir), F.lit(14_000))
    return p.where(F.col("empty") | F.col("outside") | F.col("overlapping") | F.col("vanishes"))


def pts_monotone_check(spark, sf_dir):
    """Streams in which a start does not follow the one before; the events' times, in order of arrival."""
    w = W.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(w))
    return e.groupBy(F.col("user_id").alias("stream_id")).agg(F.count("*").alias("n"), F.count_if(F.col("ts") <= F.col("before")).alias("backwards"))


def interval_end(spark, sf_dir):
    return observations(spark, sf_dir).select("stream_id", "frame", "start_us", "end_us")


def adjacent_repeats(spark, sf_dir):
    c = cues(spark, sf_dir)
    again = c.where(F.col("turn") % 4 == 0).select("stream_id", (F.col("turn") + 100).alias("turn"), (F.col("end_ms") + 50).alias("start_ms"), (F.col("end_ms") + 90).alias("end_ms"), "text")
    return C.adjacent_repeats(c.select(*again.columns).union(again))


def overlap_fragments(spark, sf_dir):
    return C.overlap_fragments(cues(spark, sf_dir), _shifted(spark, sf_dir))


def quality_report(spark, sf_dir):
    """Mean and median fragments, and cues that nothing overlaps."""
    f = overlap_fragments(spark, sf_dir)
    return f.groupBy().agg(F.count("*").alias("reference_cues"), F.round(F.avg("fragments"), 3).alias("mean_fragments"), F.median("fragments").alias("median_fragments"), F.count_if(F.col("fragments") == 0).alias("without_overlap"))


def interval_semi(spark, sf_dir):
    """Frames that begin within an excluded event of the same key: every third shipment of a supplier's part."""
    return J.within_events(_frames(spark, sf_dir), _excluded(spark, sf_dir)).select("stream_id", "frame")


def _frames(spark, sf_dir):
    return observations(spark, sf_dir).where("key <> ''").select("stream_id", "frame", "start_us", "key")


def _excluded(spark, sf_dir):
    o = observations(spark, sf_dir).where("frame % 10 = 0 and key <> ''")
    return o.select("stream_id", "key", "start_us", (F.col("start_us") + 86_400_000_000).alias("end_us"))


def _asks(spark, sf_dir):
    """A question for every order: the reading of its stream at that time."""
    o = table(spark, sf_dir, "orders")
    days = F.pmod(F.col("o_orderkey"), F.lit(30))
    first = observations(spark, sf_dir).agg(F.min("start_us").alias("first"))
    return o.select(F.col("o_orderkey").alias("ask_id"), F.col("o_custkey").alias("stream_id"), days.alias("days")).join(F.broadcast(first)).select("ask_id", "stream_id", (F.col("first") + F.col("days") * 86_400_000_000).alias("at_us"))


def asof_backward(spark, sf_dir):
    return J.as_of(_asks(spark, sf_dir), observations(spark, sf_dir).select("stream_id", "start_us", "frame", "key"), "backward")


def asof_forward(spark, sf_dir):
    return J.as_of(_asks(spark, sf_dir), observations(spark, sf_dir).select("stream_id", "start_us", "frame", "key"), "forward")


def resume_anti(spark, sf_dir):
    """Frames that are not in the cache yet."""
    o = observations(spark, sf_dir).select("stream_id", "frame")
    return J.not_cached(o, o.where("frame % 3 = 0"))


def seek_windows(spark, sf_dir):
    """Frames in windows that gaps of a day part, each to be read in one go."""
    return J.windows(observations(spark, sf_dir).select("stream_id", "frame", "start_us"), 86_400_000_000)


def cache_upsert(spark, sf_dir):
    """Rows written twice: the later of a frame stays."""
    o = observations(spark, sf_dir)
    first = o.select("stream_id", "frame", F.col("text"), F.lit(1).alias("version"))
    second = o.where("frame % 5 = 0").select("stream_id", "frame", F.concat(F.lit("v2:"), "text").alias("text"), F.lit(2).alias("version"))
    return J.keep_last(first.union(second), ["stream_id", "frame"], "version").select("stream_id", "frame", "text", "version")


def neighbour_window_vote(spark, sf_dir):
    """For rows of brief confidence the most frequent other reading within 20 rows, if it has three votes and no
    fewer than the row's own reading."""
    return J.neighbour_vote(observations(spark, sf_dir).where("key <> ''"), 20, 49002 // 20)


def nearest_anchors(spark, sf_dir):
    """For rows without confidence the two nearest confident rows of the stream's next or last hundred."""
    return J.nearest(observations(spark, sf_dir), 100, 2)


def fade_restore(spark, sf_dir):
    """Blank rows beside one with a reading, at most a day away: the last before, else the next after."""
    return J.fill_blanks(observations(spark, sf_dir), 86_400_000_000)


_MOST = {f: f"list_sort(list(l_extendedprice))[CAST(floor((count(*) - 1) * {f}) AS INTEGER) + 1]" for f in (0.1, 0.9)}
_METRICS = "count(*) AS cues, count(*) FILTER (end_ms - start_ms < 200) AS under, coalesce(count(*) FILTER (end_ms - start_ms < 200) / nullif(count(*), 0), 0.0) AS under_ratio, coalesce(median(end_ms - start_ms), 0.0) AS median_ms"


def _stamp(ms: str, scale: int) -> str:
    n = f"CAST(floor({ms} / 1000 * {scale} + 0.5) AS BIGINT)"
    whole = f"({n} // {scale})"
    hours = f"CAST({whole} // 3600 AS VARCHAR)" if scale == 100 else f"lpad(CAST({whole} // 3600 AS VARCHAR), 2, '0')"
    return f"{hours} || ':' || lpad(CAST({whole} // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({whole} % 60 AS VARCHAR), 2, '0') || '{'.' if scale == 100 else ','}' || lpad(CAST({n} % {scale} AS VARCHAR), {2 if scale == 100 else 3}, '0')"


#: Line breaks, control characters and white space of every line, as normalising treats them.
NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize({0}), '[\x00-\x09\x0b-\x1f\x7f-\x9f]', '', 'g'), ' +', ' ', 'g'), ' *\n *', chr(10), 'g'), ' ' || chr(10))"
_TEXT = NORMAL.format("text")
_ASKS = "asks AS (SELECT o_orderkey AS ask_id, o_custkey AS stream_id, (SELECT min(start_us) FROM obs) + o_orderkey % 30 * 86400000000 AS at_us FROM orders)"
_FRAGMENTS = SHIFTED + """, fragments AS (SELECT a.stream_id, a.turn, count(b.turn) AS fragments FROM cues a LEFT JOIN shifted b
  ON a.stream_id = b.stream_id AND least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) > 20 GROUP BY a.stream_id, a.turn)"""

TWINS = {
    "cue_metrics": (cue_metrics, f"WITH {CUES} SELECT stream_id, {_METRICS} FROM cues GROUP BY stream_id"),
    "segmentation_analysis": (segmentation_analysis, f"""WITH {SHIFTED}, a AS (SELECT {_METRICS} FROM cues), b AS (SELECT {_METRICS} FROM shifted)
      SELECT a.cues AS current_cues, a.under AS current_under, a.under_ratio AS current_under_ratio, a.median_ms AS current_median_ms, b.cues AS candidate_cues, b.under AS candidate_under,
        b.under_ratio AS candidate_under_ratio, b.median_ms AS candidate_median_ms, a.under_ratio > 0.2 AS many_short FROM a, b"""),
    "percentile_nearest_rank": (percentile_nearest_rank, "SELECT l_returnflag, percentile_disc(0.5) WITHIN GROUP (ORDER BY l_extendedprice) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY l_extendedprice) AS p95, max(l_extendedprice) AS most FROM lineitem GROUP BY l_returnflag"),
    "percentile_lower_index": (percentile_lower_index, f"SELECT l_suppkey, {_MOST[0.1]} AS p10, {_MOST[0.9]} AS p90 FROM lineitem GROUP BY l_suppkey"),
    "srt_timestamp": (srt_timestamp, f"WITH {CUES} SELECT stream_id, turn, {_stamp('start_ms', 1000)} AS srt, {_stamp('(end_ms + 5)', 100)} AS ass FROM cues"),
    "srt_body": (srt_body, f"""WITH {CUES}, blocks AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY start_ms, turn) || chr(10) || {_stamp('start_ms', 1000)} || ' --> ' || {_stamp('end_ms', 1000)} || chr(10) || {_TEXT} AS block FROM cues)
      SELECT stream_id, string_agg(block, chr(10) || chr(10) ORDER BY start_ms, turn) || chr(10) AS body FROM blocks GROUP BY stream_id"""),
    "ass_lines": (ass_lines, f"""WITH {CUES} SELECT stream_id, turn, 'Dialogue: 0,' || {_stamp('start_ms', 100)} || ',' || {_stamp('end_ms', 100)} || ',Default,,0,0,0,,' ||
      replace(replace(replace(replace({_TEXT}, '\\', '＼'), '{{', '｛'), '}}', '｝'), chr(10), '\\N') AS line FROM cues"""),
    "validate_events": (validate_events, f"""WITH {CUES}, p AS (SELECT stream_id, turn, length(trim(text)) = 0 AS empty, NOT (start_ms >= 0 AND start_ms < end_ms AND end_ms <= 14001) AS outside,
        coalesce(start_ms * 10 < lag(end_ms) OVER (PARTITION BY stream_id ORDER BY start_ms, turn) * 10 - 1, false) AS overlapping,
        floor(end_ms / 10 + 0.5) <= floor(start_ms / 10 + 0.5) OR end_ms <= start_ms AS vanishes FROM cues)
      SELECT * FROM p WHERE empty OR outside OR overlapping OR vanishes"""),
    "pts_monotone_check": (pts_monotone_check, """WITH e AS (SELECT user_id AS stream_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
      SELECT stream_id, count(*) AS n, count(*) FILTER (ts <= before) AS backwards FROM e GROUP BY stream_id"""),
    "interval_end": (interval_end, f"WITH {OBS} SELECT stream_id, frame, start_us, end_us FROM obs"),
    "adjacent_repeats": (adjacent_repeats, f"""WITH {CUES}, more AS (SELECT stream_id, turn, start_ms, end_ms, text FROM cues UNION ALL SELECT stream_id, turn + 100, end_ms + 50, end_ms + 90, text FROM cues WHERE turn % 4 = 0),
      beside AS (SELECT *, start_ms - lag(end_ms) OVER w AS gap_ms, lag(text) OVER w AS before FROM more WINDOW w AS (PARTITION BY stream_id ORDER BY start_ms, turn))
      SELECT stream_id, turn, gap_ms FROM beside WHERE before = text AND gap_ms BETWEEN -10 AND 120"""),
    "overlap_fragments": (overlap_fragments, f"WITH {_FRAGMENTS} SELECT * FROM fragments"),
    "quality_report": (quality_report, f"WITH {_FRAGMENTS} SELECT count(*) AS reference_cues, round(avg(fragments), 3) AS mean_fragments, median(fragments) AS median_fragments, count(*) FILTER (fragments = 0) AS without_overlap FROM fragments"),
    "interval_semi": (interval_semi, f"""WITH {OBS} SELECT f.stream_id, f.frame FROM obs f WHERE f.key <> '' AND EXISTS (SELECT 1 FROM obs e
      WHERE e.frame % 10 = 0 AND e.key <> '' AND e.stream_id = f.stream_id AND e.key = f.key AND e.start_us <= f.start_us AND f.start_us < e.start_us + 86400000000)"""),
    "asof_backward": (asof_backward, f"WITH {OBS}, {_ASKS} SELECT a.ask_id, a.stream_id, a.at_us, o.start_us, o.frame, o.key FROM asks a ASOF JOIN obs o ON a.stream_id = o.stream_id AND a.at_us >= o.start_us"),
    "asof_forward": (asof_forward, f"WITH {OBS}, {_ASKS} SELECT a.ask_id, a.stream_id, a.at_us, o.start_us, o.frame, o.key FROM asks a ASOF JOIN obs o ON a.stream_id = o.stream_id AND a.at_us <= o.start_us"),
    "resume_anti": (resume_anti, f"WITH {OBS} SELECT stream_id, frame FROM obs WHERE frame % 3 <> 0"),
    "seek_windows": (seek_windows, f"""WITH {OBS}, asked AS (SELECT *, CASE WHEN start_us - lag(start_us) OVER w <= 86400000000 THEN 0 ELSE 1 END AS new FROM obs WINDOW w AS (PARTITION BY stream_id ORDER BY start_us)),
      numbered AS (SELECT *, CAST(sum(new) OVER (PARTITION BY stream_id ORDER BY start_us ROWS UNBOUNDED PRECEDING) AS BIGINT) AS window_id FROM asked)
      SELECT stream_id, window_id, count(*) AS n, min(start_us) AS from_us, max(start_us) AS to_us FROM numbered GROUP BY stream_id, window_id"""),
    "cache_upsert": (cache_upsert, f"WITH {OBS} SELECT stream_id, frame, CASE WHEN frame % 5 = 0 THEN 'v2:' || text ELSE text END AS text, CASE WHEN frame % 5 = 0 THEN 2 ELSE 1 END AS version FROM obs"),
    "neighbour_window_vote": (neighbour_window_vote, f"""WITH {OBS}, texts AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY frame) AS nth FROM obs WHERE key <> ''),
      near AS (SELECT s.stream_id, s.frame, s.key, o.key AS other, count(*) AS n, min(o.frame) AS seen FROM texts s JOIN texts o ON s.stream_id = o.stream_id AND o.nth BETWEEN s.nth - 20 AND s.nth + 20
        WHERE s.cents < {49002 // 20} GROUP BY ALL),
      owns AS (SELECT stream_id, frame, n AS own FROM near WHERE other = key),
      best AS (SELECT *, row_number() OVER (PARTITION BY stream_id, frame ORDER BY n DESC, seen) AS place FROM near WHERE other <> key)
      SELECT b.stream_id, b.frame, b.key, b.other AS expected, b.n AS votes, o.own FROM best b JOIN owns o ON b.stream_id = o.stream_id AND b.frame = o.frame WHERE b.place = 1 AND b.n >= 3 AND b.n >= o.own"""),
    "nearest_anchors": (nearest_anchors, f"""WITH {OBS}, ranked AS (SELECT s.stream_id, s.frame, a.frame AS anchor, row_number() OVER (PARTITION BY s.stream_id, s.frame ORDER BY abs(a.frame - s.frame), a.frame) AS place
        FROM obs s JOIN obs a ON s.stream_id = a.stream_id AND s.cents < {49002 // 50} AND a.cents >= {49002 // 4} AND a.frame BETWEEN s.frame - 100 AND s.frame + 100)
      SELECT stream_id, frame, anchor, place FROM ranked WHERE place <= 2"""),
    "fade_restore": (fade_restore, f"""WITH {OBS}, beside AS (SELECT stream_id, frame, key, start_us,
        last_value(CASE WHEN key <> '' THEN (start_us, key) END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS back,
        first_value(CASE WHEN key <> '' THEN (start_us, key) END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead FROM obs)
      SELECT stream_id, frame, CASE WHEN start_us - back[1] <= 86400000000 THEN back[2] WHEN ahead[1] - start_us <= 86400000000 THEN ahead[2] END AS restored FROM beside
      WHERE key = '' AND (start_us - back[1] <= 86400000000 OR ahead[1] - start_us <= 86400000000)"""),
}
