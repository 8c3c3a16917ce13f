"""Queries on repairs that evidence decides, over scenes played at 25 frames a second."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import functions as F

from cuestream.operators import evidence as E
from cuestream.operators import repairs as P
from cuestream.plans.carriers import table

FRAME_S, SCENE_FRAMES, SCENES = 0.04, 50, 16
HEIGHT, WIDTH = 48, 160

#: The scenes: scene, first and last frame in it, up to two lines (reading, confidence), the mask that the frames show (0: none),
#: and what a second reader says. A line under 0.5 is no text.
SCRIPT = (
    (0, 0, 3, "a held line of words", 0.9, None, None, 1, None), (0, 4, 11, "a held line of words", 0.35, None, None, 1, None), (0, 12, 15, "a held line of words", 0.9, None, None, 1, None),
    (1, 0, 3, "a line held no more", 0.9, None, None, 1, None), (1, 4, 11, "a line held no more", 0.35, None, None, 2, None), (1, 12, 15, "a line held no more", 0.9, None, None, 1, None),
    (2, 0, 9, "the caption stays here", 0.9, None, None, 3, None), (2, 10, 11, "the caption stays hers", 0.6, None, None, 3, None), (2, 12, 20, "the caption stays here", 0.8, None, None, 3, None),
    (3, 0, 9, "the caption goes away", 0.9, None, None, 3, None), (3, 10, 11, "the caption goes awry", 0.6, None, None, 4, None), (3, 12, 20, "the caption goes away", 0.8, None, None, 3, None),
    (4, 0, 9, "several slips in a row", 0.9, None, None, 5, None), (4, 10, 10, "several slips in a raw", 0.9, None, None, 5, None), (4, 11, 11, "several slips in o row", 0.9, None, None, 5, None), (4, 12, 20, "several slips in a row", 0.9, None, None, 5, None),
    (5, 0, 9, "blank in the middle", 0.9, None, None, 6, None), (5, 10, 14, None, None, None, None, 6, None), (5, 15, 24, "blank in the middle", 0.95, None, None, 6, None),
    (6, 0, 7, "recurrent reading one", 0.9, None, None, 7, None), (6, 8, 10, "recurrent readimg one", 0.9, None, None, 7, None), (6, 11, 13, "recurrent reading one", 0.9, None, None, 7, None), (6, 14, 24, "recurrent readimg one", 0.9, None, None, 7, None),
    (7, 0, 1, "held variant of line", 0.9, None, None, 8, "held variant of line"), (7, 2, 2, "held variant of lime", 0.4, None, None, 8, "held variant of line"), (7, 3, 4, "held variant of line", 0.9, None, None, 8, "held variant of line"),
    (7, 5, 5, "held variant of lime", 0.4, None, None, 8, "held variant of line"), (7, 6, 7, "held variant of line", 0.9, None, None, 8, "held variant of line"), (7, 8, 9, "held variant of lime", 0.6, None, None, 8, "held variant of line"),
    (8, 0, 4, "upper line of the twa", 0.9, "lower line of the two", 0.9, 9, None), (8, 5, 24, "upper line of the two", 0.9, "lower line of the two", 0.9, 9, None),
    (9, 0, 4, "นีคือข้อความทดสอบ", 0.9, None, None, 10, None), (9, 5, 20, "นี่คือข้อความทดสอบ", 0.9, None, None, 10, None),
    (10, 6, 9, None, None, None, None, 11, None), (10, 10, 11, "flash caption", 0.9, None, None, 11, None), (10, 12, 16, None, None, None, None, 11, None),
    (11, 0, 3, "first speaker says", 0.9, "second speaker says", 0.8, 12, None), (11, 4, 5, "first speaker says", 0.9, None, None, 12, "second speaker says"), (11, 6, 9, "first speaker says", 0.9, "second speaker says", 0.8, 12, None),
    (12, 0, 3, "steady upper line", 0.9, "steady lower line", 0.9, 13, None), (12, 4, 7, "steady upper line", 0.9, "steady lower line", 0.35, 13, None), (12, 8, 11, "steady upper line", 0.9, "steady lower line", 0.9, 13, None),
    (13, 0, 9, "a reader knows better", 0.9, None, None, 3, None), (13, 10, 11, "a reader knows butter", 0.6, None, None, 4, "a reader knows better"), (13, 12, 20, "a reader knows better", 0.8, None, None, 3, None),
    (14, 0, 6, "spaced words here", 0.9, None, None, 14, None), (14, 7, 9, "spacedwords here", 0.9, None, None, 14, None), (14, 10, 12, "spaced words here", 0.8, None, None, 14, None),
    (15, 0, 4, "upper line of a scene", 0.9, "lower line of a scane", 0.9, 9, None), (15, 5, 12, "upper line of a scene", 0.9, "lower line of a scene", 0.9, 1, None),
)
COLUMNS = "scene int, first int, last int, l1 string, c1 double, l2 string, c2 double, mask int, second string"
#: Frames that a task draws, about.
TASK_FRAMES = 100_000


def _played(spark, sf_dir):
    """A scene for every fifty frames of a stream, in turns."""
    events = table(spark, sf_dir, "events")
    # Frames are drawn from counts, whose few bytes Spark would leave to one task or a few: tasks go by the frames.
    counted = events.groupBy(F.col("user_id").alias("stream_id")).agg(F.count("*").alias("n")).repartition(events.count() // TASK_FRAMES + 1, "stream_id")
    frames = counted.select("stream_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("frame")).select("stream_id", F.col("frame").cast("long").alias("frame"))
    at = frames.withColumn("p", F.col("frame") % SCENE_FRAMES).withColumn("at", F.pmod(F.col("stream_id") + F.floor(F.col("frame") / SCENE_FRAMES) * 7, F.lit(SCENES)))
    script = spark.createDataFrame(list(SCRIPT), COLUMNS)
    met = at.join(F.broadcast(script), (F.col("at") == F.col("scene")) & F.col("p").between(F.col("first"), F.col("last")), "left")
    return met.select("stream_id", "frame", "l1", "c1", "l2", "c2", F.coalesce("mask", F.lit(0)).alias("mask"), "second")


def _line(text, confidence, y: float):
    box = F.struct(*[F.lit(v).alias(k) for k, v in (("x", 0.2), ("y", y), ("w", 0.6), ("h", 0.2))])
    return F.struct(box.alias("box"), F.array(F.struct(F.col(text).alias("text"), F.col(confidence).alias("confidence"))).alias("candidates"))


def _rows(spark, sf_dir):
    up, low = F.coalesce(F.col("c1") >= P.ACCEPTED, F.lit(False)), F.coalesce(F.col("c2") >= P.ACCEPTED, F.lit(False))
    lines = F.filter(F.array(F.when(F.col("l1").isNotNull(), _line("l1", "c1", 0.25)), F.when(F.col("l2").isNotNull(), _line("l2", "c2", 0.6))), lambda x: x.isNotNull())
    text = F.concat_ws("\n", F.when(up, F.col("l1")), F.when(low, F.col("l2")))
    least = F.coalesce(F.least(F.when(up, F.col("c1")), F.when(low, F.col("c2"))), F.lit(0.0))
    return _played(spark, sf_dir).select("stream_id", "frame", (F.col("frame") * FRAME_S).alias("start"), ((F.col("frame") + 1) * FRAME_S).alias("end"), text.alias("text"), least.alias("confidence"), lines.alias("lines"))


@cache
def picture(mask: int) -> dict:
    """The pixels that stand for a caption: noise of its own, where lines are."""
    shown = np.random.default_rng(mask).random((HEIGHT, WIDTH)) < 0.5
    shown[: HEIGHT // 5], shown[:, : WIDTH // 6] = False, False
    return E.packed(shown if mask else np.zeros((HEIGHT, WIDTH), bool))


def _masks(spark, sf_dir):
    """The few pictures are joined to their frames: a use that wants some frames only draws no others."""
    pictures = spark.createDataFrame([(m, *picture(m).values()) for m in sorted({0} | {row[7] for row in SCRIPT})], "mask int, height int, width int, bits binary")
    return _played(spark, sf_dir).join(F.broadcast(pictures), "mask").select("stream_id", "frame", "height", "width", "bits")


def _second(spark, sf_dir):
    return _played(spark, sf_dir).where("second is not null").select("stream_id", "frame", F.col("second").alias("text"), F.lit(0.85).alias("confidence"))


def _out(repairs):
    return repairs.select("stream_id", "frame", "text", F.round("confidence", 4).alias("confidence"))


def hold_repairs(spark, sf_dir):
    return _out(P.hold_repairs(_rows(spark, sf_dir), _masks(spark, sf_dir)))


def swap_repairs(spark, sf_dir):
    return _out(P.swap_repairs(_rows(spark, sf_dir), _masks(spark, sf_dir), _second(spark, sf_dir)))


def recurrent_repairs(spark, sf_dir):
    return _out(P.recurrent_repairs(_rows(spark, sf_dir), _masks(spark, sf_dir), _second(spark, sf_dir)))


def held_repairs(spark, sf_dir):
    return _out(P.held_repairs(_rows(spark, sf_dir), _masks(spark, sf_dir), _second(spark, sf_dir)))


def opening_repairs(spark, sf_dir):
    return _out(P.opening_repairs(_rows(spark, sf_dir), _masks(spark, sf_dir)))


def mark_repairs(spark, sf_dir):
    return _out(P.mark_repairs(_rows(spark, sf_dir), _masks(spark, sf_dir)))


def sparse_repairs(spark, sf_dir):
    return _out(P.sparse_repairs(_rows(spark, sf_dir), _masks(spark, sf_dir)))


def unstable_repairs(spark, sf_dir):
    return _out(P.unstable_repairs(_rows(spark, sf_dir), _second(spark, sf_dir)))


def spacing_repairs(spark, sf_dir):
    return _out(P.spacing_repairs(_rows(spark, sf_dir), _masks(spark, sf_dir)))


def line_repairs(spark, sf_dir):
    return _out(P.line_repairs(_rows(spark, sf_dir), _masks(spark, sf_dir)))


def missing_line_repairs(spark, sf_dir):
    return _out(P.missing_line_repairs(_rows(spark, sf_dir), _second(spark, sf_dir)))


def repair_chain(spark, sf_dir):
    """All passes one after the other: the frames whose text they changed."""
    rows = _rows(spark, sf_dir)
    after = P.repaired(rows, _masks(spark, sf_dir), _second(spark, sf_dir))
    return _out(after.join(rows.select("stream_id", "frame", F.col("text").alias("was")), ["stream_id", "frame"]).where("text != was"))


def line_tracks(spark, sf_dir):
    """The lines that hold while some row's text lacks them."""
    from cuestream.operators import tracks

    return tracks.line_tracks(_rows(spark, sf_dir)).select("stream_id", "text", "first_frame", "last_frame", "items", "confident")


def _sql(value) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)


_TOLD = ", ".join(f"({', '.join(map(_sql, row))})" for row in SCRIPT)
#: A frame's picture is the same as another's where their numbers are, and no picture proves anything.
PLAYED = f"""script(scene, first, last, l1, c1, l2, c2, mask, second) AS (VALUES {_TOLD}),
  counted AS (SELECT user_id AS stream_id, count(*) AS n FROM events GROUP BY user_id), frames AS (SELECT stream_id, CAST(unnest(range(n)) AS BIGINT) AS frame FROM counted),
  played AS (SELECT f.stream_id, f.frame, f.frame * CAST({FRAME_S} AS DOUBLE) AS start, (f.frame + 1) * CAST({FRAME_S} AS DOUBLE) AS ends, s.l1, CAST(s.c1 AS DOUBLE) AS c1, s.l2, CAST(s.c2 AS DOUBLE) AS c2, coalesce(s.mask, 0) AS mask, s.second
    FROM frames f LEFT JOIN script s ON (f.stream_id + f.frame // {SCENE_FRAMES} * 7) % {SCENES} = s.scene AND f.frame % {SCENE_FRAMES} BETWEEN s.first AND s.last),
  rows AS (SELECT *, concat_ws(chr(10), CASE WHEN c1 >= 0.5 THEN l1 END, CASE WHEN c2 >= 0.5 THEN l2 END) AS text, concat_ws(' ', CASE WHEN c1 >= 0.5 THEN l1 END, CASE WHEN c2 >= 0.5 THEN l2 END) AS key,
    coalesce(least(CASE WHEN c1 >= 0.5 THEN c1 END, CASE WHEN c2 >= 0.5 THEN c2 END), 0.0) AS confidence FROM played),
  marked AS (SELECT *, CAST(sum(change) OVER (PARTITION BY stream_id ORDER BY frame) AS BIGINT) AS run_id FROM (SELECT *, CASE WHEN key <> lag(key) OVER (PARTITION BY stream_id ORDER BY frame) THEN 1 ELSE 0 END AS change FROM rows)),
  runs AS (SELECT stream_id, run_id, min(key) AS key, count(*) AS n, min(frame) AS first, max(frame) AS last, min(start) AS start, max(ends) AS ends, count(*) FILTER (confidence >= 0.8) AS sure, min_by(mask, frame) AS m0, max_by(mask, frame) AS m1,
    min_by(confidence, frame) AS q0, max_by(confidence, frame) AS q1, bool_or(l2 IS NOT NULL) AS two, min(frame) FILTER (confidence >= 0.8) AS sure0, max(frame) FILTER (confidence >= 0.8) AS sure1 FROM marked GROUP BY stream_id, run_id)"""
_W = "WINDOW w AS (PARTITION BY stream_id ORDER BY run_id)"
_FIELDS = ("key", "n", "first", "last", "start", "ends", "sure", "m0", "m1", "q0", "q1", "two", "sure0", "sure1")


def _beside(*offsets: int) -> str:
    """beside: runs with columns of the runs at offsets, l1_key and so on."""
    more = ", ".join(f"lead({f}, {k}) OVER w AS {'l' if k < 0 else 'r'}{abs(k)}_{f}" for k in offsets for f in _FIELDS)
    return f"beside AS (SELECT *, {more} FROM runs {_W})"


_HOLD = """, one AS (SELECT *, l1 AS reading FROM rows WHERE l1 IS NOT NULL AND l2 IS NULL AND c1 >= 0.29),
  parted AS (SELECT *, CAST(sum(new) OVER (PARTITION BY stream_id ORDER BY frame) AS BIGINT) AS island FROM (SELECT *, CASE WHEN frame = lag(frame) OVER w + 1 AND reading = lag(reading) OVER w THEN 0 ELSE 1 END AS new FROM one WINDOW w AS (PARTITION BY stream_id ORDER BY frame))),
  ranked AS (SELECT *, CASE WHEN text <> '' THEN count(*) FILTER (text <> '') OVER (PARTITION BY stream_id, island ORDER BY frame) - 1 END AS nth, count(*) FILTER (text <> '') OVER (PARTITION BY stream_id, island) AS own,
    min(frame) OVER (PARTITION BY stream_id, island) AS low, max(frame) OVER (PARTITION BY stream_id, island) AS high, count(*) OVER (PARTITION BY stream_id, island) AS n FROM parted),
  held AS (SELECT stream_id, island FROM ranked GROUP BY stream_id, island HAVING max(n) >= 5 AND count(*) FILTER (text = '') >= 3 AND max(ends) - min(start) >= 0.15 AND max(own) > 0
    AND count(DISTINCT mask) FILTER (frame IN (low, high, low + n // 2) OR nth = own // 2) = 1 AND min(mask) > 0)"""
_SWAPS = f""", {_beside(-1, 1, 2, 3, 4)}, swaps AS (
    SELECT stream_id, first, last, l1_key AS reference, l1_m1 AS ma, r1_m0 AS mb, least(l1_q1, r1_q0) AS confidence FROM beside
    WHERE key <> '' AND l1_key = r1_key AND l1_key <> '' AND key <> l1_key AND ends - start <= 0.45 AND r1_start - l1_ends <= 0.60 AND (l1_ends - l1_start) + (r1_ends - r1_start) >= 0.20
    UNION ALL SELECT stream_id, r1_first, r2_last, key, m1, r3_m0, least(q1, r3_q0) FROM beside
    WHERE key <> '' AND r3_key = key AND r1_key <> '' AND r2_key <> '' AND r3_start - ends <= 0.65 AND r2_ends - r1_start <= 0.45 AND (ends - start) + (r3_ends - r3_start) >= 0.20 AND two = r3_two
    UNION ALL SELECT stream_id, r1_first, r3_last, key, m1, r4_m0, least(q1, r4_q0) FROM beside
    WHERE key <> '' AND r4_key = key AND r3_key <> key AND r1_key <> '' AND r2_key <> '' AND r3_key <> '' AND r4_start - ends <= 0.65 AND r3_ends - r1_start <= 0.45 AND (ends - start) + (r4_ends - r4_start) >= 0.20 AND two = r4_two),
  by_swap AS (SELECT m.stream_id, m.frame, s.reference AS text, CASE WHEN m.mask > 0 AND (m.mask = s.ma OR m.mask = s.mb) THEN s.confidence ELSE 0.85 END AS confidence FROM marked m JOIN swaps s ON m.stream_id = s.stream_id AND m.frame BETWEEN s.first AND s.last
    WHERE (m.mask > 0 AND (m.mask = s.ma OR m.mask = s.mb)) OR m.second = s.reference),
  sides AS (SELECT stream_id, first, last, l1_key AS reference, l1_sure1 AS a FROM beside WHERE key = '' AND ends - start <= 0.60 AND l1_key <> '' AND l1_n >= 2 AND l1_sure >= 2
    UNION ALL SELECT stream_id, first, last, r1_key, r1_sure0 FROM beside WHERE key = '' AND ends - start <= 0.60 AND r1_key <> '' AND r1_n >= 2 AND r1_sure >= 2),
  by_blank AS (SELECT m.stream_id, m.frame, min(s.reference) AS text, min(o.confidence) AS confidence FROM marked m JOIN sides s ON m.stream_id = s.stream_id AND m.frame BETWEEN s.first AND s.last
    JOIN marked o ON o.stream_id = s.stream_id AND o.frame = s.a AND o.mask = m.mask AND m.mask > 0 GROUP BY m.stream_id, m.frame HAVING count(DISTINCT s.reference) = 1),
  swapped AS (SELECT * FROM by_swap UNION ALL SELECT * FROM by_blank)"""

TWINS = {
    "hold_repairs": (hold_repairs, f"WITH {PLAYED}{_HOLD} SELECT stream_id, frame, reading AS text, 0.5 AS confidence FROM ranked WHERE text = '' AND (stream_id, island) IN (SELECT (stream_id, island) FROM held)"),
    "swap_repairs": (swap_repairs, f"WITH {PLAYED}{_SWAPS} SELECT stream_id, frame, (min((text, confidence)))[1] AS text, (min((text, confidence)))[2] AS confidence FROM swapped GROUP BY stream_id, frame"),
    "recurrent_repairs": (recurrent_repairs, f"""WITH {PLAYED}, {_beside(1, 2, 3)}, found AS (SELECT stream_id, first, r3_last AS last, r3_key AS chosen FROM beside WHERE key <> '' AND r1_key <> '' AND key = r2_key AND r1_key = r3_key AND key <> r1_key AND ends - start >= 0.20
        AND r1_ends - r1_start <= 0.18 AND r2_ends - r2_start <= 0.18 AND r3_ends - r3_start >= 0.24 AND r3_ends - start <= 3.5 AND m0 = r3_m0 AND m0 > 0 AND length(key) >= 12 AND length(key) = length(r1_key))
      SELECT m.stream_id, m.frame, f.chosen AS text, m.confidence FROM marked m JOIN found f ON m.stream_id = f.stream_id AND m.frame BETWEEN f.first AND f.last WHERE m.key <> f.chosen"""),
    "held_repairs": (held_repairs, f"""WITH {PLAYED}, one AS (SELECT *, l1 AS reading FROM rows WHERE l1 IS NOT NULL AND l2 IS NULL AND c1 >= 0.29),
      parted AS (SELECT *, CAST(sum(new) OVER (PARTITION BY stream_id ORDER BY frame) AS BIGINT) AS island FROM (SELECT *, CASE WHEN frame = lag(frame) OVER w + 1 THEN 0 ELSE 1 END AS new, reading <> lag(reading) OVER w AS switch FROM one WINDOW w AS (PARTITION BY stream_id ORDER BY frame))),
      held AS (SELECT stream_id, island FROM parted GROUP BY stream_id, island HAVING count(*) >= 6 AND count(*) FILTER (switch) >= 3 AND count(*) FILTER (confidence < 0.5) >= 2 AND count(*) FILTER (confidence >= 0.5) >= 3 AND max(ends) - min(start) >= 0.20
        AND count(DISTINCT mask) = 1 AND min(mask) > 0 AND count(second) >= 2)
      SELECT stream_id, frame, second AS text, greatest(0.5, confidence) AS confidence FROM parted WHERE (stream_id, island) IN (SELECT (stream_id, island) FROM held) AND key <> second"""),
    "opening_repairs": (opening_repairs, f"""WITH {PLAYED}, opens AS (SELECT r.*, o.l1 AS up, o.l2 AS low FROM runs r JOIN rows o ON r.stream_id = o.stream_id AND r.first = o.frame WHERE r.key <> '' AND r.two AND r.n >= 3 AND r.ends - r.start BETWEEN 0.08 AND 0.30 AND o.c2 >= 0.5),
      later AS (SELECT o.stream_id, o.first, o.last, o.n, r.text, count(*) AS seen, list(r.frame ORDER BY r.frame) AS frames FROM opens o JOIN rows r ON r.stream_id = o.stream_id AND r.frame // {SCENE_FRAMES} = o.first // {SCENE_FRAMES} AND r.frame > o.last AND r.start <= o.ends + 2.0 AND r.c2 >= 0.5 AND (r.l1 = o.up) <> (r.l2 = o.low) GROUP BY ALL),
      best AS (SELECT l.*, frames[seen // 2 + 1] AS b FROM later l WHERE seen >= greatest(8, 2 * n)),
      same AS (SELECT x.* FROM best x JOIN rows a ON a.stream_id = x.stream_id AND a.frame = x.first + x.n // 2 JOIN rows b ON b.stream_id = x.stream_id AND b.frame = x.b WHERE a.mask = b.mask AND a.mask > 0)
      SELECT r.stream_id, r.frame, s.text, greatest(0.5, r.confidence) AS confidence FROM rows r JOIN same s ON r.stream_id = s.stream_id AND r.frame BETWEEN s.first AND s.last"""),
    "mark_repairs": (mark_repairs, f"""WITH {PLAYED}, {_beside(1)}, found AS (SELECT stream_id, first, r1_last AS last, CASE WHEN length(key) > length(r1_key) THEN key ELSE r1_key END AS longer FROM beside WHERE key <> '' AND r1_key <> '' AND n >= 3 AND r1_n >= 8 AND ends - start BETWEEN 0.08 AND 0.30
        AND r1_ends - start <= 3.0 AND abs(length(key) - length(r1_key)) = 1 AND two = r1_two AND m0 = r1_m0 AND m0 = r1_m1 AND m0 > 0 AND regexp_replace(key, '\\p{{M}}', '', 'g') = regexp_replace(r1_key, '\\p{{M}}', '', 'g'))
      SELECT m.stream_id, m.frame, f.longer AS text, greatest(0.5, m.confidence) AS confidence FROM marked m JOIN found f ON m.stream_id = f.stream_id AND m.frame BETWEEN f.first AND f.last WHERE m.key <> f.longer"""),
    "sparse_repairs": (sparse_repairs, f"""WITH {PLAYED}, brief AS (SELECT r.*, r.sure0 AS a FROM runs r WHERE key <> '' AND n <= 4 AND ends - start <= 0.18 AND sure0 IS NOT NULL),
      around AS (SELECT b.stream_id, b.first, b.last, b.key AS reading, b.q0, r.frame, r.text, r.mask, o.mask AS shown, r.key NOT IN ('', b.key) AS other FROM brief b JOIN rows o ON o.stream_id = b.stream_id AND o.frame = b.a JOIN rows r ON r.stream_id = b.stream_id AND b.start - r.start <= 1.5 AND r.start - b.ends <= 1.5),
      ended AS (SELECT *, coalesce(max(frame) FILTER ((other OR mask <> shown) AND frame < first) OVER p, min(frame) OVER p - 1) + 1 AS low, coalesce(min(frame) FILTER ((other OR mask <> shown) AND frame > last) OVER p, max(frame) OVER p + 1) - 1 AS high FROM around WINDOW p AS (PARTITION BY stream_id, first)),
      filled AS (SELECT * FROM ended WHERE frame BETWEEN low AND high AND high - low + 1 >= 5 AND shown > 0 AND text = '')
      SELECT stream_id, frame, min_by(reading, first) AS text, greatest(0.5, min_by(q0, first)) AS confidence FROM filled GROUP BY stream_id, frame"""),
    "unstable_repairs": (unstable_repairs, f"""WITH {PLAYED}, {_beside(-1, 1)}, asked AS (SELECT m.* FROM marked m JOIN beside b ON m.stream_id = b.stream_id AND m.run_id = b.run_id
        WHERE b.ends - b.start <= 0.60 AND ((b.key <> '' AND m.second IN (b.l1_key, b.r1_key) AND length(b.key) = length(m.second)) OR (b.key = '' AND b.l1_key = b.r1_key AND m.second = b.l1_key)) AND m.second <> m.key AND m.second <> ''),
      counts AS (SELECT a.stream_id, a.frame, a.second, a.key, count(*) FILTER (o.key = a.second) AS n, count(*) FILTER (o.key = a.key) AS own FROM asked a JOIN rows o ON o.stream_id = a.stream_id AND o.frame BETWEEN a.frame - 20 AND a.frame + 20 GROUP BY ALL)
      SELECT stream_id, frame, second AS text, 0.85 AS confidence FROM counts WHERE n >= 3 AND (key = '' OR n > own)"""),
    "spacing_repairs": (spacing_repairs, f"""WITH {PLAYED}, squeezed AS (SELECT *, replace(key, ' ', '') AS compact FROM rows), parted AS (SELECT *, CAST(sum(change) OVER (PARTITION BY stream_id ORDER BY frame) AS BIGINT) AS part FROM (SELECT *, CASE WHEN compact <> lag(compact) OVER (PARTITION BY stream_id ORDER BY frame) THEN 1 ELSE 0 END AS change FROM squeezed)),
      counts AS (SELECT stream_id, part, text, count(*) AS n, min(frame) AS since, arg_min(mask, (-confidence, frame)) AS shown FROM parted WHERE compact <> '' GROUP BY ALL),
      modes AS (SELECT *, row_number() OVER (PARTITION BY stream_id, part ORDER BY n DESC, since) AS place, count(*) OVER (PARTITION BY stream_id, part) AS spellings FROM counts)
      SELECT p.stream_id, p.frame, m.text, p.confidence FROM parted p JOIN modes m ON p.stream_id = m.stream_id AND p.part = m.part AND m.place = 1 AND m.spellings >= 2 AND m.n >= 3 WHERE p.text <> m.text AND p.mask = m.shown AND p.mask > 0"""),
    "line_repairs": (line_repairs, f"""WITH {PLAYED}, each_line AS (SELECT *, l1 AS line, c1 AS c FROM rows WHERE c1 >= 0.29 UNION ALL SELECT *, l2, c2 FROM rows WHERE c2 >= 0.29),
      parted AS (SELECT *, CAST(sum(new) OVER (PARTITION BY stream_id, line ORDER BY frame) AS BIGINT) AS island FROM (SELECT *, CASE WHEN frame = lag(frame) OVER w + 1 THEN 0 ELSE 1 END AS new FROM each_line WINDOW w AS (PARTITION BY stream_id, line ORDER BY frame))),
      tracks AS (SELECT stream_id, line, island, max(mask) FILTER (c >= 0.5) AS shown FROM parted GROUP BY stream_id, line, island HAVING count(*) >= 5 AND count(*) FILTER (c >= 0.5) >= 3 AND count(DISTINCT mask) FILTER (c >= 0.5) = 1)
      SELECT p.stream_id, p.frame, concat_ws(chr(10), CASE WHEN p.c1 >= 0.29 THEN p.l1 END, CASE WHEN p.c2 >= 0.29 THEN p.l2 END) AS text, 0.5 AS confidence FROM parted p JOIN tracks t ON p.stream_id = t.stream_id AND p.line = t.line AND p.island = t.island
      WHERE p.c < 0.5 AND p.mask = t.shown AND p.mask > 0"""),
    "missing_line_repairs": (missing_line_repairs, f"""WITH {PLAYED}, shown AS (SELECT *, frame // {SCENE_FRAMES} AS scene_no FROM rows), said AS (SELECT stream_id, scene_no, l2, count(*) AS n, min(c2) AS c2 FROM shown WHERE c2 >= 0.5 GROUP BY ALL HAVING count(*) >= 3)
      SELECT r.stream_id, r.frame, r.l1 || chr(10) || r.second AS text, least(r.c1, 0.85) AS confidence FROM shown r JOIN said s ON r.stream_id = s.stream_id AND r.scene_no = s.scene_no AND r.second = s.l2 AND r.l2 IS NULL AND r.l1 IS NOT NULL
      WHERE (SELECT count(*) FROM shown o WHERE o.stream_id = r.stream_id AND o.scene_no = r.scene_no AND o.text <> '') >= 4"""),
    "line_tracks": (line_tracks, f"""WITH {PLAYED}, each_line AS (SELECT stream_id, frame, start, ends, l1 AS line, c1 AS c, text FROM rows WHERE c1 >= 0.29 UNION ALL SELECT stream_id, frame, start, ends, l2, c2, text FROM rows WHERE c2 >= 0.29),
      parted AS (SELECT *, CAST(sum(new) OVER (PARTITION BY stream_id, line ORDER BY frame) AS BIGINT) AS island FROM (SELECT *, CASE WHEN frame = lag(frame) OVER w + 1 THEN 0 ELSE 1 END AS new FROM each_line WINDOW w AS (PARTITION BY stream_id, line ORDER BY frame)))
      SELECT stream_id, line AS text, min(frame) AS first_frame, max(frame) AS last_frame, CAST(count(*) AS INTEGER) AS items, CAST(count(*) FILTER (c >= 0.5) AS INTEGER) AS confident FROM parted GROUP BY stream_id, line, island
      HAVING count(*) >= 5 AND count(*) FILTER (c >= 0.5) >= 3 AND count(*) FILTER (NOT contains(text, line)) > 0"""),
    "repair_chain": (repair_chain, None),
}
