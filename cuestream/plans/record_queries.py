"""Queries on settings, stored results, layout filters and what single readings show."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuestream.functions import text as T
from cuestream.operators import cues as C
from cuestream.operators import evidence as E
from cuestream.operators import jobs as Q
from cuestream.operators import layout as L
from cuestream.operators import scans as N
from cuestream.operators import settings as S
from cuestream.plans.carriers import CUES, JOBS, cues, jobs, table
from cuestream.plans.job_queries import VIDEO, videos
from cuestream.plans.repair_queries import PLAYED, _masks, _rows
from cuestream.plans.text_queries import KEY
from cuestream.sources import subtitles

_CODES = ("en-US", "zh-Hans,en-US", "xx-YY", "", "ko-KR,qq")


def _codes():
    return F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("c_custkey") % len(_CODES) + 1).cast("int"))


def language_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.language_name(_codes()).alias("name"), F.array_join(S.unknown_languages(_codes()), ",").alias("unknown"))


def formats(spark, sf_dir):
    asked = F.element_at(F.array(F.lit("srt"), F.lit("ass"), F.lit("both")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(S.selected_formats(asked)).alias("format"))


def private_stems(spark, sf_dir):
    v = videos(spark, sf_dir)
    return v.select("id", S.private_stem(F.col("source"), T.video_stem(F.col("source")), "/cache").alias("stem"))


def _settled(spark, sf_dir):
    j = jobs(spark, sf_dir)
    return j.select(
        "id", F.col("series").cast("string").alias("series"), "status", "processed", F.when(F.col("id") % 3 == 0, F.col("language")).alias("language"), F.when(F.col("id") % 5 == 0, "native").alias("engine"),
        F.lit(0.5).alias("work_fraction"), F.lit(False).alias("replace_output"), F.when(F.col("status") == "failed", "gone").alias("error"), (F.col("id") % 2 == 0).alias("export_only"),
        F.lit("0,0,1,1").alias("roi"), F.lit("auto").alias("detected_roi"), F.when(F.col("id") % 4 == 0, "own").alias("roi_override"),
    )


def setting_defaults(spark, sf_dir):
    return S.with_defaults(_settled(spark, sf_dir), {"language": "auto", "engine": "rapid", "format": "both", "output": "/out"}).select("id", *S.SETTINGS)


def marked_again(spark, sf_dir):
    return S.mark_for_reprocessing(_settled(spark, sf_dir), F.col("id") % 7 == 0).select("id", "status", "processed", "replace_output", "error", "export_only")


def series_split(spark, sf_dir):
    return S.split_series(_settled(spark, sf_dir), F.col("id") % 7 == 0, F.lit("group of its own")).select("id", "series", "roi", "roi_override")


def override_cleared(spark, sf_dir):
    return S.clear_override(_settled(spark, sf_dir), F.col("id") % 3 == 0).select("id", "status", "processed", "roi_override", "replace_output")


def _configured(spark, sf_dir, done: bool):
    j = jobs(spark, sf_dir)
    kept = j.where("status = 'done'") if done else j
    calibration = F.struct(F.lit("r").alias("roi"), (F.col("series") % 3).cast("double").alias("font_height"), F.lit(None).cast("double").alias("mask_density"), F.lit(1.5).alias("aspect"), F.lit(1).alias("region_revision"), F.lit(True).alias("font_calibrated"))
    return kept.select(
        "id", F.col("series").cast("string").alias("source_sha256"), F.when(F.col("season") > 1994, "0,0,1,1").alias("roi"), F.col("language").alias("languages"), F.lit(2).alias("scale"), F.lit(None).cast("string").alias("words"), F.lit("rapid").alias("engine_route"),
        F.lit("1").alias("tool_version"), F.when(F.lit(done) & (F.col("id") % 2 == 0), "accurate").alias("strategy"), F.when(F.lit(done) | (F.col("id") % 3 > 0), calibration).alias("calibration"),
    )


def reused_results(spark, sf_dir):
    """Jobs that a stored result of the same source and configuration serves."""
    return S.reusable(_configured(spark, sf_dir, False), _configured(spark, sf_dir, True)).select("id")


def event_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), "event_id", "user_id")
    return S.event_lines(e.withColumn("key", F.when(F.col("event_id") % 2 == 0, F.col("user_id"))).select("type", "event_id", "key"), "@@")


def evidence_checks(spark, sf_dir):
    """Turns against two second readings, some of them in capitals."""
    c = cues(spark, sf_dir)
    said = F.when(F.col("turn") % 4 == 0, F.upper("text")).otherwise(F.col("text"))
    other = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(said)
    return c.select("stream_id", "turn", F.array_join(S.evidence_flags(said, other, said), ",").alias("flags"))


def placements(spark, sf_dir):
    """Where cues are put in a frame of 1280 by 720 by a learned layout within a region."""
    c = table(spark, sf_dir, "customer").withColumn("k", (F.col("c_custkey") % 50).cast("double"))
    seen = F.struct((F.col("k") / 64).alias("center_x"), (F.col("k") / 50).alias("bottom_y"), F.when(F.col("k") > 3, F.col("k") / 400).otherwise(F.lit(0.0)).alias("glyph_height"))
    roi = F.array(F.lit(0.125), F.lit(0.25), F.lit(0.875), F.lit(1.0))
    return c.select("c_custkey", C.placement(seen, roi, F.lit(1280), F.lit(720)).alias("tag"))


def hangul_keys(spark, sf_dir):
    said = F.when(F.col("item_id") % 2 == 0, F.concat("text", F.lit("  안녕 하세요 "))).otherwise(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", T.hangul_key(said).alias("key"))


def visual_protection(spark, sf_dir):
    """Neighbouring turns that must not be compared by their pixels either: protected marks and letters differ."""
    c = cues(spark, sf_dir)
    said = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    w = W.partitionBy("stream_id").orderBy("turn")
    pairs = c.select("stream_id", "turn", "text", said.alias("said"), F.coalesce(F.lag(said).over(w), F.lit("")).alias("before"))
    return pairs.select("stream_id", "turn", T.protected_for_visual_check(F.col("text"), F.col("said")).alias("slip"), T.protected_for_visual_check(F.concat("text", F.lit(" 1")), F.concat("text", F.lit(" 2"))).alias("change"))


def glyph_slips(spark, sf_dir):
    """Items against themselves with one letter changed, or two: the span that one slip of a reader explains."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", r"[^a-z]", "x").alias("a"))
    at = "cast(pmod(item_id * 7, length(a)) as int)"
    other = F.concat(F.expr(f"substring(a, 1, {at})"), F.lit("Q"), F.expr(f"substring(a, {at} + 2)"))
    other = F.when(F.col("item_id") % 3 == 0, F.concat(other, F.lit("zz"))).otherwise(other)
    return b.withColumn("s", E.glyph_disagreement(F.col("a"), other)).select("item_id", "s.low", "s.high")


def error_classes(spark, sf_dir):
    said = F.element_at(F.array(*[F.lit(x) for x in ("PermissionError: x", "FileNotFoundError: y", "OSError: No space left on device", "Invalid data found when processing", "else")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", Q.describe_error(said).alias("kind"))


def line_geometry(spark, sf_dir):
    """Mean height and place of the lines of each frame, their bounds, and how many of them are the row's own."""
    r = _rows(spark, sf_dir).where(F.size("lines") > 0)
    g, b = L.line_geometry(F.col("lines")), L.box_bounds(F.col("lines"))
    return r.select("stream_id", "frame", F.round(g["centre"], 6).alias("centre"), F.round(g["height"], 6).alias("height"), g["count"].alias("lines"), F.round(b["top"], 6).alias("top"), F.round(b["bottom"], 6).alias("bottom"), F.size(L.dominant_boxes(F.col("lines"), F.col("text"))).alias("own"))


def line_filter(spark, sf_dir):
    """Lines kept and left out by height and mask density: the lower of two is taken for faint in every third frame."""
    r = _rows(spark, sf_dir).where(F.size("lines") > 0)
    densities = F.transform("lines", lambda x, i: F.when((i == 1) & (F.col("frame") % 3 == 0), 0.01).otherwise(0.2))
    f = L.filter_lines(F.col("lines"), densities, F.when(F.col("frame") % 5 == 0, 40).otherwise(100), 10.0, 30.0, 0.05)
    return r.select("stream_id", "frame", F.size(f["kept"]).alias("kept"), F.size(f["small"]).alias("small"), F.size(f["faint"]).alias("faint"))


def _seen(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem")
    number = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))
    return o.select(
        F.col("l_suppkey").alias("stream_id"), number.alias("id"), number.alias("first_frame"), number.cast("double").alias("start"), (number + F.when(F.col("l_quantity") > 3, 0.5).otherwise(0.0625)).alias("end"),
        F.when(F.col("l_quantity") > 3, 9).otherwise(1).alias("frames"), F.when(F.col("l_quantity") > 3, "caption").otherwise("i").alias("text"), F.when(F.col("l_quantity") > 3, 0.9).otherwise(0.5).alias("confidence"),
        F.when(F.col("l_quantity") > 3, 0.0625).when(F.col("l_orderkey") % 2 == 0, 0.0).otherwise(0.03125).alias("density"),
    )


def events_without_glyphs(spark, sf_dir):
    s = _seen(spark, sf_dir)
    return L.without_glyphs(s.drop("density"), s.select("stream_id", F.col("first_frame").alias("frame"), "density")).select("stream_id", "id", "density")


def manual_regions(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "stream_id")
    own = c.select("stream_id", F.lit("0,0.7,1,1").alias("roi"), (F.col("stream_id") % 3 == 0).alias("automatic"), (F.col("stream_id") % 5 == 0).alias("font_calibrated"), F.lit(None).cast("double").alias("font_height"), F.lit(None).cast("double").alias("mask_density"))
    learned = c.where("stream_id % 2 = 0").select("stream_id", F.lit(0.05).alias("font_height"), F.lit(0.125).alias("mask_density"))
    return L.learn_manual(own, learned)


def korean_votes(spark, sf_dir):
    """Streams settled as Korean: three distinct readings that both readers give."""
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), n.alias("i"), "event_type", "event_id")
    said = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("안녕하세요 여러분 "), F.element_at(F.array(*[F.lit(x) for x in "가나다라"]), (F.col("event_id") % 4 + 1).cast("int")))).otherwise(F.col("event_type"))
    return S.korean_vote(e.where("i < 12").select("stream_id", "i", said.alias("first"), said.alias("second"), F.when(F.col("event_id") % 5 == 0, 0.5).otherwise(0.9).alias("confidence")))


def true_spans(spark, sf_dir):
    """The runs of positive components of each vector."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(S.true_spans(F.transform("embedding", lambda x: x > 0))).alias("s"))
    return e.select("vec_id", "s.start", "s.stop")


def exported_files(spark, sf_dir):
    """Stored cues as files of both formats."""
    return subtitles.exported(cues(spark, sf_dir)).select("stream_id", "format", F.md5(F.col("body").cast("binary")).alias("md5"))


def scan_groups(spark, sf_dir):
    """Frames that one recognition serves: as long as masks stay with the first one's, for 1.5 seconds at most."""
    rows = _rows(spark, sf_dir).select("stream_id", "frame", "start")
    return N.scan_groups(rows, _masks(spark, sf_dir)).select("stream_id", "frame", "leader")


def matched_cues(spark, sf_dir):
    """Cues of equal texts in the longest common blocks of two exports."""
    from cuestream.operators import alignment
    from cuestream.plans.stream_queries import _cue_seconds, _shifted

    m = alignment.matched_blocks(_cue_seconds(cues(spark, sf_dir)), _cue_seconds(_shifted(spark, sf_dir)))
    return m.groupBy("stream_id").agg(F.count("*").alias("matched"), F.round(F.max("start_error"), 6).alias("worst"))


_NAMES = "CASE code WHEN 'en-US' THEN '英语' WHEN 'zh-Hans,en-US' THEN '简体中文、英语' WHEN 'ko-KR,qq' THEN '韩语、qq' WHEN '' THEN '未判断' ELSE code END"
_ASKED = f"SELECT c_custkey, {list(_CODES)}[c_custkey % {len(_CODES)} + 1] AS code FROM customer"
_FLAGS = f"""CASE WHEN length({KEY.format('said')}) >= 15 AND regexp_matches(said, '[A-Z]') AND NOT regexp_matches(said, '\\p{{Ll}}') THEN 'all_caps_check' END, CASE WHEN {KEY.format('other')} <> {KEY.format('said')} THEN 'language_check_disagreement' END"""

TWINS = {
    "language_names": (language_names, f"WITH asked AS ({_ASKED}) SELECT c_custkey, {_NAMES} AS name, CASE code WHEN '' THEN NULL WHEN 'xx-YY' THEN 'xx-YY' WHEN 'ko-KR,qq' THEN 'qq' ELSE '' END AS unknown FROM asked"),
    "formats": (formats, "SELECT c_custkey, unnest(CASE c_custkey % 3 WHEN 0 THEN ['srt'] WHEN 1 THEN ['ass'] ELSE ['srt', 'ass'] END) AS format FROM customer"),
    "private_stems": (private_stems, f"WITH {VIDEO} SELECT id, '/cache/results/' || substr(sha256(source), 1, 24) || '/' || regexp_replace(regexp_replace(source, '^.*/', ''), '\\.mkv$', '') AS stem FROM videos"),
    "setting_defaults": (setting_defaults, f"WITH {JOBS} SELECT id, CASE WHEN id % 3 = 0 THEN language ELSE 'auto' END AS language, CASE WHEN id % 5 = 0 THEN 'native' ELSE 'rapid' END AS engine, 'both' AS format, '/out' AS output FROM jobs"),
    "marked_again": (marked_again, f"WITH {JOBS} SELECT id, CASE WHEN id % 7 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN id % 7 = 0 THEN 0 ELSE processed END AS processed, id % 7 = 0 AS replace_output, CASE WHEN id % 7 <> 0 AND status = 'failed' THEN 'gone' END AS error, id % 7 <> 0 AND id % 2 = 0 AS export_only FROM jobs"),
    "series_split": (series_split, f"WITH {JOBS} SELECT id, CASE WHEN id % 7 = 0 THEN 'group of its own' ELSE CAST(series AS VARCHAR) END AS series, CASE WHEN id % 7 <> 0 THEN '0,0,1,1' END AS roi, CASE WHEN id % 7 <> 0 AND id % 4 = 0 THEN 'own' END AS roi_override FROM jobs"),
    "override_cleared": (override_cleared, f"WITH {JOBS}, j AS (SELECT *, id % 12 = 0 AS hit FROM jobs) SELECT id, CASE WHEN hit THEN 'pending' ELSE status END AS status, CASE WHEN hit THEN 0 ELSE processed END AS processed, CASE WHEN id % 4 = 0 AND NOT hit THEN 'own' END AS roi_override, hit AS replace_output FROM j"),
    "reused_results": (reused_results, f"WITH {JOBS}, c AS (SELECT *, season > 1994 AS late FROM jobs) SELECT id FROM c WHERE EXISTS (SELECT 1 FROM c d WHERE d.status = 'done' AND d.series = c.series AND d.late = c.late AND d.language = c.language)"),
    "event_lines": (event_lines, """SELECT '@@{"type":"' || event_type || '","event_id":' || event_id || CASE WHEN event_id % 2 = 0 THEN ',"key":' || user_id ELSE '' END || '}' AS line FROM events"""),
    "evidence_checks": (evidence_checks, f"WITH {CUES}, t AS (SELECT stream_id, turn, CASE WHEN turn % 4 = 0 THEN upper(text) ELSE text END AS said, CASE WHEN turn % 3 = 0 THEN text || '!' WHEN turn % 4 = 0 THEN upper(text) ELSE text END AS other FROM cues) SELECT stream_id, turn, array_to_string(list_filter([{_FLAGS}], lambda x: x IS NOT NULL), ',') AS flags FROM t"),
    "placements": (placements, """WITH c AS (SELECT c_custkey, CAST(c_custkey % 50 AS DOUBLE) AS k FROM customer), p AS (SELECT *, CAST(0.125 AS DOUBLE) + k / 64 * 0.75 AS x, CAST(0.25 AS DOUBLE) + k / 50 * 0.75 AS y FROM c)
      SELECT c_custkey, CASE WHEN k > 3 THEN '{\\an2\\pos(' || CAST(round_even(least(1.0, greatest(0.0, x)) * 1280, 0) AS INTEGER) || ',' || CAST(round_even(least(1.0, greatest(0.0, y)) * 720, 0) AS INTEGER) || ')\\fs' || greatest(1, least(720, CAST(round_even(k / 400 * 0.75 * 720, 0) AS INTEGER))) || '}' ELSE '' END AS tag FROM p"""),
    "hangul_keys": (hangul_keys, f"WITH t AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text || '  안녕 하세요 ' ELSE text END AS t FROM benchmark) SELECT item_id, CASE WHEN item_id % 2 = 0 THEN regexp_replace({KEY.format('t')}, '\\s+', '', 'g') ELSE {KEY.format('t')} END AS key FROM t"),
    "visual_protection": (visual_protection, f"WITH {CUES} SELECT stream_id, turn, false AS slip, true AS change FROM cues"),
    "glyph_slips": (glyph_slips, "SELECT item_id, CASE WHEN item_id % 3 <> 0 AND length(text) >= 12 THEN CAST(item_id * 7 % length(text) AS INTEGER) END AS low, CASE WHEN item_id % 3 <> 0 AND length(text) >= 12 THEN CAST(item_id * 7 % length(text) + 1 AS INTEGER) END AS high FROM benchmark"),
    "error_classes": (error_classes, "SELECT c_custkey, ['permission', 'missing file', 'disk full', 'not decodable', 'other'][c_custkey % 5 + 1] AS kind FROM customer"),
    "line_geometry": (line_geometry, f"""WITH {PLAYED} SELECT stream_id, frame, round(CASE WHEN l2 IS NULL THEN 0.35 ELSE (0.35 + 0.7) / 2 END, 6) AS centre, 0.2 AS height, CAST(CASE WHEN l2 IS NULL THEN 1 ELSE 2 END AS INTEGER) AS lines, 0.25 AS top, CASE WHEN l2 IS NULL THEN 0.45 ELSE 0.8 END AS bottom,
      CAST(CASE WHEN c1 >= 0.5 THEN 1 ELSE 0 END + CASE WHEN c2 >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS own FROM rows WHERE l1 IS NOT NULL"""),
    "line_filter": (line_filter, f"""WITH {PLAYED}, x AS (SELECT stream_id, frame, CASE WHEN l2 IS NULL THEN 1 ELSE 2 END AS n, frame % 5 = 0 AS low, CASE WHEN l2 IS NOT NULL AND frame % 3 = 0 THEN 1 ELSE 0 END AS f FROM rows WHERE l1 IS NOT NULL)
      SELECT stream_id, frame, CAST(CASE WHEN low THEN 0 ELSE n - f END AS INTEGER) AS kept, CAST(CASE WHEN low THEN n ELSE f END AS INTEGER) AS small, CAST(CASE WHEN low THEN 0 ELSE f END AS INTEGER) AS faint FROM x"""),
    "events_without_glyphs": (events_without_glyphs, """WITH s AS (SELECT l_suppkey AS stream_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS id, l_quantity > 3 AS held, l_orderkey % 2 = 0 AS even FROM lineitem), u AS (SELECT stream_id FROM s WHERE held GROUP BY stream_id HAVING count(*) >= 3)
      SELECT stream_id, CAST(id AS INTEGER) AS id, 0.0 AS density FROM s WHERE NOT held AND even AND stream_id IN (SELECT stream_id FROM u)"""),
    "manual_regions": (manual_regions, """WITH c AS (SELECT c_custkey AS stream_id, c_custkey % 3 = 0 AS automatic, c_custkey % 5 = 0 AS calibrated FROM customer)
      SELECT stream_id, '0,0.7,1,1' AS roi, automatic, CASE WHEN automatic OR calibrated THEN calibrated ELSE true END AS font_calibrated, CASE WHEN NOT automatic AND NOT calibrated AND stream_id % 2 = 0 THEN 0.05 END AS font_height, CASE WHEN NOT automatic AND NOT calibrated AND stream_id % 2 = 0 THEN 0.125 END AS mask_density FROM c"""),
    "korean_votes": (korean_votes, """WITH e AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_id FROM events), k AS (SELECT stream_id, event_id % 4 AS k, min(i) AS i FROM e WHERE i < 12 AND event_id % 3 > 0 AND event_id % 5 <> 0 GROUP BY ALL),
      n AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY i) AS nth FROM k) SELECT stream_id, CAST(i AS INTEGER) AS after FROM n WHERE nth = 3"""),
    "true_spans": (true_spans, """WITH v AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) > 0 AS on_ FROM embeddings), m AS (SELECT *, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS island FROM v WHERE on_)
      SELECT vec_id, CAST(min(i) AS INTEGER) AS start, CAST(max(i) + 1 AS INTEGER) AS stop FROM m GROUP BY vec_id, island"""),
    "exported_files": (exported_files, None),
    "scan_groups": (scan_groups, f"""WITH {PLAYED}, m AS (SELECT *, CAST(sum(new) OVER (PARTITION BY stream_id ORDER BY frame) AS BIGINT) AS island FROM (SELECT stream_id, frame, mask, CASE WHEN mask > 0 AND mask = lag(mask) OVER (PARTITION BY stream_id ORDER BY frame) THEN 0 ELSE 1 END AS new FROM rows)),
      f AS (SELECT *, min(frame) OVER (PARTITION BY stream_id, island) AS first FROM m) SELECT stream_id, frame, first + (frame - first) // 38 * 38 AS leader FROM f"""),
    "matched_cues": (matched_cues, f"WITH {CUES} SELECT stream_id, count(*) AS matched, 0.3 AS worst FROM cues WHERE (stream_id + turn) % 5 <> 0 GROUP BY stream_id"),
}
