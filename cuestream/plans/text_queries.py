"""Queries on texts, layouts and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuestream.functions import text as T
from cuestream.operators import layout as L
from cuestream.operators.ranks import numbered
from cuestream.plans.carriers import CUES, LAYOUTS, cues, layouts, table
from cuestream.plans.cue_queries import NORMAL

KEY = r"replace(replace(replace(replace(regexp_replace(" + NORMAL + r", '\s+', ' ', 'g'), '‘', ''''), '’', ''''), '“', '""'), '”', '""')"
KEY = KEY.replace('""', '"')


def text_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.key(F.col("text")).cast("binary")).alias("key_md5"), F.length(T.key(F.col("text"))).alias("key_chars"))


def reference_text_key(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.reference_key(F.col("text")).alias("key"))


def script_guess(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.guess_language(F.col("text")).alias("guess"))


def natural_order(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), (F.col("p_partkey") * 7919 % 1009).cast("string"), F.lit("-"), "p_type").alias("path"))
    return numbered(p.withColumn("k", T.natural_key(F.col("path"))), "k", "p_partkey", name="place").select("p_partkey", "path", F.col("place").cast("int").alias("place"))


def protected_change(spark, sf_dir):
    """Pairs of neighbouring turns whose digits, closing marks or negations differ."""
    from pyspark.sql import Window as W

    c = cues(spark, sf_dir)
    c = c.withColumn("said", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("no "), "text")).otherwise(F.col("text"))).withColumn("before", F.lag("said").over(W.partitionBy("stream_id").orderBy("turn")))
    return c.where(F.col("before").isNotNull()).select("stream_id", "turn", T.protected_change(F.col("before"), F.col("said")).alias("protected"))


def letters_only(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.letters(F.col("text")).alias("letters"))


def edit_distance(spark, sf_dir):
    """The distance between the whole texts of an item and of the next by id; null for the last."""
    items = numbered(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", "text")
    following = items.select((F.col("nth") - 1).alias("nth"), F.col("text").alias("next"))
    return items.join(following, "nth", "left").select("item_id", F.levenshtein("text", "next").alias("edits"))


def timecode_parse(spark, sf_dir):
    c = cues(spark, sf_dir)
    return c.select("stream_id", "turn", F.round(T.seconds(T.stamp(F.col("start_ms") / 1000)) * 1000).cast("long").alias("ms"))


def episode_parse(spark, sf_dir):
    """Season and episode of names in three spellings, and of none."""
    p = table(spark, sf_dir, "part")
    n, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    name = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Show.S"), s, F.lit("E"), n)).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("剧 第"), n, F.lit("集")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("Show ep "), n)).otherwise(F.concat(F.lit("Show "), n))
    )
    return p.select("p_partkey", T.episode(name).alias("e")).select("p_partkey", "e.season", "e.episode")


def video_stem(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.video_stem(F.col("url")).alias("stem"))


def missing_line(spark, sf_dir):
    """Whether a turn's first line is missing from the turn after."""
    from pyspark.sql import Window as W

    c = cues(spark, sf_dir).withColumn("after", F.lead("text").over(W.partitionBy("stream_id").orderBy("turn"))).where(F.col("after").isNotNull())
    return c.select("stream_id", "turn", T.missing_line(T.key(F.split("text", "\n")[0]), F.col("after")).alias("missing"))


def region_parse(spark, sf_dir):
    """Regions as text; null where their borders are not in order."""
    c = table(spark, sf_dir, "customer")
    f = lambda k: F.format_string("%.2f", F.pmod(F.col("c_custkey") * k, F.lit(100)) / 100.0)
    v = T.roi(F.concat_ws(",", f(3), f(7), f(11), f(13)))
    top, bottom = T.safety_top_bottom(v, F.col("c_custkey") % 2 == 0, F.lit(None).cast("double"))
    return c.select("c_custkey", v.isNotNull().alias("valid"), F.round(top, 6).alias("top"), F.round(bottom, 6).alias("bottom"))


def scale_selection(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", T.scale(F.when(F.col("c_custkey") % 5 == 0, 3), F.col("c_custkey") % 2000, F.when(F.col("c_nationkey") < 12, "vision").otherwise("rapid"), F.when(F.col("c_custkey") % 3 == 0, "th-TH").otherwise("en-US")).alias("scale"))


SUSTAINED, WEAK = "end_cs - start_cs >= 35 AND frames >= 5", "(end_cs - start_cs < 30 OR frames < 5)"


def _outliers(spark, sf_dir):
    e = layouts(spark, sf_dir)
    return L.outliers(e, L.learn(e, F.expr(SUSTAINED)), F.expr(WEAK))


def layout_outliers(spark, sf_dir):
    return _outliers(spark, sf_dir).where("reason is not null").select("stream_id", "event_id", "reason")


def scene_track_closure(spark, sf_dir):
    return L.track_closure(_outliers(spark, sf_dir)).where("reason is not null").select("stream_id", "event_id", "reason")


def renumbered_events(spark, sf_dir):
    return L.renumber(L.track_closure(_outliers(spark, sf_dir))).select("stream_id", "event_id", "id")


def robust_typical_height(spark, sf_dir):
    return L.typical_height(layouts(spark, sf_dir), "stream_id")


def region_scores(spark, sf_dir):
    e = layouts(spark, sf_dir).select("stream_id", F.floor(F.col("y") / 10).alias("cluster"), (F.col("event_id") % 12).alias("sample"), F.col("x").cast("string").alias("text"), "h")
    s = L.region_scores(e)
    return s.select("stream_id", "cluster", "unique_texts", "coverage", F.round("score", 4).alias("score"))


def mask_xor_ratio(spark, sf_dir):
    """Neighbouring vectors as masks of their positive components."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x > 0).alias("m"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("m").alias("n")), "vec_id")
    return pairs.select("vec_id", F.round(L.mask_ratio(F.col("m"), F.col("n")), 6).alias("ratio"))


_MEDIAN_NEAR = "abs(x - mx) <= 14 AND h / mh BETWEEN 0.65 AND 1.55"
_LEARNED = LAYOUTS + f""", anchors AS (SELECT * FROM layouts WHERE {SUSTAINED}), rough AS (SELECT stream_id, median(x) AS mx, median(h) AS mh FROM anchors GROUP BY stream_id HAVING count(*) >= 6),
  near AS (SELECT a.*, {_MEDIAN_NEAR} AS near, count(*) FILTER ({_MEDIAN_NEAR}) OVER (PARTITION BY a.stream_id) >= 6 AS enough FROM anchors a JOIN rough r ON a.stream_id = r.stream_id),
  learned AS (SELECT stream_id, median(x) AS lx, list_sort(list(y))[CAST(floor((count(*) - 1) * 0.1) AS INTEGER) + 1] AS low, list_sort(list(y))[CAST(floor((count(*) - 1) * 0.9) AS INTEGER) + 1] AS high, median(h) AS lh
    FROM near WHERE NOT enough OR near GROUP BY stream_id),
  ways AS (SELECT e.*, lx, low, high, abs(x - lx) > 18 AS off_x, y < low - 8 OR y > high + 8 AS off_y, h < lh * 0.74 OR h > lh * 1.7 AS odd, {WEAK} AS weak FROM layouts e LEFT JOIN learned l ON e.stream_id = l.stream_id),
  judged AS (SELECT *, CASE WHEN (off_x AND (off_y OR odd)) OR (off_y AND odd) OR (off_y AND weak AND CAST(off_x AS INTEGER) + CAST(off_y AS INTEGER) + CAST(odd AS INTEGER) >= 2) THEN 'scene_text_layout' END AS reason FROM ways)"""
_PROTECTED = r"'\d+'", r"'[?!。！？]+$'", r"'\b(?:not|no|never|cannot|can[''’]?t|won[''’]?t|don[''’]?t|didn[''’]?t|isn[''’]?t|aren[''’]?t|wasn[''’]?t|weren[''’]?t|shouldn[''’]?t|wouldn[''’]?t|couldn[''’]?t|n[''’]?t|ne|pas|non|nicht|kein|sin)\b|[不没無无未안못않ないぬ]'"
_DIFFER = " OR ".join(f"regexp_extract_all(lower(a), {p}) <> regexp_extract_all(lower(b), {p})" for p in _PROTECTED)
_ONLY = r"regexp_replace(text, '[^\p{L}]', '', 'g')"
_COUNT = lambda chars: f"(length({_ONLY}) - length(regexp_replace({_ONLY}, '[{chars}]', '', 'g')))"
_F = lambda k: f"CAST(c_custkey * {k} % 100 AS DOUBLE) / 100"

#: The distance counts bytes there, so every letter of a pair is written as one byte, by its place among their letters.
_IN_BYTES = "array_to_string(list_transform(regexp_extract_all({0}, '(?s).'), lambda c: chr(CAST(list_position(letters, c) AS INTEGER))), '')"
_CAUGHT = """abnormal AS (SELECT * FROM judged WHERE reason IS NULL AND (abs(x - lx) > 12 OR y < low - 6 OR y > high + 6)),
      caught AS (SELECT stream_id, event_id, x, y, start_cs, end_cs FROM judged WHERE reason IS NOT NULL UNION
        SELECT a.stream_id, a.event_id, a.x, a.y, a.start_cs, a.end_cs FROM caught c JOIN abnormal a ON a.stream_id = c.stream_id AND abs(a.x - c.x) <= 12 AND abs(a.y - c.y) <= 12 AND a.start_cs - c.end_cs <= 35 AND c.start_cs - a.end_cs <= 35)"""

TWINS = {
    "text_key": (text_key, f"SELECT doc_id, md5({KEY.format('text')}) AS key_md5, CAST(length({KEY.format('text')}) AS INTEGER) AS key_chars FROM documents"),
    "reference_text_key": (reference_text_key, r"SELECT item_id, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) AS key FROM benchmark"),
    "script_guess": (script_guess, f"SELECT doc_id, CASE WHEN {_COUNT('가-힣')} >= 2 THEN 'ko-KR' WHEN {_COUNT('぀-ヿ')} >= 1 THEN 'ja-JP' WHEN {_COUNT('㐀-鿿')} >= 2 THEN 'zh-Hans' WHEN {_COUNT('A-Za-z')} >= 3 AND {_COUNT('A-Za-z')} / greatest(length({_ONLY}), 1) >= 0.8 THEN 'en-US' END AS guess FROM documents"),
    "natural_order": (natural_order, r"""WITH p AS (SELECT p_partkey, p_brand || '/' || (p_partkey * 7919 % 1009) || '-' || p_type AS path FROM part),
      keyed AS (SELECT *, list_transform(regexp_extract_all(path, '\d+|\D+'), lambda x: CASE WHEN regexp_matches(x, '^\d') THEN '0' || lpad(x, 12, '0') ELSE '1' || lower(x) END) AS k FROM p)
      SELECT p_partkey, path, CAST(row_number() OVER (ORDER BY k, p_partkey) AS INTEGER) AS place FROM keyed"""),
    "protected_change": (protected_change, f"""WITH {CUES}, said AS (SELECT stream_id, turn, CASE WHEN turn % 3 = 0 THEN 'no ' || text ELSE text END AS said FROM cues),
      keyed AS (SELECT stream_id, turn, {KEY.format('said')} AS b, lag({KEY.format('said')}) OVER (PARTITION BY stream_id ORDER BY turn) AS a FROM said)
      SELECT stream_id, turn, {_DIFFER} AS protected FROM keyed WHERE a IS NOT NULL"""),
    "letters_only": (letters_only, r"SELECT item_id, replace(lower(regexp_replace(nfc_normalize(text), '[^\p{L}\p{N}]', '', 'g')), 'ß', 'ss') AS letters FROM benchmark"),
    "edit_distance": (edit_distance, f"""WITH pairs AS (SELECT item_id, text AS a, lead(text) OVER (ORDER BY item_id, text) AS b FROM benchmark), told AS (SELECT *, list_distinct(regexp_extract_all(a || b, '(?s).')) AS letters FROM pairs)
      SELECT item_id, CAST(levenshtein({_IN_BYTES.format('a')}, {_IN_BYTES.format('b')}) AS INTEGER) AS edits FROM told"""),
    "timecode_parse": (timecode_parse, f"WITH {CUES} SELECT stream_id, turn, start_ms AS ms FROM cues"),
    "episode_parse": (episode_parse, """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 AND p_partkey < 10000 THEN p_size END AS season, CASE WHEN p_partkey % 4 <> 3 AND p_partkey < 10000 THEN CAST(p_partkey AS INTEGER) END AS episode FROM part"""),
    "video_stem": (video_stem, r"SELECT page_id, regexp_replace(regexp_replace(url, '^.*/', ''), '(.)\.[^.]+$', '\1') AS stem FROM pages"),
    "missing_line": (missing_line, f"""WITH {CUES}, beside AS (SELECT *, lead(text) OVER (PARTITION BY stream_id ORDER BY turn) AS after FROM cues),
      keyed AS (SELECT stream_id, turn, {KEY.format("string_split(text, chr(10))[1]")} AS c, {KEY.format('after')} AS k, list_filter(list_transform(string_split(after, chr(10)), lambda x: {KEY.format('x')}), lambda x: length(x) > 0) AS lines FROM beside WHERE after IS NOT NULL)
      SELECT stream_id, turn, NOT contains(k, c) AND len(list_filter(lines, lambda x: contains(c, x))) = 0 AS missing FROM keyed"""),
    "region_parse": (region_parse, f"""WITH v AS (SELECT c_custkey, {_F(3)} AS x1, {_F(7)} AS y1, {_F(11)} AS x2, {_F(13)} AS y2 FROM customer), ok AS (SELECT *, x1 < x2 AND y1 < y2 AS valid FROM v),
      m AS (SELECT *, c_custkey % 2 = 0 OR y2 - y1 >= 0.25 OR x2 - x1 < 0.35 AS as_is, least(0.018, greatest(0.008, (y2 - y1) * 0.15)) AS margin FROM ok)
      SELECT c_custkey, valid, round(CASE WHEN valid THEN CASE WHEN as_is THEN y1 ELSE greatest(0.0, y1 - margin) END END, 6) AS top, round(CASE WHEN valid THEN CASE WHEN as_is THEN y2 ELSE least(1.0, y2 + margin * 0.5) END END, 6) AS bottom FROM m"""),
    "scale_selection": (scale_selection, "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 3 WHEN (c_nationkey < 12 AND c_custkey % 3 = 0) OR c_custkey % 2000 >= 960 THEN 1 ELSE 2 END AS scale FROM customer"),
    "layout_outliers": (layout_outliers, f"WITH {_LEARNED} SELECT stream_id, event_id, reason FROM judged WHERE reason IS NOT NULL"),
    "scene_track_closure": (scene_track_closure, f"""WITH RECURSIVE {_LEARNED}, {_CAUGHT}
      SELECT stream_id, event_id, coalesce(reason, 'scene_text_track') AS reason FROM judged WHERE (stream_id, event_id) IN (SELECT (stream_id, event_id) FROM caught)"""),
    "renumbered_events": (renumbered_events, f"""WITH RECURSIVE {_LEARNED}, {_CAUGHT}
      SELECT stream_id, event_id, row_number() OVER (PARTITION BY stream_id ORDER BY start_cs, event_id) AS id FROM judged WHERE (stream_id, event_id) NOT IN (SELECT (stream_id, event_id) FROM caught)"""),
    "robust_typical_height": (robust_typical_height, f"""WITH {LAYOUTS}, m AS (SELECT stream_id, median(h) AS m, count(*) AS n FROM layouts GROUP BY stream_id HAVING count(*) >= 4)
      SELECT l.stream_id, median(h) AS typical, count(*) AS near FROM layouts l JOIN m ON l.stream_id = m.stream_id AND h BETWEEN m * 0.75 AND m * 1.3 GROUP BY l.stream_id HAVING count(*) >= 4 AND count(*) >= max(n) * 0.65"""),
    "region_scores": (region_scores, f"""WITH {LAYOUTS} SELECT stream_id, CAST(floor(y / 10) AS BIGINT) AS cluster, count(DISTINCT x) AS unique_texts, count(DISTINCT event_id % 12) AS coverage,
      round(count(DISTINCT x) * count(DISTINCT event_id % 12) * sqrt(median(h)), 4) AS score FROM layouts GROUP BY stream_id, floor(y / 10)"""),
    "mask_xor_ratio": (mask_xor_ratio, """WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS m FROM embeddings),
      p AS (SELECT a.vec_id, list_sum(list_transform(list_zip(a.m, b.m), lambda t: CAST(t[1] OR t[2] AS INTEGER))) AS both_of, list_sum(list_transform(list_zip(a.m, b.m), lambda t: CAST(t[1] <> t[2] AS INTEGER))) AS one_of
        FROM m a JOIN m b ON b.vec_id = a.vec_id + 1) SELECT vec_id, CASE WHEN both_of >= 20 THEN round(one_of / both_of, 6) END AS ratio FROM p"""),
}
