"""Queries on jobs of the queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuestream.operators import jobs as Q
from cuestream.plans.carriers import JOBS, jobs, table

VIDEO = """
videos AS (
  SELECT p_partkey AS id, '/media/' || p_brand || '/' || replace(p_name, ' ', '_') || '-' || p_size || '.mkv' AS source,
    p_brand || '/' || CASE WHEN p_partkey % 2 = 0 THEN upper(substr(p_type, 1, 6)) ELSE lower(substr(p_type, 1, 6)) END || p_size || '.mp4' AS relative,
    CASE WHEN p_partkey % 3 = 0 THEN 'done' ELSE 'pending' END AS status, p_brand AS series
  FROM part
)"""


def videos(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    source = F.concat(F.lit("/media/"), "p_brand", F.lit("/"), F.regexp_replace("p_name", " ", "_"), F.lit("-"), F.col("p_size").cast("string"), F.lit(".mkv"))
    kind = F.substring("p_type", 1, 6)
    relative = F.concat("p_brand", F.lit("/"), F.when(F.col("p_partkey") % 2 == 0, F.upper(kind)).otherwise(F.lower(kind)), F.col("p_size").cast("string"), F.lit(".mp4"))
    return p.select(F.col("p_partkey").alias("id"), source.alias("source"), relative.alias("relative"), F.when(F.col("p_partkey") % 3 == 0, "done").otherwise("pending").alias("status"), F.col("p_brand").alias("series"))


def duplicate_keys(spark, sf_dir):
    return Q.duplicates(jobs(spark, sf_dir), "season", "episode")


def missing_in_range(spark, sf_dir):
    return Q.missing(jobs(spark, sf_dir), "season", "episode")


def series_totals(spark, sf_dir):
    return jobs(spark, sf_dir).groupBy("series").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("done"), F.min("id").alias("first_id"))


def weighted_progress(spark, sf_dir):
    return Q.progress(jobs(spark, sf_dir), "series")


def project_progress(spark, sf_dir):
    return Q.progress(jobs(spark, sf_dir))


def output_collisions(spark, sf_dir):
    return Q.output_stems(videos(spark, sf_dir).select("source", "relative"))


def settings_change(spark, sf_dir):
    j = jobs(spark, sf_dir).select("id", "series", "status", "processed", "language", F.lit("rapid").alias("engine"), (F.col("id") % 11 == 0).alias("replace_output"), F.lit(False).alias("export_only"), F.when(F.col("id") % 2 == 0, "srt").otherwise("ass").alias("format"))
    return Q.apply_settings(j, {"language": "1-URGENT", "format": "srt"}, F.col("series") % 2 == 0)


def worker_event_fold(spark, sf_dir):
    return Q.fold_events(worker_events(table(spark, sf_dir, "events")))


def worker_events(events):
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("progress", "verify_progress", "phase", "progress", "heartbeat")]), (F.col("event_id") % 5 + 1).cast("int"))
    kind = F.when(F.col("event_id") % 97 == 0, "result").when(F.col("event_id") % 89 == 0, "error").when(F.col("event_id") % 83 == 0, "paused").otherwise(kinds)
    return events.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), kind.alias("type"), (F.round(F.col("value") * 100) % 1000 / 1000).alias("value"))


def relink_sources(spark, sf_dir):
    v = videos(spark, sf_dir)
    files = v.where("id % 4 <> 0").select(F.regexp_replace("source", "^/media/", "/moved/").alias("path"))
    brand = table(spark, sf_dir, "part").agg(F.min("p_brand").alias("b")).first()["b"]
    return Q.relink(v, files, f"/media/{brand}", f"/moved/{brand}", F.col("series") == brand)


def restore_removed(spark, sf_dir):
    v = videos(spark, sf_dir).withColumn("pos", F.col("id") - 1).select("id", "source", "pos")
    return Q.restore(v.where("id % 5 <> 0"), v.where("id % 5 = 0 or id % 7 = 0"))


def cache_inventory(spark, sf_dir):
    v = videos(spark, sf_dir)
    caches = v.where("id % 2 = 0").select("source", F.sha2(F.concat(F.lit("content-"), (F.col("id") % 600).cast("string")), 256).alias("sha256"))
    return Q.cache_inventory(caches.dropDuplicates(["source", "sha256"]), v)


def language_vote(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    from pyspark.sql import Window as W

    i = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    hint = F.element_at(F.array(*[F.lit(x) for x in ("en-US", "ja-JP", None, "zh-Hans", "ko-KR")]), F.when(F.col("event_id") % 3 == 0, 1).otherwise(F.col("event_id") % 5 + 1).cast("int"))
    s = e.select(F.col("user_id").alias("stream_id"), i.alias("i"), hint.alias("hint"), (F.round(F.col("value")) % 9).cast("long").cast("string").alias("text")).where("i < 12")
    return Q.language_vote(s)


def route_selection(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.create_map(*[F.lit(x) for x in ("en", "en-US", "de", "de-DE", "fr", "fr-FR", "es", "es-ES")]), F.col("lang")).alias("language"))
    names = F.create_map(*[F.lit(x) for pair in Q.ROUTES.items() for x in pair])
    return d.select("doc_id", "language", names[F.col("language")].alias("route"))


def processing_summary(spark, sf_dir):
    j = jobs(spark, sf_dir).select("id", "status", "duration", F.col("processed").alias("elapsed"))
    return Q.processing_summary(j)


def result_reuse(spark, sf_dir):
    """Jobs whose configuration is that of a stored result need no new recognition."""
    j = jobs(spark, sf_dir).select("id", Q.config_hash("series", "language", "season").alias("config"))
    stored = jobs(spark, sf_dir).where("status = 'done'").select(Q.config_hash("series", "language", "season").alias("config")).distinct()
    return j.join(stored, "config", "left_semi").select("id", "config")


def series_region(spark, sf_dir):
    """An override, else the series' record, else the job's own."""
    j = jobs(spark, sf_dir).select("id", "series", F.when(F.col("id") % 13 == 0, "override").alias("override"), F.lit("own").alias("own"))
    regions = table(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("series"), F.col("c_mktsegment").alias("region"))
    return j.join(regions, "series", "left").select("id", F.coalesce("override", "region", "own").alias("region"))


def exact_content_dedup(spark, sf_dir):
    """Rows of equal content share the result of the first."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    first = d.groupBy("sha256").agg(F.min("doc_id").alias("recognised"))
    return d.join(first, "sha256").select("doc_id", "recognised")


_STATUS_SQL = "CASE WHEN arg_max(type, seq) FILTER (type IN ('result', 'error', 'paused')) = 'result' THEN 'done' WHEN arg_max(type, seq) FILTER (type IN ('result', 'error', 'paused')) = 'error' THEN 'failed' WHEN arg_max(type, seq) FILTER (type IN ('result', 'error', 'paused')) = 'paused' THEN 'paused' ELSE 'running' END"


def _progress_sql(group: str) -> str:
    by, keys = (f"PARTITION BY {group}", f"{group}, ") if group else ("", "")
    return f"""WITH {JOBS}, filled AS (SELECT *, CASE WHEN duration > 0 THEN CAST(duration AS DOUBLE) ELSE coalesce(avg(CASE WHEN duration > 0 THEN duration END) OVER ({by}), 1.0) END AS d FROM jobs),
      parts AS (SELECT {keys}status = 'done' AS done, CAST(round(d * 1000) AS BIGINT) AS d, CAST(round(CASE WHEN status = 'done' THEN d ELSE least(d * 0.99, greatest(0.0, CAST(processed AS DOUBLE))) END * 1000) AS BIGINT) AS p FROM filled)
      SELECT {keys}count(*) AS jobs, count(*) FILTER (done) AS finished, CAST(least(CASE WHEN count(*) = count(*) FILTER (done) THEN 1000 ELSE 999 END, round_even(sum(p) * 1000 / sum(d), 0)) AS INTEGER) AS progress
      FROM parts {'GROUP BY ' + group if group else ''}"""


TWINS = {
    "duplicate_keys": (duplicate_keys, f"WITH {JOBS} SELECT season, episode, count(*) AS n FROM jobs GROUP BY season, episode HAVING count(*) > 1"),
    "missing_in_range": (missing_in_range, f"""WITH {JOBS}, wanted AS (SELECT season, CAST(unnest(range(min(episode), max(episode) + 1)) AS INTEGER) AS episode FROM jobs GROUP BY season)
      SELECT * FROM wanted EXCEPT SELECT season, episode FROM jobs"""),
    "series_totals": (series_totals, f"WITH {JOBS} SELECT series, count(*) AS total, count(*) FILTER (status = 'done') AS done, min(id) AS first_id FROM jobs GROUP BY series"),
    "weighted_progress": (weighted_progress, _progress_sql("series")),
    "project_progress": (project_progress, _progress_sql("")),
    "output_collisions": (output_collisions, f"""WITH {VIDEO}, stems AS (SELECT source, relative, regexp_replace(relative, '\\.[^./]+$', '') AS stem FROM videos),
      counted AS (SELECT *, count(*) OVER (PARTITION BY lower(stem)) AS same FROM stems)
      SELECT source, relative, CASE WHEN same > 1 THEN regexp_extract(stem, '^(.*/)?[^/]*$', 1) || '_同名视频/' || substr(sha256(source), 1, 12) || '/' || regexp_extract(stem, '([^/]*)$', 1) ELSE stem END AS stem FROM counted"""),
    "settings_change": (settings_change, f"""WITH {JOBS}, j AS (SELECT id, series, status, processed, language, 'rapid' AS engine, id % 11 = 0 AS replace_output, CASE WHEN id % 2 = 0 THEN 'srt' ELSE 'ass' END AS format,
        series % 2 = 0 AND language <> '1-URGENT' AS again, series % 2 = 0 AND (language <> '1-URGENT' OR id % 2 <> 0) AS hit FROM jobs)
      SELECT id, series, engine, CASE WHEN again THEN '1-URGENT' ELSE language END AS language, CASE WHEN series % 2 = 0 THEN 'srt' ELSE format END AS format,
        CASE WHEN hit AND status IN ('done', 'failed', 'interrupted') THEN 'pending' ELSE status END AS status,
        CASE WHEN hit AND (status = 'done' OR (again AND status = 'pending')) THEN 0 ELSE processed END AS processed,
        again OR replace_output AS replace_output, hit AND NOT again AND status = 'done' AND NOT replace_output AS export_only FROM j"""),
    "worker_event_fold": (worker_event_fold, f"""WITH e AS (SELECT user_id AS job, event_id AS seq, CASE WHEN event_id % 97 = 0 THEN 'result' WHEN event_id % 89 = 0 THEN 'error' WHEN event_id % 83 = 0 THEN 'paused'
        ELSE ['progress', 'verify_progress', 'phase', 'progress', 'heartbeat'][event_id % 5 + 1] END AS type, round(value * 100) % 1000 / 1000 AS value FROM events)
      SELECT job, count(*) AS events, round(max(CASE WHEN type = 'progress' THEN 0.08 + 0.72 * value WHEN type = 'verify_progress' THEN 0.80 + 0.18 * value WHEN type = 'result' THEN 0.99 ELSE 0.0 END), 6) AS work_fraction,
        {_STATUS_SQL} AS status FROM e GROUP BY job"""),
    "relink_sources": (relink_sources, f"""WITH {VIDEO}, files AS (SELECT DISTINCT replace(source, '/media/', '/moved/') AS path FROM videos WHERE id % 4 <> 0),
      moved AS (SELECT id, source, replace(source, '/media/', '/moved/') AS candidate FROM videos WHERE series = (SELECT min(p_brand) FROM part)),
      found AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY id) AS k FROM moved WHERE candidate IN (SELECT path FROM files))
      SELECT id, source, candidate AS new_source FROM found WHERE k = 1"""),
    "restore_removed": (restore_removed, f"""WITH {VIDEO}, v AS (SELECT id, source, id - 1 AS pos FROM videos), kept AS (SELECT *, 1 AS back FROM v WHERE id % 5 <> 0),
      again AS (SELECT *, 0 AS back FROM v WHERE (id % 5 = 0 OR id % 7 = 0) AND source NOT IN (SELECT source FROM kept))
      SELECT id, source, CAST(row_number() OVER (ORDER BY pos, back, id) - 1 AS INTEGER) AS pos FROM (SELECT * FROM kept UNION ALL SELECT * FROM again)"""),
    "cache_inventory": (cache_inventory, f"""WITH {VIDEO}, caches AS (SELECT DISTINCT source, sha256('content-' || id % 600) AS sha256 FROM videos WHERE id % 2 = 0), waiting AS (SELECT source FROM videos WHERE status <> 'done')
      SELECT source, sha256 FROM caches WHERE source IN (SELECT source FROM videos WHERE status = 'done') AND source NOT IN (SELECT source FROM waiting)
        AND sha256 NOT IN (SELECT sha256 FROM caches WHERE source IN (SELECT source FROM waiting))"""),
    "language_vote": (language_vote, """WITH numbered AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
        CASE WHEN event_id % 3 = 0 THEN 'en-US' ELSE ['en-US', 'ja-JP', NULL, 'zh-Hans', 'ko-KR'][event_id % 5 + 1] END AS hint, CAST(CAST(round(value) % 9 AS BIGINT) AS VARCHAR) AS text FROM events),
      s AS (SELECT * FROM numbered WHERE i < 12),
      votes AS (SELECT a.stream_id, a.i, b.hint, count(DISTINCT b.text) AS n FROM s a JOIN s b ON a.stream_id = b.stream_id AND b.i <= a.i AND b.hint IS NOT NULL GROUP BY a.stream_id, a.i, b.hint),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY stream_id, i ORDER BY n DESC, hint DESC) AS place FROM votes),
      each_one AS (SELECT stream_id, i, coalesce(max(n) FILTER (hint = 'ko-KR'), 0) AS korean, max(n) FILTER (place = 1) AS n1, max(hint) FILTER (place = 1) AS top, max(n) FILTER (place = 2) AS n2 FROM ranked GROUP BY stream_id, i),
      decided AS (SELECT stream_id, i, CASE WHEN korean >= 3 THEN 'ko-KR' WHEN i >= 3 AND korean = 0 AND n1 >= 3 AND (n2 IS NULL OR n1 >= n2 + 2) THEN top END AS language FROM each_one)
      SELECT stream_id, CAST(min(i) AS INTEGER) AS after, arg_min(language, i) AS language FROM decided WHERE language IS NOT NULL GROUP BY stream_id"""),
    "route_selection": (route_selection, "SELECT doc_id, CASE lang WHEN 'en' THEN 'en-US' WHEN 'de' THEN 'de-DE' WHEN 'fr' THEN 'fr-FR' WHEN 'es' THEN 'es-ES' END AS language, CASE lang WHEN 'en' THEN 'en_v5' WHEN 'de' THEN 'latin_v5' WHEN 'fr' THEN 'latin_v5' WHEN 'es' THEN 'latin_v5' END AS route FROM documents"),
    "processing_summary": (processing_summary, f"WITH {JOBS} SELECT id, CASE WHEN status = 'done' AND processed > 0 THEN round(duration / processed, 1) END AS real_time_factor, (SELECT greatest(0, count(*) - 12) FROM jobs) AS more FROM jobs ORDER BY id LIMIT 12"),
    "result_reuse": (result_reuse, f"""WITH {JOBS}, hashed AS (SELECT id, status, sha256(coalesce(CAST(series AS VARCHAR), '∅') || '|' || coalesce(language, '∅') || '|' || coalesce(CAST(season AS VARCHAR), '∅')) AS config FROM jobs)
      SELECT id, config FROM hashed WHERE config IN (SELECT config FROM hashed WHERE status = 'done')"""),
    "series_region": (series_region, f"WITH {JOBS} SELECT id, CASE WHEN id % 13 = 0 THEN 'override' ELSE coalesce((SELECT c_mktsegment FROM customer WHERE c_custkey = series AND c_nationkey < 10), 'own') END AS region FROM jobs"),
    "exact_content_dedup": (exact_content_dedup, "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS recognised FROM documents"),
}
