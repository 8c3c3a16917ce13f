"""The queue around the extraction: progress, settings, naming, reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuestream.functions import text as T
from cuestream.operators.ranks import numbered

# Language codes and the recognition routes that they take; what counts as a video.
ROUTES = {
    "auto": "ch_v6", "zh-Hans": "ch_v6", "en-US": "en_v5", "ko-KR": "ko_v5", "th-TH": "th_v5", "zh-Hant": "cht_v4", "ja-JP": "ja_v4",
    "es-ES": "latin_v5", "fr-FR": "latin_v5", "de-DE": "latin_v5", "pt-BR": "latin_v5", "it-IT": "latin_v5", "zh-Hans,en-US": "ch_v6",
}
STATUSES = ("pending", "running", "paused", "done", "failed", "interrupted", "pausing", "stopping")


def progress(jobs: DataFrame, *group: str) -> DataFrame:
    """progress of each group from 0 to 1000, by duration: a job without one counts as the mean of the known
    (else 1), one that isn't done as 99 % at most, and 1000 is reached only when all are done."""
    known = jobs.groupBy(*group).agg(F.avg(F.when(F.col("duration") > 0, F.col("duration"))).alias("mean"))
    filled = jobs.join(known, list(group)) if group else jobs.crossJoin(F.broadcast(known))
    duration = F.when(F.col("duration") > 0, F.col("duration").cast("double")).otherwise(F.coalesce("mean", F.lit(1.0)))
    done = F.col("status") == "done"
    # The share of the whole in millionths, so that sums don't depend on their order.
    part = F.when(done, duration).otherwise(F.least(duration * 0.99, F.greatest(F.lit(0.0), F.col("processed").cast("double"))))
    sums = filled.select(*group, F.round(duration * 1000).cast("long").alias("d"), F.round(part * 1000).cast("long").alias("p"), done.alias("done"))
    out = sums.groupBy(*group).agg(F.count("*").alias("jobs"), F.count_if("done").alias("finished"), F.sum("d").alias("d"), F.sum("p").alias("p"))
    most = F.when(F.col("jobs") == F.col("finished"), 1000).otherwise(999)
    return out.select(*group, "jobs", "finished", F.least(most, F.bround(F.col("p") * 1000 / F.col("d"))).cast("int").alias("progress"))


def duplicates(jobs: DataFrame, *keys: str) -> DataFrame:
    return jobs.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing(jobs: DataFrame, group: str, number: str) -> DataFrame:
    """Numbers between the least and the greatest of each group that it doesn't have."""
    spans = jobs.groupBy(group).agg(F.min(number).alias("low"), F.max(number).alias("high"))
    wanted = spans.select(group, F.explode(F.sequence("low", "high")).alias(number))
    return wanted.join(jobs.select(group, number).distinct(), [group, number], "left_anti")


def output_stems(entries: DataFrame, folder: str = "_同名视频") -> DataFrame:
    """entries (source, relative) with stem: the path without extension; where several have one, without regard
    to case, a folder named by the source's hash is put before the name. Absolute and upward paths are refused."""
    stem = F.regexp_replace("relative", r"(?<=[^/])\.[^./]+$", "")
    stem = F.when(F.col("relative").rlike(r"^/|(^|/)\.\.(/|$)"), F.raise_error("paths must lie within the output folder")).otherwise(stem)
    rows = entries.withColumn("stem", stem).withColumn("same", F.count("*").over(W.partitionBy(T.fold(T.nfc(F.col("stem"))))))
    parent, name = F.regexp_extract("stem", r"^(.*/)?[^/]*$", 1), F.regexp_extract("stem", "([^/]*)$", 1)
    own = F.concat(parent, F.lit(folder + "/"), T.short_hash(F.col("source")), F.lit("/"), name)
    return rows.select("source", "relative", F.when(F.col("same") > 1, own).otherwise(F.col("stem")).alias("stem"))


def apply_settings(jobs: DataFrame, changes: dict[str, str], scope: Column) -> DataFrame:
    """Jobs in scope take changed settings (columns language, engine, format, output): a new language or engine
    means to recognise again, others to export again only; done, failed and interrupted jobs wait again."""
    differs = {k: scope & ~F.col(k).eqNullSafe(F.lit(v)) for k, v in changes.items()}
    some = F.lit(False)
    for d in differs.values():
        some = some | d
    again = F.lit(False)
    for k in ("language", "engine"):
        again = again | differs.get(k, F.lit(False))
    replaced = F.coalesce(F.col("replace_output"), F.lit(False))
    flags = jobs.withColumn("__some", some).withColumn("__again", again)
    was_done = F.col("__some") & (F.col("status") == "done")
    only = was_done & ~F.col("__again") & ~replaced
    fresh = was_done | (F.col("__again") & (F.col("status") == "pending"))
    out = flags.select(
        *[c for c in jobs.columns if c not in {*changes, "status", "processed", "replace_output", "export_only"}],
        *[F.when(d, F.lit(changes[k])).otherwise(F.col(k)).alias(k) for k, d in differs.items()],
        F.when(F.col("__some") & F.col("status").isin("done", "failed", "interrupted"), "pending").otherwise(F.col("status")).alias("status"),
        F.when(fresh, F.lit(0)).otherwise(F.col("processed")).alias("processed"),
        (F.col("__again") | replaced).alias("replace_output"),
        F.when(F.col("__again"), F.lit(False)).when(only, F.lit(True)).otherwise(F.coalesce("export_only", F.lit(False))).alias("export_only"),
    )
    return out


def fold_events(events: DataFrame) -> DataFrame:
    """Worker events (job, seq, type, value) to the state of each job: scanning fills 0.08 to 0.80 of the progress,
    checking goes on to 0.98, a result is 0.99; progress never falls, and the last ending decides the status."""
    fraction = (
        F.when(F.col("type") == "progress", 0.08 + 0.72 * F.col("value")).when(F.col("type") == "verify_progress", 0.80 + 0.18 * F.col("value")).when(F.col("type") == "result", 0.99).otherwise(0.0)
    )
    ends = F.max(F.when(F.col("type").isin("result", "error", "paused"), F.struct("seq", "type")))
    out = events.groupBy("job").agg(F.count("*").alias("events"), F.round(F.max(fraction), 6).alias("work_fraction"), ends.alias("e"))
    status = F.when(F.col("e.type") == "result", "done").when(F.col("e.type") == "error", "failed").when(F.col("e.type") == "paused", "paused").otherwise("running")
    return out.select("job", "events", "work_fraction", status.alias("status"))


def relink(jobs: DataFrame, files: DataFrame, old_parent: str, new_parent: str, series: Column) -> DataFrame:
    """Jobs of a series whose file lies under the old folder and, by the same name, exists in the new one; a path
    that another series' job has is not taken, and one path goes to one job."""
    name = F.regexp_extract("source", "([^/]*)$", 1)
    moved = jobs.where(series & F.startswith("source", F.lit(old_parent + "/"))).select("id", "source", F.concat(F.lit(new_parent + "/"), name).alias("candidate"))
    taken = jobs.where(~series).select(F.col("source").alias("candidate"))
    found = moved.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate", "left_semi").join(taken, "candidate", "left_anti")
    first = F.row_number().over(W.partitionBy("candidate").orderBy("id"))
    return found.withColumn("k", first).where("k = 1").select("id", "source", F.col("candidate").alias("new_source"))


def restore(jobs: DataFrame, removed: DataFrame) -> DataFrame:
    """Removed jobs go back to their places (pos), unless a job of their source is there."""
    back = removed.join(jobs.select("source"), "source", "left_anti")
    both = jobs.withColumn("back", F.lit(1)).unionByName(back.withColumn("back", F.lit(0)))
    return numbered(both.withColumnRenamed("pos", "at"), "at", "back", "id", name="pos").withColumn("pos", (F.col("pos") - 1).cast("int")).drop("at", "back")


def cache_inventory(caches: DataFrame, jobs: DataFrame) -> DataFrame:
    """Caches of finished sources that no waiting job uses, by source or by content."""
    waiting = jobs.where("status <> 'done'").select("source").distinct()
    used = caches.join(waiting, "source", "left_semi").select("sha256").distinct()
    finished = caches.join(jobs.where("status = 'done'").select("source").distinct(), "source", "left_semi")
    return finished.join(waiting, "source", "left_anti").join(used, "sha256", "left_anti").select("source", "sha256")


def language_vote(samples: DataFrame, least_samples: int = 4, least_votes: int = 3, lead: int = 2) -> DataFrame:
    """The first sample at which a stream's language is settled: three distinct Korean texts, or, from the fourth
    sample on and without any Korean, three distinct texts of a language that leads by two.
    samples: stream_id, i (from 0), hint, text."""
    w = W.partitionBy("stream_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    seen = samples.withColumn("seen", F.array_distinct(F.collect_list(F.when(F.col("hint").isNotNull(), F.struct("hint", "text"))).over(w)))
    # At most twelve samples are drawn from a stream, so these arrays are short.
    hints = F.array_distinct(F.transform("seen", lambda x: x["hint"]))
    counts = F.transform(hints, lambda h: F.struct(F.size(F.filter(F.col("seen"), lambda x: x["hint"] == h)).alias("n"), h.alias("hint")))
    ranked = F.reverse(F.array_sort(counts))
    korean = F.size(F.filter("seen", lambda x: x["hint"] == "ko-KR"))
    top, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    other = (F.col("i") >= least_samples - 1) & (korean == 0) & (top["n"] >= least_votes) & (second.isNull() | (top["n"] >= second["n"] + lead))
    chosen = F.when(korean >= least_votes, "ko-KR").when(other, top["hint"])
    decided = seen.withColumn("language", chosen).where(F.col("language").isNotNull())
    return decided.groupBy("stream_id").agg(F.min(F.struct("i", "language")).alias("d")).select("stream_id", F.col("d.i").alias("after"), F.col("d.language").alias("language"))


def describe_error(text: Column) -> Column:
    """A class for an error by what its text says."""
    return (
        F.when(text.contains("PermissionError"), "permission").when(text.contains("FileNotFoundError"), "missing file").when(text.contains("No space left"), "disk full")
        .when(text.contains("Invalid data found"), "not decodable").otherwise("other")
    )


def flag_summary(counts: DataFrame, labels: dict[str, str]) -> DataFrame:
    """One line for each stream: labels with counts, the most frequent first. counts: stream_id, flag, n."""
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    said = F.concat(F.coalesce(names[F.col("flag")], F.col("flag")), F.lit(" "), F.col("n").cast("string"))
    lines = counts.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "flag", said.alias("said")))).alias("s"))
    return lines.select("stream_id", F.array_join(F.transform("s", lambda x: x["said"]), "; ").alias("line"))


def processing_summary(jobs: DataFrame, k: int = 12) -> DataFrame:
    """The first k jobs with how many times real time they took, and how many more there are."""
    first = jobs.orderBy("id").limit(k)
    factor = F.when((F.col("status") == "done") & (F.col("elapsed") > 0), F.round(F.col("duration") / F.col("elapsed"), 1))
    more = jobs.agg(F.greatest(F.lit(0), F.count("*") - k).alias("more"))
    return first.crossJoin(F.broadcast(more)).select("id", factor.alias("real_time_factor"), "more")


def config_hash(*columns: str) -> Column:
    """The identity of a job's configuration: what a cached result must have been made with."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in columns]), 256)
