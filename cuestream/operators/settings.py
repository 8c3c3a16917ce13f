"""Settings and records of jobs: what is asked for, what a stored result was made with, what may be used again."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from cuestream.functions import readings as R
from cuestream.functions import text as T

# Language codes with their labels, and what makes two calibrations one.
LANGUAGES = {
    "auto": "自动识别", "en-US": "英语", "zh-Hans": "简体中文", "zh-Hant": "繁體中文", "zh-Hans,en-US": "中英双语", "ja-JP": "日本語", "ko-KR": "韩语",
    "es-ES": "西班牙语", "fr-FR": "法语", "de-DE": "德语", "pt-BR": "葡萄牙语", "it-IT": "意大利语", "th-TH": "泰语",
}
UNDECIDED = "未判断"
CALIBRATION = ("roi", "font_height", "mask_density", "aspect", "region_revision", "font_calibrated")
IDENTITY = ("source_sha256", "roi", "languages", "scale", "words", "engine_route", "tool_version")
SETTINGS = ("language", "engine", "format", "output")
STRATEGY = "accurate"
ALL_CAPS, KOREAN_VOTES = 15, 3


def language_name(code: Column) -> Column:
    """The labels of one code or several; a code without one stays as it is."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    each = F.array_join(F.transform(F.split(code, ","), lambda c: F.coalesce(names[c], c)), "、")
    return F.when(F.coalesce(code, F.lit("")) == "", UNDECIDED).otherwise(each)


def unknown_languages(codes: Column) -> Column:
    """The codes (comma-separated) that are not supported, in order; null if there are no codes at all, which is not valid either."""
    supported = sorted({c for code in LANGUAGES for c in code.split(",")})
    asked = F.filter(F.split(F.coalesce(codes, F.lit("")), ","), lambda c: c != "")
    return F.when(F.size(asked) > 0, F.array_sort(F.array_except(asked, F.array(*map(F.lit, supported)))))


def selected_formats(value: Column) -> Column:
    known = F.when(value.isin("srt", "ass"), F.array(value)).when(value == "both", F.array(F.lit("srt"), F.lit("ass")))
    return F.coalesce(known, F.raise_error(F.lit("the format must be srt, ass or both")).cast("array<string>"))


def private_stem(path: Column, export_stem: Column, root: str) -> Column:
    """Where a result is kept: a folder for the source's path, and the name that it is exported under."""
    return F.concat(F.lit(f"{root}/results/"), T.short_hash(path, 24), F.lit("/"), F.regexp_extract(export_stem, "([^/]*)$", 1))


def with_defaults(jobs: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """jobs whose settings, where they have none of their own, are the defaults."""
    own = {k: F.coalesce(F.col(k), F.lit(defaults[k])) if k in jobs.columns else F.lit(defaults[k]) for k in SETTINGS}
    return jobs.withColumns(own)


def mark_for_reprocessing(jobs: DataFrame, selected: Column) -> DataFrame:
    """Selected jobs wait to be recognised again and replace what they had put out."""
    new = {"status": F.lit("pending"), "processed": F.lit(0).cast("long"), "work_fraction": F.lit(None).cast("double"), "replace_output": F.lit(True), "error": F.lit(None).cast("string"), "export_only": F.lit(False)}
    return jobs.select(*[F.when(selected, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


def split_series(jobs: DataFrame, selected: Column, series: Column) -> DataFrame:
    """Selected jobs become a series of their own, without the region of the one that they leave."""
    gone = ("roi", "detected_roi", "roi_override")
    return jobs.select(*[F.when(selected, series).otherwise(F.col(c)).alias(c) if c == "series" else F.when(~selected, F.col(c)).alias(c) if c in gone else F.col(c) for c in jobs.columns])


def clear_override(jobs: DataFrame, selected: Column) -> DataFrame:
    """Selected jobs that have a region of their own lose it and are recognised again."""
    hit = selected & F.col("roi_override").isNotNull()
    return mark_for_reprocessing(jobs.withColumn("__hit", F.coalesce(hit, F.lit(False))), F.col("__hit")).withColumn("roi_override", F.when(~F.col("__hit"), F.col("roi_override"))).drop("__hit")


def matching_calibration(a: Column, b: Column) -> Column:
    same = F.lit(True)
    for k in CALIBRATION:
        same = same & a[k].eqNullSafe(b[k])
    return same


def reusable(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """Jobs (id, IDENTITY, strategy, calibration) for which a stored result was made from the same source in the same way: nulls
    are values, no strategy is the usual one, and a calibration is compared where the job has one."""
    identity = lambda df: F.sha2(F.to_json(F.struct(*[df[c] for c in IDENTITY], F.coalesce(df["strategy"], F.lit(STRATEGY)).alias("strategy")), {"ignoreNullFields": "false"}), 256)
    a, s = asked.withColumn("__i", identity(asked)), stored.select(identity(stored).alias("__j"), F.col("calibration").alias("__c"))
    fits = F.col("calibration").isNull() | matching_calibration(F.col("calibration"), F.col("__c"))
    return a.join(s, (F.col("__i") == F.col("__j")) & F.coalesce(fits, F.lit(False)), "left_semi").drop("__i")


def event_lines(events: DataFrame, prefix: str) -> DataFrame:
    """Worker events as lines: a prefix, and JSON with the type first and without what is null."""
    values = [c for c in events.columns if c != "type"]
    return events.select(F.concat(F.lit(prefix), F.to_json(F.struct("type", *values))).alias("line"))


def evidence_flags(text: Column, alternate: Column, raster: Column) -> Column:
    """Flags of an event whose second readings differ, or that is all in capitals, in order of their names."""
    cased = F.regexp_replace(text, r"[^\p{Lu}\p{Ll}\p{Lt}]", "")
    found = [
        ("all_caps_check", (F.length(T.key(text)) >= ALL_CAPS) & (F.length(cased) > 0) & ~cased.rlike(r"[\p{Ll}\p{Lt}]")),
        ("language_check_disagreement", T.key(alternate) != T.key(text)), ("raster_check_disagreement", T.key(raster) != T.key(text)),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in found]), lambda x: x.isNotNull())


@F.pandas_udf(BooleanType())
def agrees(first: pd.Series, second: pd.Series, confidence: pd.Series) -> pd.Series:
    return pd.Series([R.agrees_in_hangul(a or "", b or "", c or 0.0) for a, b, c in zip(first, second, confidence, strict=True)])


def korean_vote(samples: DataFrame) -> DataFrame:
    """The sample (stream_id, i, first, second, confidence) at which three distinct readings of a stream have been read in
    Hangul by both readers: stream_id, after."""
    good = samples.where(agrees("first", "second", "confidence")).select("stream_id", "i", T.key(F.col("second")).alias("k"))
    new = good.groupBy("stream_id", "k").agg(F.min("i").alias("i"))
    nth = F.row_number().over(W.partitionBy("stream_id").orderBy("i", "k"))
    return new.withColumn("nth", nth).where(F.col("nth") == KOREAN_VOTES).select("stream_id", F.col("i").alias("after"))


def true_spans(values: Column) -> Column:
    """array<struct<start, stop>>: the maximal runs of true in an array of booleans; stop is the first place after."""
    on = lambda i: F.coalesce(F.get(values, i), F.lit(False))
    places = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: on(i) & ~on(i - 1))
    stops = F.transform(F.filter(places, lambda i: on(i) & ~on(i + 1)), lambda i: i + 1)
    return F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("stop")))
