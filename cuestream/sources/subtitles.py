"""Subtitle files as tables of cues, and cues as files."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuestream.functions import text as T

CUE = "path string, start double, end double, text string"
#: What an observation cache holds for each frame.
LINE = "struct<box: struct<x: double, y: double, w: double, h: double>, candidates: array<struct<text: string, confidence: double>>>"
# Extensions of video files.
VIDEO_EXTENSIONS = ("mp4", "mkv", "mov", "m4v", "avi", "webm", "ts", "m2ts")


def _seconds(code: str) -> float:
    h, m, s = code.strip().replace(",", ".").split(":")
    return int(h) * 3600 + int(m) * 60 + float(s)


def parse_srt(data: str) -> list[tuple[float, float, str]]:
    """Cues of blocks that blank lines part; what stands before the line of times is not read."""
    cues = []
    for block in re.split(r"\n\s*\n", data.replace("\r\n", "\n").strip()):
        head, arrow, rest = block.partition("-->")
        if arrow:
            times, _, text = rest.partition("\n")
            cues.append((_seconds(head.splitlines()[-1]), _seconds(times.split()[0]), text))
    return cues


def parse_ass(data: str) -> list[tuple[float, float, str]]:
    """Dialogue lines of the events section, by the columns that its format line names."""
    section = re.split(r"(?im)^\[events\][ \t]*$", data, maxsplit=1)[1:]
    if not section:
        return []
    lines = re.split(r"(?m)^\[", section[0])[0].splitlines()
    fields: list[str] | None = None
    cues = []
    for line in lines:
        kind, _, rest = line.partition(":")
        if kind == "Format":
            fields = [f.strip().lower() for f in rest.split(",")]
        elif kind == "Dialogue":
            if not fields:
                raise ValueError("ASS events need a Format line")
            row = dict(zip(fields, rest.lstrip().split(",", len(fields) - 1), strict=False))
            text = re.sub(r"\{[^}]*\}", "", row["text"])
            for code, plain in (("\\N", "\n"), ("\\n", "\n"), ("\\h", " ")):
                text = text.replace(code, plain)
            cues.append((_seconds(row["start"]), _seconds(row["end"]), text))
    return cues


def parse(path: str, data: str) -> list[tuple[float, float, str]]:
    """The cues of a file by its extension, in order of time; an error where there are none or times are wrong."""
    data, extension = data.removeprefix("﻿"), path.rsplit(".", 1)[-1].lower()
    if extension == "json":
        cues = [(float(e["start"]), float(e["end"]), e["text"]) for e in json.loads(data)["events"]]
    else:
        cues = parse_ass(data) if extension in ("ass", "ssa") else parse_srt(data)
    if not cues:
        raise ValueError(f"no cues in {path}")
    if any(not (0 <= a <= b < float("inf")) for a, b, _ in cues):
        raise ValueError(f"times that cannot be in {path}")
    return sorted(cues, key=lambda c: c[:2])


def read_cues(spark: SparkSession, path: str) -> DataFrame:
    """The cues of SRT, ASS, SSA or JSON files, one file to a task's row at a time."""

    def run(batches):
        for pdf in batches:
            rows = [(p, a, b, t) for p, c in zip(pdf["path"], pdf["content"], strict=True) for a, b, t in parse(p, bytes(c).decode("utf-8"))]
            yield pd.DataFrame(rows, columns=["path", "start", "end", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, CUE)


def list_videos(spark: SparkSession, folder: str) -> DataFrame:
    """Video files below a folder in natural order: source, relative, series (the first folder below it)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    kept = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*VIDEO_EXTENSIONS))
    root = F.lit(folder.rstrip("/").rsplit("/", 1)[-1])
    relative = F.regexp_extract("path", "/" + re.escape(folder.rstrip("/").rsplit("/", 1)[-1]) + "/(.*)$", 1)
    series = F.when(F.instr(relative, "/") > 0, F.concat(root, F.lit("/"), F.split(relative, "/")[0])).otherwise(root)
    return kept.select(F.col("path").alias("source"), F.concat(root, F.lit("/"), relative).alias("relative"), series.alias("series")).orderBy(T.natural_key(F.col("relative")))


def import_entries(spark: SparkSession, folders: list[str], durations: DataFrame | None = None) -> DataFrame:
    """The videos of several files and folders, each once: source, relative, series, duration (of a table source, duration; 0 where
    it is not known)."""
    found = [list_videos(spark, f) if not re.search(r"\.(?:" + "|".join(VIDEO_EXTENSIONS) + ")$", f.lower()) else _one_video(spark, f) for f in folders]
    entries = found[0]
    for more in found[1:]:
        entries = entries.union(more)
    entries = entries.dropDuplicates(["source"])
    known = durations if durations is not None else spark.createDataFrame([], "source string, duration double")
    return entries.join(known, "source", "left").select("source", "relative", "series", F.coalesce("duration", F.lit(0.0)).alias("duration"))


def _one_video(spark: SparkSession, path: str) -> DataFrame:
    parent, _, name = path.rpartition("/")
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), F.lit(name).alias("relative"), F.lit(parent.rsplit("/", 1)[-1]).alias("series"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """source, source_sha256, bytes of every file of a path: the hash of its whole content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("source"), F.sha2("content", 256).alias("source_sha256"), F.col("length").alias("bytes"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """The words of a text file, one to a line; blank lines are none."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")


def exported(records: DataFrame, format: str = "both") -> DataFrame:
    """The files of stored results (stream_id, start_ms, end_ms, turn, text) in the formats asked for: stream_id, format, body. Nothing is
    recognised again."""
    from cuestream.operators import cues as C

    if format not in ("srt", "ass", "both"):
        raise ValueError("the format must be srt, ass or both")
    out = []
    if format != "ass":
        out.append(C.srt_body(records).select("stream_id", F.lit("srt").alias("format"), "body"))
    if format != "srt":
        lines = C.ass_lines(records).join(records.select("stream_id", "turn", "start_ms"), ["stream_id", "turn"])
        inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "turn", "line"))), lambda x: x["line"]), "\n")
        out.append(lines.groupBy("stream_id").agg(F.concat(inner, F.lit("\n")).alias("body")).select("stream_id", F.lit("ass").alias("format"), "body"))
    return out[0] if len(out) == 1 else out[0].union(out[1])


def read_cache(rows: DataFrame) -> DataFrame:
    """A frame cache (stream_id, idx, t, end, data) as observations: the recogniser's JSON parsed once, its lines'
    text and least confidence. Lines need a confidence of 0.5 and a letter or digit; they are read in rows."""
    lines = F.from_json("data", f"struct<lines: array<{LINE}>>")["lines"]
    return with_text(rows.select("stream_id", F.col("idx").alias("frame"), F.col("t").alias("start"), "end", F.coalesce(lines, F.array().cast(f"array<{LINE}>")).alias("lines")))


def with_text(rows: DataFrame) -> DataFrame:
    """rows with text and confidence from their lines."""
    first = lambda x: F.get(x["candidates"], F.lit(0))
    good = F.filter("lines", lambda x: (first(x)["confidence"] >= 0.5) & first(x)["text"].rlike(r"[\p{L}\p{N}]"))
    items = F.array_sort(F.transform(good, lambda x: F.struct((x["box"]["y"] + x["box"]["h"] / 2).alias("cy"), x["box"]["h"].alias("h"), x["box"]["x"].alias("x"), first(x)["text"].alias("text"), first(x)["confidence"].alias("confidence"))))
    # A line belongs to the current row if its centre is near that of the row's first line.
    row = "struct<cy: double, h: double, items: array<struct<x: double, text: string>>>"

    def step(rows_: Column, i: Column) -> Column:
        last = F.element_at(rows_, -1)
        near = (F.size(rows_) > 0) & (F.abs(i["cy"] - F.when(F.size(rows_) > 0, last["cy"])) < F.least(i["h"], F.when(F.size(rows_) > 0, last["h"])) * 0.45)
        item = F.struct(i["x"].alias("x"), i["text"].alias("text"))
        joined = F.struct(last["cy"].alias("cy"), last["h"].alias("h"), F.concat(last["items"], F.array(item)).alias("items"))
        alone = F.struct(i["cy"].alias("cy"), i["h"].alias("h"), F.array(item).alias("items"))
        head = F.slice(rows_, 1, F.greatest(F.size(rows_) - 1, F.lit(0)))
        return F.when(near, F.concat(head, F.array(joined))).otherwise(F.concat(rows_, F.array(alone)))

    grouped = F.aggregate(items, F.array().cast(f"array<{row}>"), step)
    said = F.array_join(F.transform(grouped, lambda r: F.array_join(F.transform(F.array_sort(r["items"]), lambda i: i["text"]), " ")), "\n")
    least = F.coalesce(F.array_min(F.transform(items, lambda i: i["confidence"])), F.lit(0.0))
    return rows.select(*[c for c in rows.columns if c not in ("text", "confidence")], T.normalize(said).alias("text"), least.alias("confidence"))


def write_srt(bodies: DataFrame, path: str) -> None:
    """One folder for each stream with its SRT text, by the file commit protocol: a reader sees whole files only."""
    bodies.select("stream_id", "body").repartition("stream_id").write.mode("overwrite").partitionBy("stream_id").option("lineSep", "").text(path)
