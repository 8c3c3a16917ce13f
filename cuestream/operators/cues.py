"""Measures, checks and formats of timed cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuestream.functions import text as T
from cuestream.operators.lineage import checkpointed


def metrics(cues: DataFrame, *group: str, short_ms: int = 200) -> DataFrame:
    """Cues, those under short_ms, their share (0 if there are none) and the median duration in milliseconds."""
    duration = F.col("end_ms") - F.col("start_ms")
    out = cues.groupBy(*group).agg(F.count("*").alias("cues"), F.count_if(duration < short_ms).alias("under"), F.median(duration).alias("median_ms"))
    return out.select(*group, "cues", "under", F.coalesce(F.col("under") / F.nullif("cues", F.lit(0)), F.lit(0.0)).alias("under_ratio"), F.coalesce("median_ms", F.lit(0.0)).alias("median_ms"))


def nearest_rank(column: str, fraction: float) -> Column:
    """The least value that at least the fraction of the values does not exceed."""
    return F.expr(f"percentile_disc({fraction}) WITHIN GROUP (ORDER BY {column})")


def nearest_ranks(rows: DataFrame, group: str, column: str, fractions: dict[str, float]) -> DataFrame:
    """nearest_rank for each group and fraction, also where few groups hold most of the values; null for a group without any.

    Values are counted, dealt by ranges of group and value, and only the ranges in which a rank falls are added up; one task
    sums no more than a count for each range and group."""
    value, n = F.col(column), F.when(F.col(column).isNotNull(), F.col("__n")).otherwise(0)
    counts = checkpointed(rows.groupBy(group, column).agg(F.count("*").alias("__n")))
    dealt = checkpointed(counts.repartitionByRange(group, column).withColumn("__n", n).withColumn("__part", F.spark_partition_id()))
    parts = dealt.groupBy(F.col(group).alias("__group"), F.col("__part").alias("__of")).agg(F.sum("__n").alias("__in"))
    w = W.partitionBy("__group")
    before = F.coalesce(F.sum("__in").over(w.orderBy("__of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = checkpointed(parts.select("__group", "__of", "__in", before.alias("__before"), F.sum("__in").over(w).alias("__total")))
    at = {name: F.greatest(F.lit(1.0), F.col("__total") * F.lit(float(f))) for name, f in fractions.items()}
    holds = F.lit(False)
    for place in at.values():
        holds = holds | ((F.col("__before") < place) & (F.col("__before") + F.col("__in") >= place))
    met = dealt.join(F.broadcast(ends.where(holds)), F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__of")))
    upto = F.col("__before") + F.sum("__n").over(W.partitionBy("__group", "__of").orderBy(column).rowsBetween(W.unboundedPreceding, 0))
    told = met.withColumn("__upto", upto).where(value.isNotNull())
    found = told.groupBy("__group").agg(*[F.min(F.when((F.col("__before") < place) & (F.col("__upto") >= place), value)).alias(name) for name, place in at.items()])
    groups = ends.select(F.col("__group").alias(group)).distinct()
    return groups.join(F.broadcast(found), F.col(group).eqNullSafe(F.col("__group")), "left").select(group, *fractions)


def lower_index(rows: DataFrame, group: str, column: str, fractions: dict[str, float]) -> DataFrame:
    """For each group and fraction the sorted values' element at the whole part of fraction * (count - 1).

    Values are counted before they are put in order, so a group is as many rows as it has distinct values and never an array."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(group, column).agg(F.count("*").alias("n"))
    w = W.partitionBy(group).orderBy(column)
    upto = counts.withColumn("upto", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(W.partitionBy(group)))
    at = {name: F.floor((F.col("total") - 1) * f) for name, f in fractions.items()}
    return upto.groupBy(group).agg(*[F.min(F.when(F.col("upto") > place, F.col(column))).alias(name) for name, place in at.items()])


def problems(cues: DataFrame, duration_ms: Column) -> DataFrame:
    """cues with a column for each rule of export that a cue may break."""
    w = W.partitionBy("stream_id").orderBy("start_ms", "turn")
    start, end = F.col("start_ms"), F.col("end_ms")
    tens = lambda c: F.floor(c / 10.0 + 0.5)
    return cues.select(
        "stream_id", "turn", (F.length(F.trim("text")) == 0).alias("empty"), (~((start >= 0) & (start < end) & (end <= duration_ms + 1))).alias("outside"),
        F.coalesce(start * 10 < F.lag("end_ms").over(w) * 10 - 1, F.lit(False)).alias("overlapping"), ((tens(end) <= tens(start)) | (end <= start)).alias("vanishes"),
    )


def srt_block(number: Column, start_s: Column, end_s: Column, text: Column) -> Column:
    return F.concat(number.cast("string"), F.lit("\n"), T.stamp(start_s), F.lit(" --> "), T.stamp(end_s), F.lit("\n"), text)


def srt_body(cues: DataFrame) -> DataFrame:
    """stream_id, body: the SRT file of each stream, its cues in order of start and turn."""
    w = W.partitionBy("stream_id").orderBy("start_ms", "turn")
    block = srt_block(F.row_number().over(w), F.col("start_ms") / 1000, F.col("end_ms") / 1000, T.normalize(F.col("text")))
    blocks = cues.select("stream_id", F.struct("start_ms", "turn", block.alias("block")).alias("b"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]), "\n\n")
    return blocks.groupBy("stream_id").agg(F.concat(joined, F.lit("\n")).alias("body"))


def ass_lines(cues: DataFrame, placement: Column | None = None) -> DataFrame:
    """stream_id, turn, line: the dialogue lines of an ASS file."""
    text = T.ass_text(T.normalize(F.col("text")))
    line = F.concat(
        F.lit("Dialogue: 0,"), T.stamp(F.col("start_ms") / 1000, True), F.lit(","), T.stamp(F.col("end_ms") / 1000, True), F.lit(",Default,,0,0,0,,"), placement if placement is not None else F.lit(""), text
    )
    return cues.select("stream_id", "turn", line.alias("line"))


def ass_header(width: int, height: int, font_height: float | None = None) -> str:
    """The head of an ASS file; the style's values are fixed."""
    font, margin = max(18, round(height * (font_height or 0.034))), round(height * 0.06)
    names = "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
    style = f"Default,Arial,{font},&H00FFFFFF,&H000000FF,&H00000000,&H80000000,0,0,0,0,100,100,0,0,1,2,0,2,20,20,{margin},1"
    info = {"Title": "Extracted subtitles", "ScriptType": "v4.00+", "PlayResX": width, "PlayResY": height, "WrapStyle": 2, "ScaledBorderAndShadow": "yes"}
    events = "Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"
    return "\n".join(["[Script Info]", *(f"{k}: {v}" for k, v in info.items()), "", "[V4+ Styles]", f"Format: {names}", f"Style: {style}", "", "[Events]", f"Format: {events}", ""])


def placement(layout: Column, roi: Column, width: Column, height: Column) -> Column:
    """The ASS override that puts a cue where it was seen; empty if layout or region is not usable."""
    left, top, right, bottom = (roi[k] for k in range(4))
    x, y, glyph = layout["center_x"], layout["bottom_y"], layout["glyph_height"]
    within = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    px = F.bround(within(left + x * (right - left)) * width).cast("long")
    py = F.bround(within(top + y * (bottom - top)) * height).cast("long")
    font = F.greatest(F.lit(1), F.least(height, F.bround(glyph * (bottom - top) * height).cast("long")))
    usable = (F.size(roi) == 4) & (left >= 0) & (left < right) & (right <= 1) & (top >= 0) & (top < bottom) & (bottom <= 1) & (glyph > 0)
    for v in (x, y, glyph):
        usable = usable & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.when(usable, F.format_string("{\\an2\\pos(%d,%d)\\fs%d}", px, py, font)).otherwise("")


def adjacent_repeats(cues: DataFrame, least_ms: int = -10, most_ms: int = 120) -> DataFrame:
    """Cues that repeat the text of the one before after a small gap."""
    w = W.partitionBy("stream_id").orderBy("start_ms", "turn")
    gap = F.col("start_ms") - F.lag("end_ms").over(w)
    return cues.withColumn("gap_ms", gap).withColumn("before", F.lag("text").over(w)).where((F.col("before") == F.col("text")) & F.col("gap_ms").between(least_ms, most_ms)).select("stream_id", "turn", "gap_ms")


def overlap_fragments(reference: DataFrame, output: DataFrame, least_ms: int = 20, bucket_ms: int = 10_000) -> DataFrame:
    """For each reference cue how many output cues overlap it by more than least_ms.

    Both are dealt to the time buckets that they touch, so the join has an equality in it; a pair that meets in
    several buckets counts where the later of the two begins."""
    def dealt(df, p):
        low, high = F.floor(F.col("start_ms") / bucket_ms), F.floor((F.col("end_ms") - 1) / bucket_ms)
        return df.select(F.col("stream_id").alias(f"{p}_stream"), F.col("turn").alias(f"{p}_turn"), F.col("start_ms").alias(f"{p}_start"), F.col("end_ms").alias(f"{p}_end"), F.explode(F.sequence(low, F.greatest(low, high))).alias(f"{p}_bucket"))

    a, b = dealt(reference, "a"), dealt(output, "b")
    begin, end = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    met = (F.col("a_stream") == F.col("b_stream")) & (F.col("a_bucket") == F.col("b_bucket")) & (end - begin > least_ms) & (F.floor(begin / bucket_ms) == F.col("a_bucket"))
    counts = a.join(b, met).groupBy("a_stream", "a_turn").agg(F.count("*").alias("fragments"))
    return reference.join(counts, (F.col("stream_id") == F.col("a_stream")) & (F.col("turn") == F.col("a_turn")), "left").select("stream_id", "turn", F.coalesce("fragments", F.lit(0)).alias("fragments"))
