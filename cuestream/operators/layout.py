"""Where text stands in the frame: boxes, typical layouts, and what does not belong to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuestream.functions.text import fold, key, key_composed, nfc_each
from cuestream.operators.cues import lower_index

# Limits of the layout rules, as shares of the frame.
SUSTAINED_S, SUSTAINED_FRAMES, LEAST_ANCHORS = 0.35, 5, 6


def first_text(line: Column) -> Column:
    return F.coalesce(F.get(line["candidates"], F.lit(0))["text"], F.lit(""))


def first_confidence(line: Column) -> Column:
    return F.coalesce(F.get(line["candidates"], F.lit(0))["confidence"], F.lit(0.0))


def box_bounds(lines: Column) -> Column:
    """The union of the boxes of lines: struct left, top, right, bottom."""
    of = lambda f: F.transform(lines, f)
    return F.struct(
        F.array_min(of(lambda x: x["box"]["x"])).alias("left"), F.array_min(of(lambda x: x["box"]["y"])).alias("top"),
        F.array_max(of(lambda x: x["box"]["x"] + x["box"]["w"])).alias("right"), F.array_max(of(lambda x: x["box"]["y"] + x["box"]["h"])).alias("bottom"),
    )


def median_of(values: Column) -> Column:
    """The median of an array of doubles; the mean of the middle two of an even number."""
    s, n = F.array_sort(values), F.size(values)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(s, low) + F.get(s, high)) / 2)


def line_geometry(lines: Column) -> Column:
    """struct centre, height, count of the lines with text: means; null if there are none."""
    texts = F.filter(lines, lambda x: F.length(F.trim(first_text(x))) > 0)
    n = F.size(texts)
    mean = lambda f: F.aggregate(texts, F.lit(0.0), lambda a, x: a + f(x)) / n
    return F.when(n > 0, F.struct(mean(lambda x: x["box"]["y"] + x["box"]["h"] / 2).alias("centre"), mean(lambda x: x["box"]["h"]).alias("height"), n.alias("count")))


def dominant_boxes(lines: Column, text: Column) -> Column:
    """Confident lines whose reading is part of the row's."""
    wanted, read = fold(key(text)), nfc_each(F.transform(lines, first_text))
    within = F.zip_with(read, F.array_repeat(wanted, F.size(read)), lambda t, k: F.contains(k, fold(key_composed(t))))
    told = F.zip_with(lines, within, lambda x, w: F.struct(x.alias("line"), w.alias("within")))
    own = F.filter(told, lambda x: (first_confidence(x["line"]) >= 0.5) & x["within"])
    return F.transform(own, lambda x: x["line"])


def drop_fragments(lines: Column) -> Column:
    """lines without single letters that are small, narrow and close to a full line: detector fragments."""
    largest = F.array_max(F.transform(lines, lambda x: x["box"]["h"]))
    full = F.filter(lines, lambda x: (x["box"]["h"] >= largest * 0.8) & (F.length(F.trim(first_text(x))) >= 3))

    def attached(x: Column) -> Column:
        b, value = x["box"], F.trim(first_text(x))
        small = (F.length(value) == 1) & value.rlike(r"^[\p{L}\p{N}]$") & (b["h"] < largest * 0.65) & (b["w"] < 0.08)
        cx, cy = b["x"] + b["w"] / 2, b["y"] + b["h"] / 2
        near = lambda m: (cx >= m["box"]["x"] - 0.04) & (cx <= m["box"]["x"] + m["box"]["w"] + 0.04) & (F.abs(cy - (m["box"]["y"] + m["box"]["h"] / 2)) <= F.greatest(F.lit(0.12), m["box"]["h"] * 0.75))
        return small & F.exists(full, near)

    return F.when(F.size(lines) < 2, lines).otherwise(F.filter(lines, lambda x: ~attached(x)))


def split_by_height(lines: Column, frame_height: Column, least: float, most: float = 0.0) -> tuple[Column, Column]:
    """(kept, left out) lines by the height of their boxes in pixels."""
    fits = lambda x: (x["box"]["h"] * frame_height >= least) & (F.lit(most <= 0) | (x["box"]["h"] * frame_height <= most))
    return F.filter(lines, fits), F.filter(lines, lambda x: ~fits(x))


def filter_lines(lines: Column, densities: Column, frame_height: Column, least: float, most: float = 0.0, least_density: float = 0.0) -> Column:
    """struct kept, small, faint: lines of a height in pixels within bounds and, where one is asked for, of a mask density (one
    for each line) that is enough; small ones are left out by either, faint ones by their density."""
    high = lambda x: (x["box"]["h"] * frame_height >= least) & (F.lit(most <= 0) | (x["box"]["h"] * frame_height <= most))
    judged = F.zip_with(lines, densities, lambda x, d: F.struct(x.alias("line"), high(x).alias("high"), (F.lit(least_density <= 0) | F.coalesce(d >= least_density, F.lit(False))).alias("dense")))
    of = lambda test: F.transform(F.filter(judged, test), lambda j: j["line"])
    return F.struct(of(lambda j: j["high"] & j["dense"]).alias("kept"), of(lambda j: ~(j["high"] & j["dense"])).alias("small"), of(lambda j: j["high"] & ~j["dense"]).alias("faint"))


def without_glyphs(events: DataFrame, densities: DataFrame) -> DataFrame:
    """Events (stream_id, id, first_frame, start, end, frames, text, confidence) that no pixels back: one frame of a letter or two, hardly
    read, whose mask density (stream_id, frame, density) is far below the usual one of sustained events. A stream whose first eight
    of those give no usual density, or hardly any, has none."""
    of = events.join(densities.withColumnRenamed("frame", "first_frame"), ["stream_id", "first_frame"], "left")
    held = (F.col("frames") >= 5) & (F.col("end") - F.col("start") >= 0.35) & (F.col("confidence") >= 0.8) & (F.length("text") >= 3)
    nth = F.row_number().over(W.partitionBy("stream_id").orderBy("id"))
    usual = of.where(held).withColumn("nth", nth).where("nth <= 8 and density is not null").groupBy("stream_id").agg(F.count("*").alias("n"), F.median("density").alias("usual")).where("n >= 3 and usual >= 0.03")
    letters = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    suspect = (F.col("frames") == 1) & (F.col("end") - F.col("start") < 0.10) & (letters <= 2) & (F.col("confidence") < 0.72)
    return of.where(suspect).join(usual, "stream_id").where(F.col("density") < F.least(F.lit(0.008), F.col("usual") * 0.15)).select("stream_id", "id", "text", "density")


def learn_manual(regions: DataFrame, learned: DataFrame) -> DataFrame:
    """Regions (stream_id, roi, automatic, font_calibrated, font_height, mask_density) that were drawn by hand take size and density
    from what was learned within them, once; their borders stay."""
    own = F.coalesce("automatic", F.lit(False)) | F.coalesce("font_calibrated", F.lit(False))
    new = learned.select("stream_id", F.col("font_height").alias("__h"), F.col("mask_density").alias("__d"))
    joined = regions.join(new, "stream_id", "left")
    return joined.select(
        "stream_id", "roi", "automatic", F.when(own, F.coalesce("font_calibrated", F.lit(False))).otherwise(F.lit(True)).alias("font_calibrated"),
        F.when(own, F.col("font_height")).otherwise(F.col("__h")).alias("font_height"), F.when(own, F.col("mask_density")).otherwise(F.col("__d")).alias("mask_density"),
    )


def observed_layout(rows: DataFrame, *group: str) -> DataFrame:
    """center_x, bottom_y, glyph_height of each group: medians over the rows of the bounds of their confident
    lines. rows have lines; a row with an unusable box is left out."""
    lines = F.filter("lines", lambda x: (first_confidence(x) >= 0.5) & first_text(x).rlike(r"[\p{L}\p{N}]"))
    seen = rows.select(*group, lines.alias("l")).where(F.size("l") > 0).where(F.forall("l", lambda x: (x["box"]["w"] > 0) & (x["box"]["h"] > 0)))
    b = box_bounds(F.col("l"))
    at = seen.select(*group, ((b["left"] + b["right"]) / 2).alias("x"), b["bottom"].alias("y"), median_of(F.transform("l", lambda x: x["box"]["h"])).alias("h"))
    return at.groupBy(*group).agg(F.median("x").alias("center_x"), F.median("y").alias("bottom_y"), F.median("h").alias("glyph_height"))


def typical_height(rows: DataFrame, *group: str, height: str = "h", low: float = 0.75, high: float = 1.3, share: float = 0.65) -> DataFrame:
    """The median of the heights near the median of all, where at least four and 65 % of them are near it."""
    m = rows.groupBy(*group).agg(F.median(height).alias("m"), F.count("*").alias("n")).where("n >= 4")
    near = rows.join(m, list(group)).where(F.col(height).between(F.col("m") * low, F.col("m") * high))
    out = near.groupBy(*group).agg(F.median(height).alias("typical"), F.count("*").alias("near"), F.first("n").alias("n"))
    return out.where((F.col("near") >= 4) & (F.col("near") >= F.col("n") * share)).select(*group, "typical", "near")


def learn(events: DataFrame, sustained: Column) -> DataFrame:
    """The usual layout of each stream by its sustained events, at least six: median x, the tenth and ninetieth
    percentile (lower index) of y, median h; learned from those near the median x and h if six are."""
    anchors = events.where(sustained).select("stream_id", "x", "y", "h")
    rough = anchors.groupBy("stream_id").agg(F.count("*").alias("n"), F.median("x").alias("mx"), F.median("h").alias("mh")).where(F.col("n") >= LEAST_ANCHORS)
    near = anchors.join(rough, "stream_id").withColumn("near", (F.abs(F.col("x") - F.col("mx")) <= 14) & (F.col("h") / F.col("mh")).between(0.65, 1.55))
    enough = F.count_if("near").over(W.partitionBy("stream_id")) >= LEAST_ANCHORS
    used = near.withColumn("enough", enough).where(~F.col("enough") | F.col("near"))
    band = lower_index(used, "stream_id", "y", {"low": 0.1, "high": 0.9})
    return used.groupBy("stream_id").agg(F.median("x").alias("lx"), F.median("h").alias("lh")).join(band, "stream_id").select("stream_id", "lx", "low", "high", "lh")


def outliers(events: DataFrame, learned: DataFrame, weak: Column) -> DataFrame:
    """Events with reason `scene_text_layout` where they lie off the usual layout in at least two ways; else null.
    Coordinates are in hundredths of the frame. Only the learned layout, one row a stream, is joined back."""
    e = events.join(learned, "stream_id", "left")
    off_x = F.abs(F.col("x") - F.col("lx")) > 18
    off_y = (F.col("y") < F.col("low") - 8) | (F.col("y") > F.col("high") + 8)
    odd = (F.col("h") < F.col("lh") * 0.74) | (F.col("h") > F.col("lh") * 1.7)
    several = off_x.cast("int") + off_y.cast("int") + odd.cast("int") >= 2
    found = (off_x & (off_y | odd)) | (off_y & odd) | (off_y & weak & several)
    return e.withColumn("reason", F.when(found, "scene_text_layout"))


def track_closure(events: DataFrame) -> DataFrame:
    """Kept events off the usual band, near in place and time to an excluded one, are excluded too
    (`scene_text_track`), until nothing changes. events: outliers() with start_cs and end_cs.

    Rounds join only newly excluded events, on stream and time bucket; each is checkpointed."""
    from cuestream.operators.lineage import checkpointed

    bucket = 1000
    abnormal = (F.abs(F.col("x") - F.col("lx")) > 12) | (F.col("y") < F.col("low") - 6) | (F.col("y") > F.col("high") + 6)
    state = checkpointed(events)
    new, left, found = state.where("reason is not null"), state.where(F.col("reason").isNull() & abnormal), []
    while True:
        n = new.select(
            F.col("stream_id").alias("n_stream"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("start_cs").alias("n_start"), F.col("end_cs").alias("n_end"),
            F.explode(F.sequence(F.floor((F.col("start_cs") - 35) / bucket), F.floor((F.col("end_cs") + 35) / bucket))).alias("n_bucket"),
        )
        open_ = left.select("stream_id", "event_id", "x", "y", "start_cs", "end_cs", F.explode(F.sequence(F.floor(F.col("start_cs") / bucket), F.floor(F.col("end_cs") / bucket))).alias("bucket"))
        near = (
            (F.col("stream_id") == F.col("n_stream")) & (F.col("bucket") == F.col("n_bucket")) & (F.abs(F.col("x") - F.col("nx")) <= 12) & (F.abs(F.col("y") - F.col("ny")) <= 12)
            & (F.col("start_cs") - F.col("n_end") <= 35) & (F.col("n_start") - F.col("end_cs") <= 35)
        )
        caught = checkpointed(open_.join(n, near, "left_semi").select("stream_id", "event_id").distinct())
        if not caught.take(1):
            break
        found.append(caught)
        # Semi and anti joins only: estimated sizes of other joins multiply from round to round.
        new = left.join(caught, ["stream_id", "event_id"], "left_semi")
        left = checkpointed(left.join(caught, ["stream_id", "event_id"], "left_anti"))
    if not found:
        return state
    hits = reduce(DataFrame.union, found).withColumn("__hit", F.lit(True))
    marked = state.join(hits, ["stream_id", "event_id"], "left")
    return checkpointed(marked.withColumn("reason", F.when(F.col("__hit"), "scene_text_track").otherwise(F.col("reason"))).drop("__hit"))


def renumber(events: DataFrame) -> DataFrame:
    """Kept events with ids from 1 in order of time."""
    w = W.partitionBy("stream_id").orderBy("start_cs", "event_id")
    return events.where("reason is null").withColumn("id", F.row_number().over(w).cast("long"))


def mask_ratio(a: Column, b: Column) -> Column:
    """The share of the pixels of two masks' union that only one has; null below 20 pixels' union."""
    union = F.aggregate(F.zip_with(a, b, lambda x, y: (x | y).cast("int")), F.lit(0), lambda s, x: s + x)
    only = F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(union >= 20, only / union)


def region_scores(lines: DataFrame) -> DataFrame:
    """Candidates for the region of a stream, the best first: clusters of lines with how many distinct texts,
    in how many samples, and their score. lines: stream_id, cluster, sample, text, h."""
    out = lines.groupBy("stream_id", "cluster").agg(F.count_distinct("text").alias("unique_texts"), F.count_distinct("sample").alias("coverage"), F.median("h").alias("height"))
    return out.withColumn("score", F.col("unique_texts") * F.col("coverage") * F.sqrt("height"))
