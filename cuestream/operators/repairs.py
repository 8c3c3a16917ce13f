"""Repairs of observations: relational rules find candidates on runs, evidence decides, and no text is made up.

Observations are stream_id, frame (without gaps), start, end (seconds), text, confidence and lines; every rule gives its
repairs as rows (stream_id, frame, text, confidence, repair), and `apply` puts them in place. Masks are a table
(stream_id, frame, height, width, bits); second readings, where a rule wants some, a table (stream_id, frame, text, confidence).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache
from itertools import takewhile
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuestream.functions import readings as R
from cuestream.functions import text as T
from cuestream.operators import evidence as E
from cuestream.operators import masks as M
from cuestream.operators.layout import box_bounds, drop_fragments, first_confidence, first_text, line_geometry
from cuestream.operators.lineage import checkpointed
from cuestream.operators.runs import with_run_id
from cuestream.operators.streams import in_groups

# Seconds, shares of the frame and counts that results depend on.
PROVISIONAL, ACCEPTED, SURE = 0.29, 0.5, 0.8
HOLD = {"gap": 0.05, "dx": 0.045, "dy": 0.065, "rows": 5, "blank": 3, "span": 0.15}
SWAP = {"span": 0.45, "gap": 0.60, "wide_gap": 0.65, "around": 0.20, "like": 0.55, "flash": 0.08, "blank": 0.60, "anchor_rows": 2}
RECUR = {"a": 0.20, "bc": 0.18, "d": 0.24, "all": 3.5, "gap": 0.08}
HELD = {"gap": 0.05, "span": 2.5, "like": 0.78, "dx": 0.075, "dy": 0.085, "heights": (0.65, 1.55), "rows": 6, "switches": 3, "least": 0.20, "weak": 2, "fair": 3, "runs": 24, "votes": 2}
OPENING = {"rows": 3, "span": (0.08, 0.30), "reach": 2.0, "gap": 0.06, "seen": 8}
MARK = {"rows": (3, 8), "span": (0.08, 0.30), "all": 3.0, "gap": 0.06}
SPARSE = {"rows": 4, "span": 0.18, "reach": 1.5, "least": 5, "pixels": 65}
MISSING = {"gap": 0.05, "span": 15.0, "rows": 4, "seen": 3, "near": 0.45}
UNSTABLE = {"span": 0.60, "reach": 20, "votes": 3, "confidence": 0.75, "lead": 0.05}

REPAIR = ("stream_id", "frame", "text", "confidence")


def prepared(rows: DataFrame) -> DataFrame:
    """rows with key, geometry (mean centre and height of the lines) and bounds of the lines that the text has."""
    own = F.filter("lines", lambda x: (first_confidence(x) >= ACCEPTED) & F.contains(F.col("text"), first_text(x)))
    g = line_geometry(F.col("lines"))
    return rows.select("stream_id", "frame", "start", "end", "text", "confidence", "lines", T.key(F.col("text")).alias("key"), g["centre"].alias("cy"), g["height"].alias("ch"), box_bounds(own).alias("bounds"))


def runs(rows: DataFrame) -> DataFrame:
    """One row for each run of equal keys of prepared rows, with what rules ask of its rows."""
    sure = (F.col("confidence") >= SURE) & F.col("bounds.left").isNotNull()
    row = F.struct("frame", "confidence", "bounds")
    return with_run_id(rows, key="key").groupBy("stream_id", "run_id").agg(
        F.min("key").alias("key"), F.count("*").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.median("cy").alias("cy"), F.median("ch").alias("ch"), F.count_if(F.col("confidence") >= SURE).alias("sure"), F.min(row).alias("head"), F.max(row).alias("tail"),
        F.min(F.when(sure, row)).alias("sure_head"), F.max(F.when(sure, row)).alias("sure_tail"),
        F.min(F.struct((-F.col("confidence")).alias("c"), F.col("frame").alias("frame"))).alias("best"),
    )


def _by_run():
    return W.partitionBy("stream_id").orderBy("run_id")


def beside(table: DataFrame, **offsets: int) -> DataFrame:
    """Runs with the runs at offsets beside them, as structs."""
    whole = F.struct(*table.columns)
    return table.select("*", *[F.lead(whole, k).over(_by_run()).alias(name) for name, k in offsets.items()])


def lasts(run: Column) -> Column:
    return run["end"] - run["start"]


def same_geometry(a: Column, b: Column) -> Column:
    """The medians of two runs' lines agree in height and size; false where one has none."""
    least, ratio = F.least(a["ch"], b["ch"]), a["ch"] / F.greatest(b["ch"], F.lit(1e-9))
    return F.coalesce((F.abs(a["cy"] - b["cy"]) <= F.greatest(F.lit(0.018), least * 0.35)) & ratio.between(0.72, 1.38), F.lit(False))


def _reading(run: Column) -> Column:
    return F.coalesce(run["key"], F.lit(""))


def apply(rows: DataFrame, *repairs: DataFrame) -> DataFrame:
    """rows with repaired texts and confidences; of several repairs of a frame the first given table's stands. `image_verified`
    marks repaired rows, and those that were before."""
    marked = rows if "image_verified" in rows.columns else rows.withColumn("image_verified", F.lit(False))
    ranked = [r.select("stream_id", "frame", F.struct(F.lit(k).alias("k"), F.col("text").alias("text"), F.col("confidence").alias("confidence")).alias("r")) for k, r in enumerate(repairs)]
    table = ranked[0]
    for more in ranked[1:]:
        table = table.union(more)
    one = table.groupBy("stream_id", "frame").agg(F.min("r").alias("__r"))
    joined = marked.join(one, ["stream_id", "frame"], "left")
    new = {"text": F.coalesce("__r.text", "text"), "confidence": F.coalesce("__r.confidence", "confidence"), "image_verified": F.col("image_verified") | F.col("__r").isNotNull()}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in marked.columns])


def _frames(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(first, last)).alias("frame")


def _all_alike(pairs: DataFrame, masks: DataFrame, test: E.Test, *key: str) -> DataFrame:
    """The keys all of whose pairs pass."""
    return E.tested(pairs, masks, test).groupBy(*key).agg(F.bool_and("alike").alias("alike")).where("alike").drop("alike")


def _consecutive(candidates: DataFrame, frames: str, *keep: str) -> DataFrame:
    """Pairs (a, b) of neighbours in an array of frames; a lone frame is its own pair."""
    pairs = F.zip_with(frames, F.slice(frames, 2, F.greatest(F.size(frames), F.lit(1))), lambda a, b: F.struct(a.alias("a"), F.coalesce(b, a).alias("b")))
    return candidates.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.a", "p.b")


# --- provisional readings and what holds through low confidence -------------------------------------------------------


def provisional(rows: DataFrame) -> DataFrame:
    """Prepared rows that have one line with a reading, confident or not: with `reading` (a key), box, centre x, y and height."""
    seen = F.filter("lines", lambda x: (first_confidence(x) >= PROVISIONAL) & first_text(x).rlike(r"[^\s\p{Cc}]"))
    one = rows.withColumn("__l", seen).where(F.size("__l") == 1).withColumn("__l", F.col("__l")[0])
    read = one.withColumn("reading", T.key(first_text(F.col("__l")))).withColumn("box", F.col("__l.box")).drop("__l")
    at = read.withColumn("x", F.col("box.x") + F.col("box.w") / 2).withColumn("y", F.col("box.y") + F.col("box.h") / 2)
    return at.where(F.col("reading").rlike(r"[\p{L}\p{N}]"))


def _islands(rows: DataFrame, gap: float, *same: str) -> DataFrame:
    """rows with `island`: they part where a frame is missing, at a pause of over gap, and where a column changes."""
    w = W.partitionBy("stream_id").orderBy("frame")
    goes_on = (F.col("frame") == F.lag("frame").over(w) + 1) & (F.col("start") - F.lag("end").over(w) <= gap)
    for c in same:
        goes_on = goes_on & (F.col(c) == F.lag(c).over(w))
    marked = rows.withColumn("__new", F.when(goes_on, 0).otherwise(1))
    return marked.withColumn("island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("__new")


def from_anchor(rows: DataFrame, breaks: Column, goes_on) -> DataFrame:
    """rows with `part` within their island: where goes_on(first, row) fails, a row begins a part and is its first.

    Islands that hold together with their first row, as nearly all do, are told by the column `breaks` and stay in the
    JVM; only the others are worked through."""
    broken = F.max(breaks).over(W.partitionBy("stream_id", "island"))
    told = rows.withColumn("__broken", F.coalesce(broken, F.lit(False)))
    whole = told.where("not __broken").drop("__broken").withColumn("part", F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame").reset_index(drop=True)
        parts, first = [], None
        for row in pdf.itertuples():
            if first is None or not goes_on(first, row):
                first = row
            parts.append(first.Index)
        return pdf.assign(part=parts)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema)
    return whole.unionByName(told.where("__broken").drop("__broken").groupBy("stream_id", "island").applyInPandas(run, schema))


def hold_candidates(rows: DataFrame) -> DataFrame:
    """Frames that show one provisional reading in one place while its confidence comes and goes: blank ones are to be filled.
    Columns stream_id, first, last, reading, frames (to be compared), bounds."""
    first = lambda c: F.first(c).over(W.partitionBy("stream_id", "island").orderBy("frame"))
    at = _islands(provisional(rows).select("stream_id", "frame", "start", "end", "text", "key", "reading", "box", "x", "y"), HOLD["gap"], "reading")
    drifts = (F.abs(F.col("x") - first("x")) > HOLD["dx"]) | (F.abs(F.col("y") - first("y")) > HOLD["dy"])
    parts = from_anchor(at.withColumn("drifts", drifts), F.col("drifts"), lambda a, r: abs(r.x - a.x) <= HOLD["dx"] and abs(r.y - a.y) <= HOLD["dy"])
    group = W.partitionBy("stream_id", "island", "part")
    own = F.col("key") == F.col("reading")
    nth = F.when(own, F.sum(own.cast("int")).over(group.orderBy("frame").rowsBetween(W.unboundedPreceding, 0)) - 1)
    ranked = parts.withColumn("nth", nth).withColumn("own", F.sum(own.cast("int")).over(group))
    bounds = E.box(F.min("box.x") - 0.008, F.min("box.y") - 0.015, F.max(F.col("box.x") + F.col("box.w")) + 0.008, F.max(F.col("box.y") + F.col("box.h")) + 0.015)
    found = ranked.groupBy("stream_id", "island", "part").agg(
        F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n"), F.min("reading").alias("reading"), F.count_if(F.col("text") == "").alias("blank"),
        F.count_if((F.col("text") != "") & ~own).alias("other"), F.max("own").alias("own"), (F.max("end") - F.min("start")).alias("span"), bounds.alias("bounds"),
        F.max(F.when(F.col("nth") == F.floor(F.col("own") / 2), F.col("frame"))).alias("shown"),
    )
    good = found.where((F.col("n") >= HOLD["rows"]) & (F.col("blank") >= HOLD["blank"]) & (F.col("span") >= HOLD["span"]) & (F.col("other") == 0) & (F.col("own") > 0))
    middle = F.col("first") + F.floor(F.col("n") / 2)
    return good.select("stream_id", "first", "last", "reading", F.array_sort(F.array_distinct(F.array("first", middle, "last", "shown"))).alias("frames"), "bounds")


def hold_repairs(rows: DataFrame, masks: DataFrame) -> DataFrame:
    rows = prepared(rows)
    found = checkpointed(hold_candidates(rows))
    held = _all_alike(_consecutive(found, "frames", "stream_id", "first", "bounds"), masks, E.within(M.similar_over_gap), "stream_id", "first")
    filled = found.join(held, ["stream_id", "first"]).select("stream_id", "reading", _frames(F.col("first"), F.col("last")))
    blank = rows.where("text = ''").select("stream_id", "frame")
    return filled.join(blank, ["stream_id", "frame"]).select("stream_id", "frame", F.col("reading").alias("text"), F.lit(ACCEPTED).alias("confidence"))


# --- short substitutions and blanks between readings of one caption ---------------------------------------------------


def _flashes(left: Column, run: Column) -> Column:
    """A run that may be a slip: by its letters, or so short that pixels alone decide."""
    return (E.likeness(T.fold(left["key"]), T.fold(run["key"])) >= SWAP["like"]) | (lasts(run) <= SWAP["flash"])


def swap_candidates(rows: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """Brief other readings between two runs of one caption, one (A-B-A) or two to three (A-B-C-A): columns stream_id, first,
    last (of the suspects), reference, a, b (the frames beside them), bounds, confidence. told: the runs, if they are there already."""
    table = beside(runs(rows) if told is None else told, l1=-1, r1=1, r2=2, r3=3, r4=4)
    me = F.struct(*[c for c in table.columns if c not in ("l1", "r1", "r2", "r3", "r4")])
    around = lambda a, b: lasts(a) + lasts(b) >= SWAP["around"]
    out = lambda left, right, first, last: [
        first.alias("first"), last.alias("last"), left["key"].alias("reference"), left["last"].alias("a"), right["first"].alias("b"),
        E.padded(E.union(left["tail"]["bounds"], right["head"]["bounds"]), 0.025, 0.04).alias("bounds"), F.least(left["tail"]["confidence"], right["head"]["confidence"]).alias("confidence"),
    ]
    left, right = F.col("l1"), F.col("r1")
    one = (F.col("key") != "") & (_reading(left) != "") & (left["key"] == right["key"]) & (F.col("key") != left["key"]) & (lasts(me) <= SWAP["span"]) & (right["start"] - left["end"] <= SWAP["gap"]) & around(left, right)
    one = one & ~T.protected_for_visual_check(F.coalesce(left["key"], F.lit("")), F.col("key"))
    aba = table.where(F.coalesce(one, F.lit(False))).where(_flashes(left, me)).select("stream_id", *out(left, right, F.col("first"), F.col("last")))

    def several(middle: list[Column], right: Column) -> DataFrame:
        found = (F.col("key") != "") & (right["key"] == F.col("key")) & (right["start"] - F.col("end") <= SWAP["wide_gap"]) & (middle[-1]["end"] - middle[0]["start"] <= SWAP["span"]) & around(me, right) & same_geometry(me, right)
        for m in middle:
            found = found & (_reading(m) != "") & ~T.protected_for_visual_check(F.col("key"), _reading(m))
        if len(middle) == 3:
            found = found & (F.col("r3.key") != F.col("key"))
        kept = table.where(F.coalesce(found, F.lit(False)))
        for m in middle:
            kept = kept.where(_flashes(me, m))
        return kept.select("stream_id", *out(me, right, middle[0]["first"], middle[-1]["last"]))

    a, b, c = (F.col(f"r{k}") for k in (1, 2, 3))
    return aba.union(several([a, b], F.col("r3"))).union(several([a, b, c], F.col("r4"))).where("bounds is not null")


def blank_candidates(rows: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """Brief blanks beside runs that were read for sure: stream_id, first, last (of the blank), a (the nearest sure frame of a
    neighbour), reference, bounds, confidence; a row for each of both neighbours that qualifies."""
    table = beside(runs(rows) if told is None else told, l1=-1, r1=1).where((F.col("key") == "") & (F.col("end") - F.col("start") <= SWAP["blank"]))
    sides = []
    for side, near in ((F.col("l1"), "sure_tail"), (F.col("r1"), "sure_head")):
        good = (_reading(side) != "") & (side["n"] >= SWAP["anchor_rows"]) & (side["sure"] >= SWAP["anchor_rows"]) & side[near].isNotNull()
        at = side[near]
        sides.append(table.where(F.coalesce(good, F.lit(False))).select("stream_id", "first", "last", at["frame"].alias("a"), side["key"].alias("reference"), E.padded(at["bounds"], 0.005, 0.01).alias("bounds"), at["confidence"].alias("confidence")))
    return sides[0].union(sides[1])


def _swapped(rows: DataFrame, masks: DataFrame, recheck: DataFrame | None) -> DataFrame:
    rows = prepared(rows)
    told = checkpointed(runs(rows))
    swaps = swap_candidates(rows, told).select("stream_id", "reference", "confidence", "bounds", _frames(F.col("first"), F.col("last")), F.explode(F.array("a", "b")).alias("a")).withColumn("b", F.col("frame"))
    seen = E.tested(swaps, masks, E.within(M.similar)).groupBy("stream_id", "frame", "reference", "confidence").agg(F.bool_or("alike").alias("alike"))
    again = E.reread(seen, recheck)
    by_reader = (T.key(F.coalesce("read", F.lit(""))) == F.col("reference")) & (F.col("read_confidence") >= SURE)
    swaps = again.where(F.col("alike") | F.coalesce(by_reader, F.lit(False))).select("stream_id", "frame", F.col("reference").alias("text"), F.when(F.col("alike"), F.col("confidence")).otherwise(F.col("read_confidence")).alias("confidence"))
    blanks = blank_candidates(rows, told).select("stream_id", "reference", "confidence", "bounds", _frames(F.col("first"), F.col("last")), "a").withColumn("b", F.col("frame"))
    filled = E.tested(blanks, masks, E.within(M.similar_over_gap)).where("alike").groupBy("stream_id", "frame").agg(F.count_distinct("reference").alias("n"), F.min("reference").alias("text"), F.min("confidence").alias("confidence"))
    return swaps.union(filled.where("n = 1").select(*REPAIR)).groupBy("stream_id", "frame").agg(F.min(F.struct("text", "confidence")).alias("r")).select("stream_id", "frame", "r.text", "r.confidence")


def swap_repairs(rows: DataFrame, masks: DataFrame, recheck: DataFrame | None = None) -> DataFrame:
    """Twice, as a repaired edge may prove what is next to it."""
    first = checkpointed(_swapped(rows, masks, recheck))
    more = _swapped(apply(rows, first).select(*rows.columns), masks, recheck)
    return first.union(more.join(first, ["stream_id", "frame"], "left_anti"))


# --- one slip of the reader -------------------------------------------------------------------------------------------


def _line_of(lines: Column) -> Column:
    """The box of the only line that has a reading; null if there are several."""
    read = F.filter(lines, lambda x: F.size(x["candidates"]) > 0)
    return F.when(F.size(read) == 1, read[0]["box"])


def _boxes(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.col("stream_id").alias("__s"), F.col("frame").alias(f"__{name}"), _line_of(F.col("lines")).alias(f"{name}_box"))


def _with_boxes(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(_boxes(rows, side), (F.col("stream_id") == F.col("__s")) & (F.col(side) == F.col(f"__{side}")), "left").drop("__s", f"__{side}")
    return pairs


def recurrent_candidates(rows: DataFrame) -> DataFrame:
    """A/B/A/B readings that differ in one glyph: stream_id, first, last, a, b (the most confident frames of the first and the
    last run), text, low, high, other (the last reading)."""
    table = beside(runs(rows), r1=1, r2=2, r3=3)
    b, c, d = (F.col(f"r{k}") for k in (1, 2, 3))
    found = (F.col("key") != "") & (_reading(b) != "") & (F.col("key") == c["key"]) & (b["key"] == d["key"]) & (F.col("key") != b["key"])
    found = found & (F.col("end") - F.col("start") >= RECUR["a"]) & (lasts(b) <= RECUR["bc"]) & (lasts(c) <= RECUR["bc"]) & (lasts(d) >= RECUR["d"]) & (d["end"] - F.col("start") <= RECUR["all"])
    found = found & (b["start"] - F.col("end") <= RECUR["gap"]) & (c["start"] - b["end"] <= RECUR["gap"]) & (d["start"] - c["end"] <= RECUR["gap"])
    me = F.struct("cy", "ch")
    kept = table.where(F.coalesce(found, F.lit(False))).where(same_geometry(me, d)).withColumn("slip", E.glyph_disagreement(F.col("key"), b["key"])).where("slip.low is not null")
    # Of overlapping ones the first stands.
    w = W.partitionBy("stream_id").orderBy("run_id")
    kept = kept.withColumn("apart", F.col("run_id") - F.lag("run_id").over(w)).where(F.coalesce(F.col("apart") >= 4, F.lit(True)))
    return kept.select("stream_id", "first", d["last"].alias("last"), F.col("best.frame").alias("a"), d["best"]["frame"].alias("b"), F.col("key").alias("text"), "slip.low", "slip.high", d["key"].alias("other"), d["cy"].alias("cy"), d["ch"].alias("ch"), "start")


def recurrent_repairs(rows: DataFrame, masks: DataFrame, recheck: DataFrame | None = None) -> DataFrame:
    """All four runs, and what follows in other spacing, take the reading that second readings prefer; else the last one."""
    rows = prepared(rows)
    found = checkpointed(recurrent_candidates(rows))
    same = E.tested(_with_boxes(found, rows), masks, E.glyphs).where("alike").drop("alike", "a_box", "b_box")
    asked = E.reread(same.select("stream_id", "first", "text", "other", F.explode(F.array("a", "b")).alias("frame")), recheck).withColumn("k", T.key(F.coalesce("read", F.lit(""))))
    score = lambda c: F.coalesce(F.max(F.when(F.col("k") == F.col(c), F.col("read_confidence"))), F.lit(0.0))
    chosen = asked.groupBy("stream_id", "first").agg(score("text").alias("one"), score("other").alias("two"))
    same = same.join(chosen, ["stream_id", "first"]).withColumn("chosen", F.when(F.col("one") > F.col("two") + 0.02, F.col("text")).otherwise(F.col("other")))
    squeezed = F.lower(F.regexp_replace("key", r"(?U)\s+", ""))
    tail = with_run_id(rows.withColumn("squeezed", squeezed), key="squeezed").select("stream_id", "frame", "run_id", "start", "end", "cy", "ch")
    w = W.partitionBy("stream_id", "run_id").orderBy("frame")
    tail = tail.withColumn("pause", F.max(F.col("start") - F.lag("end").over(w)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    ends = same.select("stream_id", "first", "last", F.col("start").alias("began"), F.struct("cy", "ch").alias("g")).join(tail.select("stream_id", F.col("frame").alias("last"), F.col("run_id").alias("of")), ["stream_id", "last"])
    after = ends.join(tail, "stream_id").where((F.col("run_id") == F.col("of")) & (F.col("frame") > F.col("last")))
    bad = (F.coalesce(F.col("pause"), F.lit(0.0)) > RECUR["gap"]) | (F.col("end") - F.col("began") > RECUR["all"]) | ~same_geometry(F.col("g"), F.struct("cy", "ch"))
    stops = after.groupBy("stream_id", "first").agg(F.coalesce(F.min(F.when(bad, F.col("frame"))) - 1, F.max("frame")).alias("stop"))
    spans = same.join(stops, ["stream_id", "first"], "left").select("stream_id", "chosen", _frames(F.col("first"), F.coalesce("stop", "last")))
    return spans.join(rows.select("stream_id", "frame", "key", "confidence"), ["stream_id", "frame"]).where("key != chosen").select("stream_id", "frame", F.col("chosen").alias("text"), "confidence")


def mark_candidates(rows: DataFrame) -> DataFrame:
    """Neighbouring runs that one combining mark parts: stream_id, first, last, text (of the first), low, high, longer, frames."""
    table = beside(runs(rows), r1=1)
    right, me = F.col("r1"), F.struct("cy", "ch")
    found = (F.col("key") != "") & (_reading(right) != "") & (F.col("n") >= MARK["rows"][0]) & (right["n"] >= MARK["rows"][1]) & (F.col("end") - F.col("start")).between(*MARK["span"]) & (right["end"] - F.col("start") <= MARK["all"])
    found = found & (right["start"] - F.col("end") <= MARK["gap"]) & same_geometry(me, right) & (F.length("key") != F.length(right["key"]))
    kept = table.where(F.coalesce(found, F.lit(False))).withColumn("slip", E.glyph_disagreement(F.col("key"), right["key"])).where("slip.low is not null")
    middle = lambda run: (run["first"] + F.floor(run["n"] / 2)).cast("long")
    whole = F.struct("first", "n")
    longer = F.when(F.length("key") > F.length(right["key"]), F.col("key")).otherwise(right["key"])
    return kept.select("stream_id", "first", right["last"].alias("last"), F.col("key").alias("text"), "slip.low", "slip.high", longer.alias("longer"), middle(whole).alias("a"), F.array(middle(right), right["last"]).alias("others"))


def mark_repairs(rows: DataFrame, masks: DataFrame) -> DataFrame:
    rows = prepared(rows)
    found = checkpointed(mark_candidates(rows))
    pairs = found.select("stream_id", "first", "text", "low", "high", "a", F.explode("others").alias("b"))
    same = found.join(_all_alike(_with_boxes(pairs, rows), masks, E.glyphs, "stream_id", "first"), ["stream_id", "first"])
    spans = same.select("stream_id", "longer", _frames(F.col("first"), F.col("last")))
    return spans.join(rows.select("stream_id", "frame", "key", "confidence"), ["stream_id", "frame"]).where("key != longer").select("stream_id", "frame", F.col("longer").alias("text"), F.greatest(F.lit(ACCEPTED), "confidence").alias("confidence"))


def two_lines(rows: DataFrame) -> DataFrame:
    """Prepared rows whose text is that of two confident lines: with up, low (the lines' texts) and their boxes."""
    fair = F.filter("lines", lambda x: first_confidence(x) >= ACCEPTED)
    placed = F.array_sort(F.transform(fair, lambda x: F.struct((x["box"]["y"] + x["box"]["h"] / 2).alias("cy"), x["box"].alias("box"), first_text(x).alias("text"))))
    two = rows.withColumn("__p", placed).where(F.size("__p") == 2)
    two = two.withColumn("up", T.normalize(F.col("__p")[0]["text"])).withColumn("low", T.normalize(F.col("__p")[1]["text"])).withColumn("boxes", F.transform("__p", lambda p: p["box"])).drop("__p")
    return two.where(T.key(F.concat("up", F.lit("\n"), "low")) == F.col("key"))


def opening_candidates(rows: DataFrame) -> DataFrame:
    """Brief openings in two lines, one of which a longer reading soon after has with one other glyph: stream_id, first, last,
    new, text (of the disputed line), low, high, a, b (frames), a_box, b_box."""
    w = W.partitionBy("stream_id").orderBy("frame")
    goes_on = (F.col("start") - F.lag("end").over(w) <= OPENING["gap"]) & (F.col("text") != "") & (F.lag("text").over(w) != "")
    chained = rows.withColumn("chain", F.sum(F.when(goes_on, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    seen = checkpointed(two_lines(chained).select("stream_id", "frame", "start", "chain", "key", "up", "low", "boxes"))
    brief = runs(rows).where((F.col("key") != "") & (F.col("n") >= OPENING["rows"]) & (F.col("end") - F.col("start")).between(*OPENING["span"])).select("stream_id", "first", "last", "n", F.col("end").alias("ended"))
    opens = brief.join(seen.select("stream_id", F.col("frame").alias("first"), F.col("chain").alias("of"), F.col("up").alias("up0"), F.col("low").alias("low0")), ["stream_id", "first"])
    # Later rows of the same chain within reach: both are dealt by time, so that a long chain is not one group.
    slot = lambda c: F.floor(c / OPENING["reach"])
    opens = opens.withColumn("slot", F.explode(F.array(slot(F.col("ended")), slot(F.col("ended")) + 1)))
    later = seen.select(F.col("stream_id").alias("s"), "frame", "start", "chain", "up", "low", slot(F.col("start")).alias("at"))
    met = opens.join(later, (F.col("stream_id") == F.col("s")) & (F.col("of") == F.col("chain")) & (F.col("slot") == F.col("at")) & (F.col("frame") > F.col("last")) & (F.col("start") <= F.col("ended") + OPENING["reach"]))
    one = met.where((F.col("up") == F.col("up0")) != (F.col("low") == F.col("low0")))
    upper = F.col("up") != F.col("up0")
    one = one.withColumn("part", F.when(upper, 0).otherwise(1)).withColumn("old", F.when(upper, F.col("up0")).otherwise(F.col("low0"))).withColumn("other", F.when(upper, F.col("up")).otherwise(F.col("low")))
    groups = one.groupBy("stream_id", "first", "last", "n", "part", "old", "other", "up", "low").agg(F.count("*").alias("seen"), F.min("frame").alias("since"), F.array_sort(F.collect_list("frame")).alias("frames"))
    # Each group is at most the frames of two seconds.
    groups = groups.withColumn("slip", E.glyph_disagreement(F.col("old"), F.col("other"))).where("slip.low is not null")
    best = F.row_number().over(W.partitionBy("stream_id", "first").orderBy(F.desc("seen"), "since"))
    best = groups.withColumn("place", best).where((F.col("place") == 1) & (F.col("seen") >= F.greatest(F.lit(OPENING["seen"]), F.col("n") * 2)))
    pairs = best.select(
        "stream_id", "first", "last", "part", F.concat("up", F.lit("\n"), "low").alias("new"), F.col("old").alias("text"), F.col("slip.low").alias("low"), F.col("slip.high").alias("high"),
        (F.col("first") + F.floor(F.col("n") / 2)).alias("a"), F.get("frames", F.floor(F.col("seen") / 2).cast("int")).alias("b"),
    )
    for side in ("a", "b"):
        own = seen.select(F.col("stream_id").alias("s"), F.col("frame").alias("f"), F.col("boxes").alias("x"))
        pairs = pairs.join(own, (F.col("stream_id") == F.col("s")) & (F.col(side) == F.col("f")), "left").withColumn(f"{side}_box", F.get("x", F.col("part"))).drop("s", "f", "x")
    return pairs.drop("part")


def opening_repairs(rows: DataFrame, masks: DataFrame) -> DataFrame:
    rows = prepared(rows)
    same = E.tested(opening_candidates(rows), masks, E.glyphs).where("alike").select("stream_id", "new", _frames(F.col("first"), F.col("last")))
    return same.join(rows.select("stream_id", "frame", "confidence"), ["stream_id", "frame"]).select("stream_id", "frame", F.col("new").alias("text"), F.greatest(F.lit(ACCEPTED), "confidence").alias("confidence"))


# --- held variants ----------------------------------------------------------------------------------------------------


def _one_line(head, before, row) -> bool:
    """row goes on with a held line: in time, place and size, and alike to its first and last reading."""
    near = abs(row.x - head.x) <= HELD["dx"] and abs(row.y - head.y) <= HELD["dy"] and HELD["heights"][0] <= row.h / max(head.h, 1e-9) <= HELD["heights"][1]
    if not near or row.end - head.start > HELD["span"]:
        return False
    return all(_one_reading(a, b) for a, b in {(head.reading, row.reading), (before.reading, row.reading)})


@lru_cache(4096)
def _one_reading(a: str, b: str) -> bool:
    """Readings repeat from frame to frame."""
    return not R.protected(a, b) and R.likeness(a.casefold(), b.casefold()) >= HELD["like"]


def held_groups(rows: list, any_confidence: bool = False) -> list[list]:
    """Groups of consecutive rows (reading, start, end, x, y, h, confidence) that flip among readings of one line."""
    groups, head = [], 0
    while head < len(rows):
        stays = takewhile(lambda k: _one_line(rows[head], rows[k - 1], rows[k]), range(head + 1, len(rows)))
        tail = head + 1 + sum(1 for _ in stays)
        group, head = rows[head:tail], tail
        switches = sum(a.reading != b.reading for a, b in zip(group, group[1:], strict=False))
        weak, fair = (sum(r.confidence < ACCEPTED for r in group), sum(r.confidence >= ACCEPTED for r in group))
        lasting = len(group) >= HELD["rows"] and group[-1].end - group[0].start >= HELD["least"]
        if lasting and HELD["switches"] <= switches < HELD["runs"] and fair >= HELD["fair"] and (any_confidence or weak >= HELD["weak"]):
            groups.append(group)
    return groups


def held_candidates(rows: DataFrame, any_confidence: bool = False) -> DataFrame:
    """stream_id, first, last, readings, frames (the middle one of each run of readings), asked (three spread frames), bounds."""
    at = _islands(provisional(rows).select("stream_id", "frame", "start", "end", "reading", "key", "box", "x", "y", F.col("box.h").alias("h"), "confidence"), HELD["gap"])
    schema = "stream_id long, first long, last long, readings array<string>, observed array<string>, frames array<long>, asked array<long>, bounds struct<left: double, top: double, right: double, bottom: double>"

    def run(island: Iterable[dict]) -> Iterable[tuple]:
        rows = [SimpleNamespace(**r) for r in island]
        for group in held_groups(rows, any_confidence) if len(rows) >= HELD["rows"] else []:
            changes = [0, *(k for k in range(1, len(group)) if group[k].reading != group[k - 1].reading), len(group)]
            middles = [group[a + (b - a) // 2].frame for a, b in zip(changes, changes[1:], strict=False)]
            fair = [r for r in group if r.confidence >= ACCEPTED]
            times = [group[0].start + share * (group[-1].end - group[0].start) for share in (0.2, 0.5, 0.8)]
            asked = list(dict.fromkeys(min(fair, key=lambda r, t=t: abs(r.start - t)).frame for t in times))
            x, y = [r.box["x"] for r in group], [r.box["y"] for r in group]
            bounds = (max(0.0, min(x) - 0.008), max(0.0, min(y) - 0.015), min(1.0, max(r.box["x"] + r.box["w"] for r in group) + 0.008), min(1.0, max(r.box["y"] + r.box["h"] for r in group) + 0.015))
            readings = sorted({r.reading for r in group})
            observed = sorted({*readings, *(r.key for r in group if r.key)})
            yield (group[0].stream_id, group[0].frame, group[-1].frame, readings, observed, middles, asked, dict(zip(("left", "top", "right", "bottom"), bounds, strict=True)))

    return in_groups(at, ("stream_id", "island"), ("frame",), run, schema)


def held_repairs(rows: DataFrame, masks: DataFrame, recheck: DataFrame | None, any_confidence: bool = False) -> DataFrame:
    """A held line takes the reading that two second readings of its own frames give, if its pixels do not change."""
    rows = prepared(rows)
    found = checkpointed(held_candidates(rows, any_confidence))
    same = found.join(_all_alike(_consecutive(found, "frames", "stream_id", "first", "bounds"), masks, E.within(M.similar_over_gap), "stream_id", "first"), ["stream_id", "first"])
    asked = E.reread(same.select("stream_id", "first", "observed", F.posexplode("asked").alias("nth", "frame")), recheck).withColumn("k", T.key(F.coalesce("read", F.lit(""))))
    votes = asked.where((F.col("read_confidence") >= SURE) & F.array_contains("observed", F.col("k"))).groupBy("stream_id", "first", "k").agg(F.count("*").alias("n"), F.min("nth").alias("nth"))
    best = votes.groupBy("stream_id", "first").agg(F.max(F.struct("n", (-F.col("nth")).alias("early"), "k")).alias("b")).where(F.col("b.n") >= HELD["votes"])
    spans = same.join(best, ["stream_id", "first"]).where(F.array_contains("readings", F.col("b.k"))).select("stream_id", F.col("b.k").alias("chosen"), _frames(F.col("first"), F.col("last")))
    return spans.join(rows.select("stream_id", "frame", "key", "confidence"), ["stream_id", "frame"]).where("key != chosen").select("stream_id", "frame", F.col("chosen").alias("text"), F.greatest(F.lit(ACCEPTED), "confidence").alias("confidence"))


# --- a caption read in a few frames only ------------------------------------------------------------------------------


def sparse_candidates(rows: DataFrame) -> DataFrame:
    """Runs of a few frames, with the frames around them that may show the same: stream_id, first, last, low, high (the
    furthest frames), a (the anchor), text, confidence, bounds. Frames with another reading end the reach."""
    texts = rows.where("key != ''").select("stream_id", "frame", "key")
    blocks = with_run_id(texts).groupBy("stream_id", "run_id").agg(F.min("key").alias("key"), F.min("frame").alias("from"), F.max("frame").alias("to"))
    blocks = blocks.select("stream_id", "from", "to", F.lag("to").over(_by_run()).alias("before"), F.lead("from").over(_by_run()).alias("after"))
    marked = with_run_id(rows, key="key")
    anchor = F.min(F.when((F.col("confidence") >= ACCEPTED) & F.col("bounds.left").isNotNull(), F.struct("frame", "text", "confidence", "bounds")))
    brief = marked.where("key != ''").groupBy("stream_id", "run_id").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("start").alias("last_start"), anchor.alias("at"))
    brief = brief.where((F.col("n") <= SPARSE["rows"]) & (F.col("end") - F.col("start") <= SPARSE["span"]) & F.col("at").isNotNull())
    placed = brief.join(blocks.withColumnRenamed("stream_id", "s"), (F.col("stream_id") == F.col("s")) & F.col("first").between(F.col("from"), F.col("to")))
    # The reach in time, by the frames' own starts: rows are met in slots of its length.
    slot = lambda c: F.floor(c / SPARSE["reach"])
    asks = placed.select("stream_id", "first", "last", "start", "end", "at", "before", "after", F.explode(F.sequence(slot(F.col("start")) - 1, slot(F.col("end")) + 1)).alias("slot"))
    times = rows.select(F.col("stream_id").alias("s"), "frame", F.col("start").alias("t"), slot(F.col("start")).alias("in_slot"))
    near = (F.col("frame") > F.coalesce("before", F.lit(-1))) & (F.col("after").isNull() | (F.col("frame") < F.col("after"))) & (F.col("start") - F.col("t") <= SPARSE["reach"]) & (F.col("t") - F.col("end") <= SPARSE["reach"])
    met = asks.join(times, (F.col("stream_id") == F.col("s")) & (F.col("slot") == F.col("in_slot")) & near)
    spans = met.groupBy("stream_id", "first", "last", "at").agg(F.min("frame").alias("low"), F.max("frame").alias("high")).where(F.col("high") - F.col("low") + 1 >= SPARSE["least"])
    return spans.select("stream_id", "first", "last", "low", "high", F.col("at.frame").alias("a"), F.col("at.text").alias("text"), F.col("at.confidence").alias("confidence"), E.padded(F.col("at.bounds"), 0.005, 0.01).alias("bounds"))


def sparse_repairs(rows: DataFrame, masks: DataFrame) -> DataFrame:
    """Blank frames take the reading as far, on either side, as the anchor's pixels are still there."""
    rows = prepared(rows)
    pairs = sparse_candidates(rows).select("*", F.explode(F.sequence("low", "high")).alias("b"))

    def shows(a, b, row) -> bool:
        one, two = (M.cut(m, [row["bounds"][k] for k in ("left", "top", "right", "bottom")]) for m in (a, b))
        return one.sum() >= SPARSE["pixels"] and bool(M.similar_over_gap(one, two))

    seen = E.tested(pairs, masks, shows)
    own = F.col("b").between(F.col("first"), F.col("last"))
    fails = ~F.col("alike") & ~own
    w = W.partitionBy("stream_id", "first")
    left = F.max(F.when(fails & (F.col("b") < F.col("first")), F.col("b"))).over(w)
    right = F.min(F.when(fails & (F.col("b") > F.col("last")), F.col("b"))).over(w)
    kept = seen.withColumn("l", F.coalesce(left + 1, "low")).withColumn("r", F.coalesce(right - 1, "high")).where((F.col("r") - F.col("l") + 1 >= SPARSE["least"]) & F.col("b").between(F.col("l"), F.col("r")))
    # The anchor has pixels enough if it passes against itself.
    sound = seen.where("a = b and alike").select("stream_id", "first")
    filled = kept.join(sound, ["stream_id", "first"], "left_semi").select("stream_id", F.col("b").alias("frame"), "first", "text", "confidence")
    blank = filled.join(rows.where("text = ''").select("stream_id", "frame"), ["stream_id", "frame"])
    best = blank.groupBy("stream_id", "frame").agg(F.min(F.struct("first", "text", "confidence")).alias("r"))
    return best.select("stream_id", "frame", "r.text", F.greatest(F.lit(ACCEPTED), "r.confidence").alias("confidence"))


# --- second readings, spaces and missing lines ------------------------------------------------------------------------


def unstable_candidates(rows: DataFrame) -> DataFrame:
    """Frames of brief runs that are blank between equal readings, or have a related reading within two runs: stream_id, frame."""
    w = W.partitionBy("stream_id").orderBy("frame")
    # Rows of one text have one key, which is worked out once; only what is asked of runs goes beside them.
    new = F.when(F.col("text").eqNullSafe(F.lag("text").over(w)), 0).otherwise(1)
    spelled = rows.withColumn("__new", new).withColumn("spelled", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy("stream_id", "spelled", "text")
    spelled = spelled.agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.min("start").alias("start"), F.max("end").alias("end"))
    keyed = with_run_id(spelled.withColumn("key", T.hangul_key(F.col("text"))), order="first").groupBy("stream_id", "run_id")
    table = keyed.agg(F.min("key").alias("key"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("start").alias("start"), F.max("end").alias("end"))
    key = F.struct("key")
    table = table.select("*", *[F.lead(key, k).over(_by_run()).alias(n) for n, k in (("l2", -2), ("l1", -1), ("r1", 1), ("r2", 2))]).where(F.col("end") - F.col("start") <= UNSTABLE["span"])
    blank = (F.col("key") == "") & (_reading(F.col("l1")) != "") & (F.col("l1.key") == F.col("r1.key"))
    near = F.lit(False)
    for side in ("l2", "l1", "r1", "r2"):
        near = near | F.coalesce(E.related(F.col("key"), F.col(f"{side}.key")), F.lit(False))
    found = F.coalesce(blank, F.lit(False)) | ((F.col("key") != "") & near)
    return table.where(found).select("stream_id", _frames(F.col("first"), F.col("last")))


def unstable_references(rows: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """For each candidate, of those asked for if some are given, the related text that its neighbourhood shows most: stream_id,
    frame, expected, near (its nearest frame)."""
    asked = unstable_candidates(rows) if asked is None else asked
    # Only neighbourhoods of asked frames are put together: they meet their rows by stretches of their length, of which they touch two at most.
    reach, frame = UNSTABLE["reach"], F.col("frame")
    stretch = lambda c: F.floor(c / (2 * reach + 1))
    at = asked.select("stream_id", frame.alias("at"), F.explode(F.array_distinct(F.array(stretch(frame - reach), stretch(frame + reach)))).alias("stretch"))
    met = rows.select("stream_id", "frame", "text", "confidence", stretch(frame).alias("stretch")).join(at, ["stream_id", "stretch"]).where(frame.between(F.col("at") - reach, F.col("at") + reach))
    # Plain numbers, which are added up without sorting: the nearest frame of a text is the least of twice its distance, plus one if it is after.
    ahead = frame - F.col("at")
    counts = met.groupBy("stream_id", "at", F.col("text").alias("other")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.min("frame").alias("since"), F.min(F.abs(ahead) * 2 + (ahead > 0).cast("long")).alias("d"), F.max(ahead == 0).alias("mine"))
    mine = lambda c, name: F.max(F.when(F.col("mine"), F.col(c))).over(W.partitionBy("stream_id", "at")).alias(name)
    others = counts.select("*", mine("other", "own"), mine("n", "own_n"), mine("mean", "own_mean")).where("other != own and other != ''")
    others = others.withColumn("fits", (F.col("own") == "") | E.related(F.col("own"), F.col("other"))).where("fits")
    place = F.row_number().over(W.partitionBy("stream_id", "at").orderBy(F.desc("n"), "since"))
    best = others.withColumn("place", place).where("place = 1")
    lines = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, "\n")))
    leads = (F.col("own") == "") | (F.col("n") > F.col("own_n")) | ((F.col("n") == F.col("own_n")) & (F.col("mean") > F.col("own_mean") + UNSTABLE["lead"]))
    good = best.where((F.col("n") >= UNSTABLE["votes"]) & (lines("other") >= lines("own")) & leads)
    near = F.col("at") + F.when(F.col("d") % 2 == 1, 1).otherwise(-1) * F.floor(F.col("d") / 2)
    return good.select("stream_id", F.col("at").alias("frame"), F.col("other").alias("expected"), near.alias("near"))


def unstable_repairs(rows: DataFrame, recheck: DataFrame | None) -> DataFrame:
    """Candidates whose second reading is the expected one, for sure enough."""
    rows = prepared(rows)
    # What no second reading is sure of is no repair, whatever is expected there.
    again = checkpointed(E.reread(unstable_candidates(rows), recheck).where(F.col("read_confidence") >= UNSTABLE["confidence"]))
    # Mostly the texts are the same as they stand; keys are no columns to join by, as a sort would work them out for each comparison.
    good = (F.col("read") == F.col("expected")) | (T.hangul_key(F.coalesce("read", F.lit(""))) == T.hangul_key(F.col("expected")))
    told = again.join(unstable_references(rows, again), ["stream_id", "frame"])
    return told.where(F.coalesce(good, F.lit(False))).select("stream_id", "frame", F.col("read").alias("text"), F.col("read_confidence").alias("confidence"))


def spacing_targets(rows: DataFrame) -> DataFrame:
    """Rows of a group of equal letters, whatever their spaces, that are not spelled like its mode: stream_id, frame, spelling,
    near (the mode's most confident row). Groups need two spellings and three rows of the mode."""
    compact = with_run_id(rows.withColumn("compact", F.regexp_replace("key", r"(?U)\s+", "")), key="compact").where("compact != ''")
    counts = compact.groupBy("stream_id", "run_id", "text").agg(F.count("*").alias("n"), F.min("frame").alias("since"), F.min(F.struct((-F.col("confidence")).alias("c"), "frame")).alias("best"))
    mode = counts.groupBy("stream_id", "run_id").agg(F.max(F.struct("n", (-F.col("since")).alias("early"), "text", "best")).alias("m"), F.count("*").alias("spellings")).where("spellings >= 2 and m.n >= 3")
    told = compact.join(mode, ["stream_id", "run_id"]).where(F.col("text") != F.col("m.text"))
    return told.select("stream_id", "frame", "text", F.col("m.text").alias("spelling"), F.col("m.best.frame").alias("near"))


def spacing_repairs(rows: DataFrame, masks: DataFrame) -> DataFrame:
    """Targets whose pixels, within the reference's boxes, are laid out as the reference's."""
    rows = prepared(rows)
    whole = rows.where(F.size("lines") > 0).select("stream_id", F.col("frame").alias("near"), box_bounds(F.col("lines")).alias("bounds"))
    pairs = spacing_targets(rows).join(whole, ["stream_id", "near"]).select("stream_id", "frame", "spelling", "bounds", F.col("near").alias("a"), F.col("frame").alias("b"))
    same = E.tested(pairs, masks, lambda a, b, row: M.same_layout(a, b, [row["bounds"][k] for k in ("left", "top", "right", "bottom")])).where("alike")
    return same.join(rows.select("stream_id", "frame", "confidence"), ["stream_id", "frame"]).select("stream_id", "frame", F.col("spelling").alias("text"), "confidence")


def line_repairs(rows: DataFrame, masks: DataFrame) -> DataFrame:
    """Lines of a track that a row's text lacks come back where the row's own pixels match one of the two nearest sure rows
    of the track, and the row's text is part of the proposal."""
    from cuestream.operators.tracks import track_items
    from cuestream.sources.subtitles import with_text

    items = checkpointed(track_items(rows))
    sure = items.where(F.col("confidence") >= ACCEPTED).select("stream_id", "part", "track", F.col("frame").alias("anchor"))
    place = F.row_number().over(W.partitionBy("stream_id", "part", "track", "frame").orderBy(F.abs(F.col("anchor") - F.col("frame")), "anchor"))
    near = items.where("missing").join(sure, ["stream_id", "part", "track"]).withColumn("place", place).where("place <= 2")
    pairs = near.select("stream_id", "frame", "nth", F.col("anchor").alias("a"), F.col("frame").alias("b"), "bounds")
    proven = E.tested(pairs, masks, E.within(M.similar_over_gap)).where("alike").groupBy("stream_id", "frame").agg(F.collect_set("nth").alias("raised"))
    raised = rows.join(proven, ["stream_id", "frame"])
    lift = lambda x: F.struct(x["box"].alias("box"), F.transform(x["candidates"], lambda c, i: F.struct(c["text"].alias("text"), F.when(i == 0, F.greatest(F.lit(ACCEPTED), c["confidence"])).otherwise(c["confidence"]).alias("confidence"))).alias("candidates"))
    lines = F.transform("lines", lambda x, i: F.when(F.array_contains("raised", i.cast("int")), lift(x)).otherwise(x))
    said = with_text(raised.select("stream_id", "frame", F.col("text").alias("was"), lines.alias("lines")))
    return said.where(F.contains(T.key(F.col("text")), T.key(F.col("was"))) & (T.key(F.col("text")) != T.key(F.col("was")))).select("stream_id", "frame", "text", "confidence")


def missing_line_candidates(rows: DataFrame) -> DataFrame:
    """Rows that lack a line which their neighbours, chained by shared lines, show three times: stream_id, frame, candidate,
    box. Confident lines at its height leave no room for it."""
    from cuestream.sources.subtitles import with_text

    shown = F.filter(F.transform(F.split(T.nfc(F.col("text")), "\n"), T.key_composed), lambda t: t != "")
    r = rows.select("stream_id", "frame", "start", "end", "key", "lines", F.array_distinct(shown).alias("shown"))
    w = W.partitionBy("stream_id").orderBy("frame")
    goes_on = F.arrays_overlap("shown", F.lag("shown").over(w)) & (F.col("start") - F.lag("end").over(w) <= MISSING["gap"])
    r = r.withColumn("island", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long"))
    long = F.col("end") - F.min("start").over(W.partitionBy("stream_id", "island")) > MISSING["span"]
    times = from_anchor(r.select("stream_id", "frame", "start", "end", "island", long.alias("long")), F.col("long"), lambda a, x: x.end - a.start <= MISSING["span"])
    r = r.join(times.select("stream_id", "frame", "part"), ["stream_id", "frame"]).where(F.size("shown") > 0)
    r = r.withColumn("n", F.count("*").over(W.partitionBy("stream_id", "island", "part"))).where(F.col("n") >= MISSING["rows"])
    letters = F.length(F.regexp_replace(first_text(F.col("x")), r"[^\p{L}]", "")) >= 2
    seen = r.select("stream_id", "island", "part", "frame", F.posexplode("lines").alias("nth", "x")).where((first_confidence(F.col("x")) >= ACCEPTED) & letters)
    seen = seen.withColumn("candidate", T.key(first_text(F.col("x"))))
    of = W.partitionBy("stream_id", "island", "part", "candidate")
    seen = seen.withColumn("m", F.count("*").over(of)).withColumn("at", F.row_number().over(of.orderBy("frame", "nth")) - 1)
    known = seen.where((F.col("m") >= MISSING["seen"]) & (F.col("at") == F.floor(F.col("m") / 2))).select("stream_id", "island", "part", "candidate", F.col("x.box").alias("box"))
    cy = lambda b: b["y"] + b["h"] / 2
    met = r.join(known, ["stream_id", "island", "part"]).where(~F.array_contains("shown", F.col("candidate")))
    taken = F.exists("lines", lambda x: (first_confidence(x) >= ACCEPTED) & (F.abs(cy(x["box"]) - cy(F.col("box"))) < F.greatest(x["box"]["h"], F.col("box.h")) * MISSING["near"]))
    # Few rows lack a line: their texts are put together apart from the joins that find them, and once.
    plain = checkpointed(with_text(checkpointed(met.where(~taken).select("stream_id", "frame", "key", "lines", "candidate", "box"))))
    return plain.where(T.key(F.col("text")) == F.col("key")).select("stream_id", "frame", "candidate", "box", "lines")


def missing_line_repairs(rows: DataFrame, recheck: DataFrame | None) -> DataFrame:
    """Missing lines that a second reading (stream_id, frame, text, confidence, of the line's place) gives for sure."""
    from cuestream.sources.subtitles import LINE, with_text

    found = missing_line_candidates(prepared(rows))
    if recheck is None:
        return rows.select(*REPAIR).limit(0)
    said = recheck.select(F.col("stream_id").alias("s"), F.col("frame").alias("f"), T.key(F.col("text")).alias("k"), F.col("text").alias("read"), F.col("confidence").alias("read_confidence"))
    good = found.join(said, (F.col("stream_id") == F.col("s")) & (F.col("frame") == F.col("f")) & (F.col("candidate") == F.col("k")) & (F.col("read_confidence") >= SURE))
    cy = lambda b: b["y"] + b["h"] / 2
    added = good.groupBy("stream_id", "frame").agg(F.first("lines").alias("lines"), F.array_sort(F.collect_set(F.struct("box", F.array(F.struct(F.col("read").alias("text"), F.col("read_confidence").alias("confidence"))).alias("candidates")))).alias("new"))
    weak = lambda x: (first_confidence(x) < ACCEPTED) & F.exists("new", lambda n: F.abs(cy(x["box"]) - cy(n["box"])) < F.greatest(x["box"]["h"], n["box"]["h"]) * MISSING["near"])
    lines = F.concat(F.filter("lines", lambda x: ~weak(x)), F.col("new").cast(f"array<{LINE}>"))
    return with_text(added.select("stream_id", "frame", lines.alias("lines"))).select(*REPAIR)


def pruned(rows: DataFrame) -> DataFrame:
    """rows without detector fragments; text and confidence of those that had some are read again from what is left."""
    from cuestream.sources.subtitles import with_text

    kept = rows.withColumn("__kept", drop_fragments(F.col("lines"))).withColumn("__fewer", F.size("__kept") < F.size("lines")).withColumn("lines", F.col("__kept"))
    again = with_text(kept.where("__fewer")).select(*rows.columns)
    return kept.where("not __fewer").select(*rows.columns).unionByName(again)


def repaired(rows: DataFrame, masks: DataFrame, recheck: DataFrame | None = None) -> DataFrame:
    """All repairs in their fixed order, each on what the one before left."""
    columns = [*rows.columns, *([] if "image_verified" in rows.columns else ["image_verified"])]
    rows = checkpointed(pruned(rows).withColumn("image_verified", F.lit(False)) if "image_verified" not in rows.columns else pruned(rows))
    passes = (
        lambda r: unstable_repairs(r, recheck), lambda r: spacing_repairs(r, masks), lambda r: hold_repairs(r, masks), lambda r: swap_repairs(r, masks, recheck), lambda r: recurrent_repairs(r, masks, recheck),
        lambda r: held_repairs(r, masks, recheck), lambda r: opening_repairs(r, masks), lambda r: mark_repairs(r, masks), lambda r: sparse_repairs(r, masks), lambda r: line_repairs(r, masks),
        lambda r: missing_line_repairs(r, recheck),
    )
    for one in passes:
        rows = checkpointed(apply(rows, one(rows)).select(*columns))
    return rows
