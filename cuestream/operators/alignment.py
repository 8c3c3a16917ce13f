"""Alignment of output cues with reference cues, and reports of accuracy."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuestream.operators.streams import in_groups

# Costs of the alignment, in units of a missing cue.
OVERLAP_WEIGHT, NO_MATCH, NEAR_TEXT, NEAR_START_S, LEAST_SPAN_S = 0.35, 3.0, 0.25, 0.75, 0.05

PAIR = "stream_id long, reference_index int, output_index int, edits int, reference_chars int, exact boolean, start_delta double, end_delta double"


def text_key(text: str) -> str:
    return " ".join(unicodedata.normalize("NFC", text).split())


def distance(a: str, b: str) -> int:
    """Edits by one character each. Equal ends cost nothing; between them a column of the table is two numbers, of which a bit for each
    character tells whether the cell is one more or one less than the cell above (Myers)."""
    low, most = 0, min(len(a), len(b))
    while low < most and a[low] == b[low]:
        low += 1
    high = 0
    while high < most - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = sorted((a[low : len(a) - high], b[low : len(b) - high]), key=len)
    if not a:
        return len(b)
    whole, last, places = (1 << len(a)) - 1, 1 << (len(a) - 1), {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    more, less, edits = whole, 0, len(a)
    for c in b:
        at = places.get(c, 0)
        vertical = at | less
        level = (((at & more) + more) ^ more) | at
        up, down = less | (whole & ~(level | more)), more & level
        edits += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & whole, (down << 1) & whole
        more, less = down | (whole & ~(vertical | up)), up & vertical
    return edits


def _cost(a: dict, b: dict, overlap: float, ratio: float) -> float:
    if overlap <= 0 and ratio > NEAR_TEXT:
        return NO_MATCH
    return ratio + OVERLAP_WEIGHT * (1 - max(0, overlap) / max(LEAST_SPAN_S, a["end"] - a["start"], b["end"] - b["start"]))


def _overlap(a: dict, b: dict) -> float | None:
    """Seconds that both stand; null if they are never a pair, whatever their texts."""
    overlap = min(a["end"], b["end"]) - max(a["start"], b["start"])
    return None if overlap <= 0 and abs(a["start"] - b["start"]) > NEAR_START_S else overlap


def match_cost(a: dict, b: dict) -> float:
    overlap = _overlap(a, b)
    return NO_MATCH if overlap is None else _cost(a, b, overlap, distance(a["key"], b["key"]) / max(1, len(a["key"]), len(b["key"])))


def _least_cost(a: dict, b: dict) -> tuple[float, bool]:
    """A bound of match_cost from below that needs no table, and whether it is the cost itself."""
    overlap = _overlap(a, b)
    if overlap is None:
        return NO_MATCH, True
    x, y = a["key"], b["key"]
    cost = _cost(a, b, overlap, max(x != y, abs(len(x) - len(y))) / max(1, len(x), len(y)))
    return cost, x == y or cost == NO_MATCH


#: Rounds in which costs are made exact along the best path only, before all are.
ROUNDS = 4


def align(reference: list[dict], output: list[dict]) -> list[tuple[int | None, int | None]]:
    """Pairs in order; each cue is matched once or left alone. Of equal costs a match comes first, then a lone
    reference cue.

    Costs begin as bounds from below. A best path all of whose costs are exact is the best, and the one that ties choose, as
    every other path can only become dearer; so few texts are ever compared."""
    n, m = len(reference), len(output)
    least = [[_least_cost(a, b) for b in output] for a in reference]
    costs, exact = [[c for c, _ in row] for row in least], [[e for _, e in row] for row in least]
    turn = 0
    while True:
        pairs = _best_path(costs, n, m)
        open_ = [(i, j) for i, j in pairs if i is not None and j is not None and not exact[i][j]]
        if not open_:
            return pairs
        turn += 1
        for i, j in open_ if turn < ROUNDS else [(i, j) for i in range(n) for j in range(m) if not exact[i][j]]:
            costs[i][j], exact[i][j] = match_cost(reference[i], output[j]), True


def _best_path(costs: list[list[float]], n: int, m: int) -> list[tuple[int | None, int | None]]:
    """The cheapest pairs for costs of matches, where a lone cue costs 1."""
    move = np.zeros((n + 1, m + 1), np.int8)
    move[:, 0], move[0, :] = 1, 2
    before = [float(j) for j in range(m + 1)]
    for i in range(1, n + 1):
        here = [float(i)]
        for j in range(1, m + 1):
            choices = (before[j - 1] + costs[i - 1][j - 1], before[j] + 1, here[j - 1] + 1)
            step = min(range(3), key=choices.__getitem__)
            move[i, j] = step
            here.append(choices[step])
        before = here
    pairs, i, j = [], n, m
    while i or j:
        step = int(move[i, j]) if i and j else (1 if i else 2)
        i, j = i - (step != 2), j - (step != 1)
        pairs.append((i if step != 2 else None, j if step != 1 else None))
    return pairs[::-1]


def _numbered(cues: DataFrame, side: int) -> DataFrame:
    """Cues with their place in the stream, in order of time."""
    w = W.partitionBy("stream_id").orderBy("start", "end", "text")
    return cues.select("stream_id", "start", "end", "text", (F.row_number().over(w) - 1).cast("int").alias("nth"), F.lit(side).alias("side"))


def aligned(reference: DataFrame, output: DataFrame) -> DataFrame:
    """The pairs of each stream (columns stream_id, start, end, text of both tables, seconds).

    Cues that neither overlap nor begin within NEAR_START_S of each other are never a pair, so a stream falls apart wherever all cues
    before, of both tables, are that far from all that follow; each part is aligned by itself, and a table of costs is
    as large as what stands at one time. Among alignments of equal cost the choice is made within a part."""
    both = _numbered(reference, 0).union(_numbered(output, 1))
    w = W.partitionBy("stream_id").orderBy("start", "end", "side", "nth")
    reach = F.max(F.greatest(F.col("end"), F.col("start") + NEAR_START_S)).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = both.withColumn("__new", F.when(F.col("start") <= reach, 0).otherwise(1))
    parts = marked.withColumn("part", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("__new")

    def run(part: Iterable[dict]) -> Iterable[tuple]:
        cues = list(part)
        a, b = ([r | {"key": text_key(r["text"])} for r in sorted(cues, key=lambda r: r["nth"]) if r["side"] == side] for side in (0, 1))
        for i, j in align(a, b):
            x, y = a[i] if i is not None else None, b[j] if j is not None else None
            kx, ky = x["key"] if x else "", y["key"] if y else ""
            delta = [round(y[c] - x[c], 6) for c in ("start", "end")] if x and y else [None, None]
            yield (cues[0]["stream_id"], x and x["nth"], y and y["nth"], distance(kx, ky), len(kx), bool(x and y) and kx == ky, *delta)

    return in_groups(parts, ("stream_id", "part"), ("nth", "side"), run, PAIR)


def matched_blocks(reference: DataFrame, output: DataFrame) -> DataFrame:
    """stream_id, reference_index, output_index, start_error, end_error: cues of equal texts in the longest common blocks of each stream."""
    from difflib import SequenceMatcher

    schema = "stream_id long, reference_index int, output_index int, start_error double, end_error double"
    both = _numbered(reference, 0).union(_numbered(output, 1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf["side"] == side].sort_values("nth").reset_index(drop=True) for side in (0, 1))
        texts = [[" ".join(t.split()) for t in x["text"]] for x in (a, b)]
        pairs = [(m.a + k, m.b + k) for m in SequenceMatcher(None, *texts, autojunk=False).get_matching_blocks() for k in range(m.size)]
        x, y = a.loc[[i for i, _ in pairs]].reset_index(drop=True), b.loc[[j for _, j in pairs]].reset_index(drop=True)
        out = pd.DataFrame({"reference_index": x["nth"], "output_index": y["nth"], "start_error": (x["start"] - y["start"]).abs(), "end_error": (x["end"] - y["end"]).abs()})
        out.insert(0, "stream_id", pdf["stream_id"].iloc[0])
        return out

    return both.groupBy("stream_id").applyInPandas(run, schema)


def report(pairs: DataFrame, *group: str) -> DataFrame:
    """Counts, character error rate and the boundary errors of exact pairs (nearest rank)."""
    both = F.col("reference_index").isNotNull() & F.col("output_index").isNotNull()
    # A pair goes twice, with either error, and is counted once: all comes from one pass over the alignment.
    errors = F.array(F.struct(F.lit(True).alias("once"), F.abs("start_delta").alias("error")), F.struct(F.lit(False).alias("once"), F.abs("end_delta").alias("error")))
    twice = pairs.select("*", F.explode(errors).alias("e")).withColumn("once", F.col("e.once")).withColumn("error", F.when(F.col("exact"), F.col("e.error")))
    when = lambda c: F.when(F.col("once"), c)
    number = lambda c: F.count_if(F.col("once") & c)
    return twice.groupBy(*group).agg(
        F.count(when(F.col("reference_index"))).alias("reference_cues"), F.count(when(F.col("output_index"))).alias("output_cues"), number(F.col("exact")).alias("exact_cues"),
        number(F.col("output_index").isNull()).alias("missing"), number(F.col("reference_index").isNull()).alias("extra"), number(both).alias("matched"),
        F.round(F.sum(when(F.col("edits"))) / F.greatest(F.lit(1), F.sum(when(F.col("reference_chars")))), 6).alias("character_error_rate"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY error)").alias("boundary_p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY error)").alias("boundary_p95"), F.max("error").alias("boundary_max"),
    )
