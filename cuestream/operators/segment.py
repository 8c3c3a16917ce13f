"""Segmentation of a stream of readings: runs, repaired by rules that look only at what was observed."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from functools import cached_property
from itertools import accumulate, takewhile
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuestream.functions import readings as R
from cuestream.operators.streams import in_groups

# Reaches in seconds and shares that results depend on.
EPS = 1e-9
FRAGMENT_GAP, ADJACENT_GAP = 0.12, 0.08
BRIEF, BRACKET_LEFT, BRACKET_RIGHT, BRACKET_REACH = 0.45, 0.15, 0.20, 1.50
RECURRENT = {"reach": 1.5, "canonical": 0.25, "noise": 0.45, "support": 1.5, "span": 0.4}
VOLATILE = {"span": 3.5, "sustained": 0.24, "switch": 0.18, "least_span": 0.22, "runs": 4, "switches": 3, "keys": 3, "seen": 3}
ANCHOR = {"reach": 2.5, "stable": 0.24, "seen": 2}
NEIGHBOUR_GAP, NEIGHBOUR_LIKENESS = 0.3, 0.8
#: Blank time that no rule and no flag reaches across: streams are cut there, so that none is one group.
CUT_S = 0.3

EVENT = (
    "stream_id long, part long, nth int, start double, end double, text string, confidence double, frames long, agreement double, evidence_time double, first_frame long, last_frame long, "
    "flags array<string>, variants map<string,long>"
)
EVENT_FIELDS = ("start", "end", "text", "confidence", "frames", "agreement", "evidence_time", "first_frame", "last_frame", "flags", "variants")


class Run:
    """Consecutive observations that count as one reading."""

    def __init__(self, key: str, rows: list[dict], flags: Iterable[str] = ()):
        self.key, self.rows, self.flags = key, rows, frozenset(flags)

    start = property(lambda self: self.rows[0]["start"])
    end = property(lambda self: self.rows[-1]["end"])
    duration = property(lambda self: self.end - self.start)

    @cached_property
    def text(self) -> str:
        return Counter(r["text"] for r in self.rows).most_common(1)[0][0]

    @cached_property
    def signatures(self) -> list[tuple[float, float, int]]:
        """Mean centre, mean height and count of the lines of each row that has some."""
        return [s for s in map(line_signature, self.rows) if s]

    @cached_property
    def band(self) -> list[tuple[float, float]]:
        """Centre and height of the confident boxes that belong to the reading."""
        return [b for r in self.rows for b in own_boxes(r)]


def merged(runs: list[Run], flag: str | None, key: str | None = None) -> Run:
    flags = frozenset().union(*(r.flags for r in runs)) | ({flag} if flag else set())
    return Run(runs[0].key if key is None else key, [row for r in runs for row in r.rows], flags)


def line_signature(row: dict) -> tuple[float, float, int] | None:
    boxes = [x["box"] for x in row["lines"] if x["candidates"] and R.normalize(x["candidates"][0]["text"] or "")]
    n = len(boxes)
    return (sum(b["y"] + b["h"] / 2 for b in boxes) / n, sum(b["h"] for b in boxes) / n, n) if n else None


def own_boxes(row: dict) -> list[tuple[float, float]]:
    wanted = R.key(row["text"]).casefold()
    first = [(x["box"], x["candidates"][0]) for x in row["lines"] if x["candidates"]]
    return [(b["y"] + b["h"] / 2, b["h"]) for b, c in first if (c["confidence"] or 0) >= 0.5 and R.key(c["text"] or "").casefold() in wanted]


def same_line(a: Run, b: Run) -> bool:
    """All rows of both with geometry stand at one height, in one size, with one number of lines."""
    s = a.signatures + b.signatures
    if not s:
        return False
    centre, height, count = sum(x[0] for x in s) / len(s), sum(x[1] for x in s) / len(s), max(x[2] for x in s)
    return all(abs(y - centre) <= max(0.018, height * 0.45) and abs(h - height) <= max(0.012, height * 0.45) and n == count for y, h, n in s)


def same_band(a: list[tuple], b: list[tuple]) -> bool:
    """The medians of both agree in height and size."""
    if not a or not b:
        return False
    (ay, ah), (by, bh) = ((median(x[0] for x in s), median(x[1] for x in s)) for s in (a, b))
    return abs(ay - by) <= max(0.018, min(ah, bh) * 0.35) and 0.72 <= ah / max(bh, EPS) <= 1.38


def lines_still_seen(row: dict, caption: str) -> bool:
    """Every line of a caption is still among the row's raw readings."""
    expected = [k for k in (R.key(x).casefold() for x in caption.splitlines()) if k]
    raw = [R.key(c["text"] or "").casefold() for x in row["lines"] for c in x["candidates"][:1] if (c["confidence"] or 0) >= 0.25]
    return len(raw) >= len(expected) and all(any(R.likeness(want, got) >= 0.84 for got in raw) for want in expected)


def brief_variant(anchor: Run, other: Run) -> bool:
    """other may be a short misreading of anchor: an edge letter lost, or a line whose box is still there."""
    if not other.key or R.protected(anchor.key, other.key):
        return False
    if other.key == anchor.key:
        return True
    if other.duration > BRIEF + EPS:
        return False
    ours, theirs = R.normalize(anchor.text).splitlines(), R.normalize(other.text).splitlines()
    if len(theirs) < len(ours):
        return same_band(anchor.signatures, other.signatures) and all(lines_still_seen(r, anchor.text) for r in other.rows)
    if len(theirs) > len(ours):
        return False
    for a, b in zip(map(R.bare, ours), map(R.bare, theirs), strict=True):
        short, long = sorted((a, b), key=len)
        if not short or len(long) - len(short) > 2 or not long.startswith(short):
            return False
    a, b = R.bare(anchor.text), R.bare(other.text)
    least = 0.60 if min(len(a), len(b)) <= 2 else 0.88 if R.has_cjk(anchor.text + other.text) else 0.90
    return R.likeness(a, b) >= least


def volatile_pair(a: Run, b: Run) -> bool:
    """a and b may be readings of one caption that the recogniser is not sure of."""
    if not a.key or not b.key or R.protected(a.key, b.key):
        return False
    la, lb = a.text.splitlines(), b.text.splitlines()
    if len(la) == len(lb):
        if min(len(a.key), len(b.key)) / max(len(a.key), len(b.key)) < 0.75:
            return False
        like = R.likeness(a.key, b.key)
        return like >= 0.87 and (same_band(a.signatures, b.signatures) or (like >= 0.92 and min(a.duration, b.duration) <= 0.08))
    few, many = sorted((la, lb), key=len)
    if len(many) - len(few) != 1 or not all(any(R.likeness(x, y) >= 0.92 for y in many) for x in few):
        return False
    heights = [s[1] for s in a.signatures + b.signatures]
    return len(heights) >= 2 and max(heights) / max(min(heights), EPS) < 1.6


def fold(runs: list[Run], absorb: Callable[[list[Run], Run], bool]) -> list[Run]:
    out: list[Run] = []
    for run in runs:
        if not absorb(out, run):
            out.append(run)
    return out


def _fragment(out: list[Run], run: Run) -> bool:
    """Equal readings that a detector gap parts, in one line."""
    at = next((i for i in reversed(range(len(out))) if out[i].key), None) if run.key else None
    if at is None or out[at].key != run.key or not -EPS <= run.start - out[at].end <= FRAGMENT_GAP + EPS or not same_line(out[at], run):
        return False
    out[at:] = [merged([out[at], Run(run.key, run.rows)], "fragment_compacted")]
    return True


def _spelling(out: list[Run], run: Run) -> bool:
    """Adjacent readings that differ in spaces or case only; the commonest key stays."""
    if not run.key or not out or not out[-1].key:
        return False
    last = out[-1]
    squeeze = lambda k: "".join(k.split()).casefold()
    if not -0.001 <= run.start - last.end <= ADJACENT_GAP or squeeze(last.key) != squeeze(run.key) or R.protected(last.key, run.key) or not same_band(last.signatures, run.signatures):
        return False
    both = merged([last, run], "ocr_spacing_compacted")
    out[-1] = Run(Counter(R.key(r["text"]) for r in both.rows).most_common(1)[0][0], both.rows, both.flags)
    return True


def _equal(out: list[Run], run: Run) -> bool:
    if not out or out[-1].key != run.key:
        return False
    out[-1] = merged([out[-1], run], None)
    return True


def _bracket_end(runs: list[Run], i: int) -> int | None:
    """The furthest run with the anchor's reading that brackets nothing but brief variants of it."""
    anchor, found = runs[i], None
    if not anchor.key or anchor.duration < BRACKET_LEFT:
        return None
    for j in range(i + 1, len(runs)):
        right = runs[j]
        if j > i + 1:
            if not right.key or right.start - anchor.end > BRACKET_REACH:
                break
            if right.key == anchor.key and right.duration >= BRACKET_RIGHT and same_band(anchor.signatures, right.signatures):
                found = j
        if not brief_variant(anchor, right):
            break
    return found


def _recurrent_end(runs: list[Run], i: int) -> int | None:
    """The furthest return to a reading that alternates with brief variants and far outlasts them."""
    anchor = runs[i]
    if not anchor.key:
        return None
    near = takewhile(lambda r: r.key and r.start - anchor.end <= RECURRENT["reach"] and same_band(anchor.band, r.band), runs[i + 1 :])
    held, noise, found = anchor.duration, 0.0, None
    for j, run in enumerate(near, i + 1):
        own = run.key == anchor.key
        held, noise = held + run.duration * own, noise + run.duration * (not own)
        if not own and (noise > RECURRENT["noise"] or not brief_variant(anchor, run)):
            break
        outlasts = held >= max(RECURRENT["canonical"], noise * RECURRENT["support"])
        if own and outlasts and run.end - anchor.start >= RECURRENT["span"]:
            found = j
    return found


def collapse(runs: list[Run], end_of: Callable[[list[Run], int], int | None], flag: str) -> list[Run]:
    """Join from each run up to the end that a rule finds; a joined run may reach further yet."""
    runs, i = list(runs), 0
    while i < len(runs):
        end = end_of(runs, i)
        if end is None:
            i += 1
        else:
            runs[i : end + 1] = [merged(runs[i : end + 1], flag)]
    return runs


def _follows(runs: list[Run]) -> list[bool]:
    """For each run whether it may be another reading of the caption of the run before, without a pause."""
    pairs = zip(runs, runs[1:], strict=False)
    return [False, *(bool(a.key and b.key) and b.start - a.end <= ADJACENT_GAP and volatile_pair(a, b) for a, b in pairs)]


def _line_count(run: Run) -> int:
    return len(run.rows[0]["text"].splitlines())


def _steady_change(head: Run, run: Run) -> bool:
    """Another reading of as many lines that stays is no flicker."""
    return run.key != head.key and run.duration > VOLATILE["sustained"] and _line_count(run) == _line_count(head)


def _flicker(group: list[Run]) -> bool:
    brief = [r for r in group[1:] if r.duration <= VOLATILE["switch"]]
    least = {"runs": len(group), "switches": len(brief), "keys": len({r.key for r in group}), "least_span": group[-1].end - group[0].start}
    return all(value >= VOLATILE[name] for name, value in least.items())


def _fullest(group: list[Run]) -> str | None:
    """Of the texts seen often enough the one of the most lines, then rows, then characters; of equal ones the first."""
    seen = Counter(row["text"] for r in group for row in r.rows)
    ranked = [((len(t.splitlines()), n, len(t)), -k, t) for k, (t, n) in enumerate(seen.items()) if n >= VOLATILE["seen"]]
    return max(ranked)[2] if ranked else None


def _volatile(runs: list[Run]) -> list[Run]:
    """Groups of adjacent readings that switch fast among three or more become the fullest that was often seen.

    A group goes from its head as far as each run follows the one before, within a span, and none of them is a steady change."""
    follows, out, head = _follows(runs), [], 0
    while head < len(runs):
        first = runs[head]
        stays = (follows[k] and runs[k].end - first.start <= VOLATILE["span"] and not _steady_change(first, runs[k]) for k in range(head + 1, len(runs)))
        group = runs[head : head + 1 + sum(1 for _ in takewhile(bool, stays))]
        text = _fullest(group) if _flicker(group) else None
        out += group if text is None else [merged(group, "volatile_ocr_compacted", R.key(text))]
        head += len(group)
    return out


def _anchor_reach(runs: list[Run], at: int) -> tuple[int, str] | None:
    """How many runs after a volatile one it goes on through, and the steady reading that it comes to."""
    first, following = runs[at], runs[at + 1 :]
    shown = Counter(R.key(r["text"]) for r in first.rows)
    if max((n for k, n in shown.items() if k != first.key), default=0) < ANCHOR["seen"]:
        return None
    linked = (follows and b.end - first.start <= ANCHOR["reach"] for follows, b in zip(_follows([first, *following])[1:], following, strict=True))
    near = following[: sum(1 for _ in takewhile(bool, linked))]
    totals = accumulate((Counter(R.key(r["text"]) for r in run.rows) for run in near), initial=shown)
    steady = [
        (n, run.key)
        for n, (run, total) in enumerate(zip(near, list(totals)[1:], strict=True), 1)
        if run.duration >= ANCHOR["stable"] and shown[run.key] >= ANCHOR["seen"] and total[run.key] == max(total.values())
    ]
    return steady[-1] if steady else None


def _to_anchor(runs: list[Run]) -> list[Run]:
    """A volatile run goes on to a later steady reading that it had already shown, if that is then the commonest."""
    out, at = [], 0
    while at < len(runs):
        reach = _anchor_reach(runs, at) if "volatile_ocr_compacted" in runs[at].flags else None
        n, k = reach or (0, None)
        out.append(merged(runs[at : at + n + 1], "volatile_anchor_compacted", k) if n else runs[at])
        at += n + 1
    return out


def make_runs(rows: list[dict]) -> list[Run]:
    """Runs of equal keys, repaired by the rules in their fixed order."""
    runs = fold([Run(R.key(r["text"]), [r]) for r in rows], _equal)
    for absorb in (_fragment, _spelling, _equal):
        runs = fold(runs, absorb)
    runs = collapse(runs, _bracket_end, "bracketed_ocr_flicker")
    runs = collapse(runs, _recurrent_end, "recurrent_ocr_flicker")
    return _to_anchor(_volatile(runs))


MARKERS = {"image_verified": "image_verified_repair", "fade_restored": "fading_frame_preserved", "line_recovered": "missing_line_recovered_check"}


def event_of(run: Run) -> dict:
    """The event of a run: only what was observed may be its text."""
    votes = Counter(r["text"] for r in run.rows)
    text = max((t for t in votes if R.key(t) == run.key), key=votes.__getitem__)  # of equal counts the first seen
    own = [r for r in run.rows if r["text"] == text]
    middle, confidence = (run.start + run.end) / 2, sum(r["confidence"] for r in own) / len(own)
    best = min(own, key=lambda r: (-r["confidence"], abs(middle - r["start"])))
    checks = {
        "low_confidence": confidence < 0.8, "very_short": run.duration < 0.18, "very_long": run.duration > 12, "high_reading_speed": len(R.key(text)) / max(0.001, run.duration) > 35,
        "few_frames": len(run.rows) < 3, "many_lines": len(text.splitlines()) > 3, **{flag: any(r.get(m) for r in run.rows) for m, flag in MARKERS.items()},
    }
    return {
        "start": run.start, "end": run.end, "text": text, "confidence": round(confidence, 4), "frames": len(run.rows), "agreement": round(len(own) / len(run.rows), 4), "evidence_time": best["start"],
        "first_frame": run.rows[0]["frame"], "last_frame": run.rows[-1]["frame"], "flags": sorted(run.flags | {k for k, on in checks.items() if on}), "variants": dict(votes),
    }


def make_events(rows: list[dict]) -> list[dict]:
    events = [event_of(r) for r in make_runs(rows) if r.key]
    for a, b in zip(events, events[1:], strict=False):
        if b["start"] - a["end"] < NEIGHBOUR_GAP and R.likeness(R.key(a["text"]), R.key(b["text"])) > NEIGHBOUR_LIKENESS:
            for e in (a, b):
                e["flags"] = sorted({*e["flags"], "similar_neighbor_check"})
    return events


class Cluster:
    """Readings taken for one by likeness to the commonest among them."""

    def __init__(self, row: dict):
        self.rows, self.lead, self.counts = [], R.key(row["text"]), Counter()
        self.add(row)

    def takes(self, row: dict, threshold: float, blank_gap: float) -> bool:
        k = R.key(row["text"])
        near = row["start"] - self.rows[-1]["end"] <= blank_gap + EPS
        return near and (k == self.lead or R.likeness(self.lead, k, autojunk=False) >= threshold)

    def add(self, row: dict) -> None:
        k = R.key(row["text"])
        self.rows.append(row)
        self.counts[k] += 1
        self.lead = k if self.counts[k] > self.counts[self.lead] else self.lead

    def summary(self) -> dict:
        text, n = Counter(r["text"] for r in self.rows).most_common(1)[0]
        first, last = self.rows[0], self.rows[-1]
        span = {"start": first["start"], "end": last["end"], "first_frame": first["frame"], "last_frame": last["frame"]}
        return span | {"text": text, "frames": len(self.rows), "agreement": n / len(self.rows), "merged_different_readings": len(self.counts) > 1}


def shadow_clusters(rows: list[dict], threshold: float = 0.85, blank_gap: float = 0.12) -> list[dict]:
    """What clustering by likeness alone would give: a diagnosis, never an export."""
    clusters: list[Cluster] = []
    for row in (r for r in rows if R.key(r["text"])):
        if clusters and clusters[-1].takes(row, threshold, blank_gap):
            clusters[-1].add(row)
        else:
            clusters.append(Cluster(row))
    return [c.summary() for c in clusters]


def _rows(part: Iterable[dict]) -> list[dict]:
    return [r | {"lines": r.get("lines") or []} for r in part]


def parts(rows: DataFrame, cut: float = CUT_S) -> DataFrame:
    """rows with `part`: a stream falls apart at blank time of cut seconds or more, blank rows left out there."""
    w = W.partitionBy("stream_id").orderBy("frame")
    text = F.length(F.regexp_replace("text", r"[\x00-\x20\x7f-\x9f]", "")) > 0
    before = F.last(F.when(text, F.col("end")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(F.when(text, F.col("start")), ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    marked = rows.withColumn("__far", F.coalesce(after - before >= cut, F.lit(False))).withColumn("__text", text)
    new = F.when(F.col("__text") & F.col("__far"), 1).otherwise(0)
    marked = marked.withColumn("part", F.sum(new).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long"))
    return marked.where(F.col("__text") | ~F.col("__far")).drop("__far", "__text")


def segment(rows: DataFrame) -> DataFrame:
    """Observations (stream_id, frame, start, end, text, confidence, lines and, where they are, the markers of
    repairs) to events with ids from 1 in each stream."""

    def run(part: Iterable[dict]) -> Iterable[tuple]:
        rows = _rows(part)
        for nth, e in enumerate(make_events(rows)):
            yield (rows[0]["stream_id"], rows[0]["part"], nth, *[list(e[k].items()) if k == "variants" else e[k] for k in EVENT_FIELDS])

    events = in_groups(parts(rows), ("stream_id", "part"), ("frame",), run, EVENT)
    return events.withColumn("id", F.row_number().over(W.partitionBy("stream_id").orderBy("part", "nth")).cast("long")).drop("part", "nth")


def shadow(rows: DataFrame) -> DataFrame:
    """shadow_clusters of each stream; cut where its gap ends every cluster anyway."""

    fields = ("start", "end", "first_frame", "last_frame", "text", "frames", "agreement", "merged_different_readings")

    def run(part: Iterable[dict]) -> Iterable[tuple]:
        rows = _rows(part)
        for c in shadow_clusters(rows):
            yield (rows[0]["stream_id"], *[c[k] for k in fields])

    schema = "stream_id long, start double, end double, first_frame long, last_frame long, text string, frames long, agreement double, merged_different_readings boolean"
    return in_groups(parts(rows), ("stream_id", "part"), ("frame",), run, schema)
