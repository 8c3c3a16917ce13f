"""Segmentation of readings: paired cases of what is one caption and what is not."""

import numpy as np
import pytest

from cuestream.operators import alignment, masks, segment, tracks

BOX = {"x": 0.1, "y": 0.25, "w": 0.8, "h": 0.5}


def row(i, text, step=1 / 30, geometry=True, confidence=0.99, start=None, end=None, box=BOX):
    lines = [{"box": box, "candidates": [{"text": text, "confidence": confidence}]}] if geometry and text else []
    return {"frame": i, "start": i * step if start is None else start, "end": (i + 1) * step if end is None else end, "text": text, "confidence": confidence if text else 0.0, "lines": lines}


def rows(texts, **kw):
    return [row(i, t, **kw) for i, t in enumerate(texts)]


def events(texts, **kw):
    return segment.make_events(rows(texts, **kw))


def test_a_blank_separates():
    found = events(["Yes", "", "Yes"], geometry=False)
    assert [(e["start"], e["end"]) for e in found] == [(0, 1 / 30), (2 / 30, 3 / 30)]


@pytest.mark.parametrize(
    "texts,n",
    [
        (["I can go"] * 10 + ["I can't go"] * 10, 2),
        (["Room 2"] * 8 + ["Room 3"] * 8 + ["Room 2"] * 8, 3),
        (["really?"] * 8 + ["really!"] * 32, 2),
        (["car"] * 15 + ["cat"] * 3 + ["car"] * 15, 3),
        (["Hello\nworld", "Hello world"], 1),
        (["one", "two", "one"], 3),
    ],
)
def test_real_changes_stay(texts, n):
    assert len(events(texts, step=0.04)) == n


def test_a_detector_gap_needs_geometry():
    assert len(events(["피", "", "피"], step=0.04, geometry=False)) == 2
    found = events(["피", "", "피"], step=0.04)
    assert len(found) == 1 and "fragment_compacted" in found[0]["flags"]
    assert [len(events(["피", *[""] * k, "피"], step=0.04)) for k in (3, 4)] == [1, 2]


def test_spacing_takes_the_majority():
    found = events(["안녕하세요"] * 8 + ["안녕 하세요"] * 32, step=0.04)
    assert [(e["text"], round(e["end"], 6)) for e in found] == [("안녕 하세요", 1.6)]


def test_bracketed_flicker_is_one():
    found = events(["hello there friend"] * 20 + ["hello there frie"] * 3 + ["hello there friend"] * 12)
    assert len(found) == 1 and found[0]["text"] == "hello there friend"
    assert len(events(["hello there friend"] * 20 + ["hello there stranger"] * 3 + ["hello there friend"] * 12)) == 3


def test_variable_rates_keep_their_times():
    found = segment.make_events([row(0, "one", start=0.07, end=0.11), row(1, "one", start=0.11, end=0.29), row(2, "two", start=0.29, end=0.9)])
    assert [(e["start"], e["end"], e["text"]) for e in found] == [(0.07, 0.29, "one"), (0.29, 0.9, "two")]


def test_exported_text_was_observed():
    texts = ["abcdefgh", "abcdefgx", "abcdefgh", "abcdefgy", "abcdefgh", "abcdefgz", "abcdefgh"] * 3
    found = events(texts, step=0.04)
    assert {e["text"] for e in found} <= set(texts)


def test_shadow_clusters():
    found = segment.shadow_clusters(rows(["take 100 now"] * 8 + ["take 900 now"] + ["take 100 now"] * 8, step=0.04))
    assert len(found) == 1 and found[0]["merged_different_readings"] and found[0]["text"] == "take 100 now"


def test_parts_change_nothing(spark):
    texts = (["hello there"] * 9 + [""] * 12 + ["hello there"] * 4 + [""] * 2 + ["hello there"] * 5 + ["bye"] * 3 + [""] * 40) * 3
    data = [{**r, "stream_id": 1} for r in rows(texts, step=0.04)]
    schema = "stream_id long, frame long, start double, end double, text string, confidence double, lines array<struct<box: struct<x: double, y: double, w: double, h: double>, candidates: array<struct<text: string, confidence: double>>>>"
    got = segment.segment(spark.createDataFrame(data, schema)).orderBy("id").collect()
    want = segment.make_events(rows(texts, step=0.04))
    assert [(r.start, r.end, r.text, r.flags) for r in got] == [(e["start"], e["end"], e["text"], e["flags"]) for e in want]
    assert [r.id for r in got] == list(range(1, len(want) + 1))


def cue(start, end, text):
    return {"start": start, "end": end, "text": text, "key": alignment.text_key(text)}


def test_alignment():
    assert alignment.align([cue(0, 1, "a b"), cue(2, 3, "c")], [cue(0, 1, "a\nb"), cue(2, 3, "c")]) == [(0, 0), (1, 1)]
    assert alignment.align([cue(0, 2, "long line")], [cue(0, 1, "long"), cue(1, 2, "line")]) in ([(0, 0), (None, 1)], [(None, 0), (0, 1)])
    assert sorted(alignment.align([cue(0, 1, "yes")], [cue(60, 61, "yes")]), key=str) == [(0, None), (None, 0)]
    assert [alignment.distance(a, b) for a, b in (("kitten", "sitting"), ("", "abc"), ("你好", "你吗"), ("same", "same"))] == [3, 3, 1, 0]


def test_masks():
    a = np.zeros((32, 64), bool)
    a[8:20, 5:60:3] = True
    b = a.copy()
    b[8, 5] = False
    assert masks.compatible(a, b) and masks.similar(a, b) and masks.similar_over_gap(a, b) and not masks.changed(a, b)
    moved = np.roll(a, 1, axis=1)
    assert not masks.similar(a, moved) and not masks.compatible(a, moved) and masks.changed(a, moved)
    assert masks.density(a, (0, 0, 1, 1)) == a.mean() and masks.density(a, (0.5, 0.5, 0, 0)) == 0


def test_line_tracks():
    held = [row(i, "upper line", step=0.04, confidence=0.9 if i % 2 else 0.35) for i in range(8)]
    dipped = [r | {"text": r["text"] if r["confidence"] > 0.5 else ""} for r in held]
    found = tracks.tracks(dipped)
    assert [(t["text"], t["items"], t["confident"]) for t in found] == [("upper line", 8, 4)]
    assert tracks.tracks(held) == []  # a line that every row shows needs no track
    assert tracks.tracks(dipped[:4]) == []
    jumped = [row(i, "upper line", step=0.04, box=BOX if i < 4 else BOX | {"x": 0.3}) for i in range(8)]
    assert tracks.tracks([r | {"text": ""} for r in jumped]) == []


def test_tracks_are_one_to_one_and_end_at_their_span():
    def two(i, y):
        a, b = row(i, "same", step=0.04), row(i, "same", step=0.04, box=BOX | {"y": y})
        return a | {"text": "", "lines": [*a["lines"], *b["lines"]]}

    assert [t["items"] for t in tracks.tracks([two(i, 0.27) for i in range(6)])] == [6, 6]
    slow = [row(i, "long", step=1.0) | {"text": ""} for i in range(40)]
    assert [t["items"] for t in tracks.tracks(slow)] == [15, 15, 10]
