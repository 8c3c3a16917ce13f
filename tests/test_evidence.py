"""Evidence and repairs: masks against plain computations, readings case by case, whole passes on small scenes."""

import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuestream.functions import readings as R
from cuestream.functions import text as T
from cuestream.operators import alignment, cues, evidence, joins, masks, repairs, settings
from cuestream.operators.ranks import numbered
from cuestream.plans import repair_queries
from cuestream.sources import subtitles
from cuestream.streaming import folds

SF = "/root/testdata/sf0.001"
ROWS = f"stream_id long, frame long, start double, end double, text string, confidence double, lines array<{subtitles.LINE}>"


def flooded(gray):
    """The glyph mask by its definition: light pixels with a dark one in a square of seven, islands by flood fill."""
    h, w = gray.shape
    dark, out, seen = gray < 90, np.zeros((h, w), bool), np.zeros((h, w), bool)
    light = np.array([[gray[y, x] > 210 and dark[max(0, y - 3) : y + 4, max(0, x - 3) : x + 4].any() for x in range(w)] for y in range(h)])
    scale = max(1, w / 522)
    for y, x in zip(*np.nonzero(light), strict=True):
        if seen[y, x]:
            continue
        island, todo = [], [(y, x)]
        seen[y, x] = True
        while todo:
            a, b = todo.pop()
            island.append((a, b))
            for p in range(max(0, a - 1), min(h, a + 2)):
                for q in range(max(0, b - 1), min(w, b + 2)):
                    if light[p, q] and not seen[p, q]:
                        seen[p, q] = True
                        todo.append((p, q))
        ys, xs = zip(*island, strict=True)
        if 2 <= len(island) < 650 * scale**2 and max(ys) - min(ys) < 35 * scale - 1 and max(xs) - min(xs) < 50 * scale - 1:
            out[list(ys), list(xs)] = True
    return out


def test_glyph_mask_against_flood_fill():
    r = np.random.default_rng(0)
    for k in range(12):
        gray = r.integers(0, 256, (36, 70)) if k % 2 else np.where(r.random((50, 60)) < 0.5, r.choice([20, 150, 240], (50, 60)), 240)
        assert (masks.glyph_mask(gray) == flooded(gray)).all()
    assert not masks.glyph_mask(np.full((20, 20), 128)).any()


def test_stacks_are_tested_like_single_masks():
    r = np.random.default_rng(1)
    a = r.random((40, 48, 96)) < 0.3
    b = a ^ (r.random(a.shape) < r.choice([0, 0.002, 0.01, 0.2], (40, 1, 1)))
    for test in (masks.compatible, masks.changed, masks.similar, masks.similar_over_gap):
        assert test(a, b).tolist() == [bool(test(x, y)) for x, y in zip(a, b, strict=True)]
    assert masks.changed(a[0], a[0][:4]) and not masks.similar(a[0], a[0][:4])


def test_masks_pack_and_unpack():
    m = np.random.default_rng(2).random((7, 13)) < 0.5
    p = evidence.packed(m)
    assert (evidence.unpacked(p["height"], p["width"], p["bits"]) == m).all()


def test_a_disputed_glyph_is_looked_for_where_it_stands():
    r = np.random.default_rng(3)
    a = r.random((60, 400)) < 0.5
    box, text = (0.1, 0.3, 0.8, 0.4), "the quick brown fox jumps"
    assert masks.glyph_region_match(a, a.copy(), box, box, text, (10, 11))
    changed = a.copy()
    changed[18:42, 168:200] = r.random((24, 32)) < 0.5  # about the tenth letter
    assert not masks.glyph_region_match(a, changed, box, box, text, (10, 11))
    assert masks.glyph_region_match(a, changed, box, box, text, (22, 23))  # far from the change
    assert not masks.glyph_region_match(a, a, box, (0.3, 0.3, 0.8, 0.4), text, (10, 11))
    assert not masks.glyph_region_match(a, np.zeros_like(a), box, box, text, (10, 11))


def test_same_layout_looks_within_the_boxes():
    a = np.zeros((40, 200), bool)
    a[10:20, 50:150:2] = True
    b = a.copy()
    b[30:, :20] = True
    assert masks.same_layout(a, b, (0.2, 0.2, 0.8, 0.55)) and not masks.same_layout(a, b, (0.0, 0.0, 1.0, 1.0))
    assert not masks.same_layout(a, np.roll(a, 5, axis=0), (0.2, 0.2, 0.8, 0.55))


@pytest.mark.parametrize(
    "left,right,span",
    [
        ("a caption of words", "a captiom of words", (8, 9)), ("a caption of words", "a captiom of wordz", None), ("short one", "short one", None), ("short ona", "short one", None),
        ("no caption of words 1", "no caption of words 2", None), ("a caption of words", "a caption of word", None), ("a caption\nof words", "a captiom\nof words", None), ("นี่คือข้อความทดสอบ", "นีคือข้อความทดสอบ", (2, 3)),
        ("นีคือข้อความทดสอบ", "นี่คือข้อความทดสอบ", (2, 2)), ("a caption of words", "a caption-of words", None),
    ],
)
def test_one_slip(left, right, span):
    assert R.glyph_disagreement(left, right) == span


def test_related_readings():
    assert R.related("hello there", "hello thera") and R.related("lo the", "hello there") and not R.related("he", "hello there")
    assert not R.related("", "hello") and R.related("안녕 하세요", "안녕하세요") and not R.related("one thing", "and another")


def test_agreement_in_hangul():
    assert R.agrees_in_hangul("안녕하세요", "안녕 하세요", 0.9) and not R.agrees_in_hangul("안녕하세요", "안녕하세요", 0.8)
    assert not R.agrees_in_hangul("안녕 hello there", "안녕 hello there", 0.9) and not R.agrees_in_hangul("안녕하세요", "여러분 감사", 0.9)


def test_case_folding(spark):
    cherokee = lambda c: 0x13A0 <= ord(c) <= 0x13FF or 0xAB70 <= ord(c) <= 0xABBF
    letters = [c for c in map(chr, range(1, 0xFFFF)) if unicodedata.category(c)[0] == "L" and not cherokee(c) and c.casefold() != c or c in "ßςıſ"]
    rows = spark.createDataFrame([(c,) for c in [*letters, "Straße", "ΟΔΟΣ", "İSTANBUL"]], "c string")
    wrong = [(r.c, r.f) for r in rows.select("c", T.fold(F.col("c")).alias("f")).collect() if r.f != r.c.casefold()]
    assert not wrong, wrong[:10]


def test_composition_is_done_where_it_is_needed(spark):
    texts = ["plain", "é", "é", "각", None, ""]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.nfc(F.col("t")).alias("n"), T.nfc_each(F.array(F.col("t"), F.lit("é"))).alias("e")).collect()
    assert {r.i: r.n for r in got} == {i: t and unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}
    assert {r.i: r.e for r in got} == {i: [unicodedata.normalize("NFC", t or ""), "é"] for i, t in enumerate(texts)}


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), "id")
    got = sorted((r.nth, r.k, r.id) for r in numbered(rows, "k", "id").collect())
    assert [x[0] for x in got] == list(range(1, 1001)) and [x[1:] for x in got] == sorted(x[1:] for x in got)


def test_lower_index_counts_repeats(spark):
    r = np.random.default_rng(5)
    data = [(int(g), int(v)) for g, v in zip(r.integers(0, 5, 400), r.integers(0, 9, 400), strict=True)] + [(9, 4)]
    got = {x.g: (x.a, x.b) for x in cues.lower_index(spark.createDataFrame(data, "g long, v long"), "g", "v", {"a": 0.1, "b": 0.9}).collect()}
    of = lambda g, f: sorted(v for h, v in data if h == g)[int((sum(h == g for h, _ in data) - 1) * f)]
    assert got == {g: (of(g, 0.1), of(g, 0.9)) for g in {g for g, _ in data}}


def test_interval_semi_join_with_small_buckets(spark):
    r = np.random.default_rng(6)
    frames = [(int(s), "k", int(t)) for s, t in zip(r.integers(0, 3, 300), r.integers(0, 1000, 300), strict=True)]
    events = [(int(s), "k", int(t), int(t + d)) for s, t, d in zip(r.integers(0, 3, 30), r.integers(0, 1000, 30), r.integers(0, 60, 30), strict=True)]
    f = spark.createDataFrame(frames, "stream_id long, key string, start_us long")
    got = sorted(tuple(x) for x in joins.within_events(f, spark.createDataFrame(events, "stream_id long, key string, start_us long, end_us long"), 17).collect())
    assert got == sorted(x for x in frames if any(e[0] == x[0] and e[2] <= x[2] < e[3] for e in events))


def test_alignment_in_parts_is_the_whole_one(spark):
    r = np.random.default_rng(7)
    made = {0: [], 1: []}
    for stream in range(6):
        at = 0.0
        for k in range(25):
            at += float(r.choice([0.4, 1.1, 3.0]))
            text = f"line {k} of {'abcdefg'[k % 7] * (k % 5 + 1)}"
            if r.random() < 0.85:
                made[0].append((stream, at, at + 0.8, text))
            if r.random() < 0.85:
                made[1].append((stream, at + 0.1, at + 0.9, text if r.random() < 0.8 else text[:-1] + "z"))
    frames = {side: spark.createDataFrame(rows, "stream_id long, start double, end double, text string") for side, rows in made.items()}
    got = sorted((x.stream_id, x.reference_index, x.output_index) for x in alignment.aligned(frames[0], frames[1]).collect() if x.reference_index is not None and x.output_index is not None)
    want = []
    for stream in range(6):
        a, b = ([{"start": x[1], "end": x[2], "text": x[3], "key": alignment.text_key(x[3])} for x in sorted(made[side]) if x[0] == stream] for side in (0, 1))
        want += [(stream, i, j) for i, j in alignment.align(a, b) if i is not None and j is not None]
    assert got == sorted(want)


def line(text, confidence=0.9, y=0.25):
    return ({"x": 0.2, "y": y, "w": 0.6, "h": 0.2}, [(text, confidence)])


def test_a_drifting_line_is_held_in_parts(spark):
    """Parts begin at the row that has moved too far from the first of its part."""
    rows = [(1, i, i * 0.04, (i + 1) * 0.04, "", 0.0, [({"x": 0.2 + i * 0.01, "y": 0.25, "w": 0.3, "h": 0.2}, [("moving line", 0.9 if i % 4 == 0 else 0.4)])]) for i in range(20)]
    rows = [(*r[:4], "moving line" if r[1] % 4 == 0 else "", 0.9 if r[1] % 4 == 0 else 0.0, r[6]) for r in rows]
    found = repairs.hold_candidates(repairs.prepared(spark.createDataFrame(rows, ROWS)))
    assert sorted((r["first"], r["last"]) for r in found.collect()) == [(0, 4), (5, 9), (10, 14), (15, 19)]


def test_all_passes_in_order(spark):
    """Each scene's own repair is there after the whole chain, and rejected ones are not."""
    got = repair_queries.repair_chain(spark, SF).collect()
    texts = {r.text for r in got}
    assert {"a held line of words", "the caption stays here", "blank in the middle", "a reader knows better"} <= texts
    assert "a line held no more" not in texts and "the caption goes away" not in texts


def test_repairs_without_masks_or_readers_prove_nothing(spark):
    rows = repair_queries._rows(spark, SF)
    none = spark.createDataFrame([], evidence.MASK)
    assert repairs.hold_repairs(rows, none).count() == 0 == repairs.swap_repairs(rows, none).count()
    assert repairs.held_repairs(rows, none, None).count() == 0 == repairs.unstable_repairs(rows, None).count()
    assert repairs.missing_line_repairs(rows, None).count() == 0


def test_the_first_of_several_repairs_stands(spark):
    rows = spark.createDataFrame([(1, 0, "x", 0.4), (1, 1, "y", 0.4)], "stream_id long, frame long, text string, confidence double")
    one = rows.where("frame = 0").select("stream_id", "frame", F.lit("a").alias("text"), F.lit(0.5).alias("confidence"))
    two = rows.select("stream_id", "frame", F.lit("b").alias("text"), F.lit(0.6).alias("confidence"))
    got = sorted((r.frame, r.text, r.confidence, r.image_verified) for r in repairs.apply(rows, one, two).collect())
    assert got == [(0, "a", 0.5, True), (1, "b", 0.6, True)]


def test_files_of_a_folder(spark, tmp_path):
    import hashlib

    (tmp_path / "show" / "s1").mkdir(parents=True)
    for name, data in (("s1/e10.mkv", b"ten"), ("s1/e2.mkv", b"two"), ("note.txt", b"no"), ("film.MP4", b"film")):
        (tmp_path / "show" / name).write_bytes(data)
    found = subtitles.list_videos(spark, str(tmp_path / "show")).collect()
    assert [r.relative for r in found] == ["show/film.MP4", "show/s1/e2.mkv", "show/s1/e10.mkv"] and [r.series for r in found] == ["show", "show/s1", "show/s1"]
    known = spark.createDataFrame([(found[0].source, 61.5)], "source string, duration double")
    entries = subtitles.import_entries(spark, [str(tmp_path / "show"), str(tmp_path / "show" / "s1" / "e2.mkv")], known).collect()
    assert sorted((r.source.rsplit("/", 1)[1], r.duration) for r in entries) == [("e10.mkv", 0.0), ("e2.mkv", 0.0), ("film.MP4", 61.5)]
    prints = {r.source.rsplit("/", 1)[1]: (r.source_sha256, r.bytes) for r in subtitles.fingerprints(spark, str(tmp_path / "show")).collect()}
    assert prints["e2.mkv"] == (hashlib.sha256(b"two").hexdigest(), 3)
    (tmp_path / "words.txt").write_text("one\n\n  two  \n", encoding="utf-8")
    assert sorted(r.word for r in subtitles.word_list(spark, str(tmp_path / "words.txt")).collect()) == ["one", "two"]
    with pytest.raises(ValueError):
        subtitles.exported(known, "pdf")


def test_unknown_formats_are_refused(spark):
    with pytest.raises(Exception, match="srt, ass or both"):
        spark.range(1).select(settings.selected_formats(F.lit("pdf"))).collect()


def test_streamed_runs_give_out_late_rows_and_the_last_run(spark, tmp_path):
    rows = [(1, 0, 10, 20, "a"), (1, 1, 20, 30, "a"), (1, 2, 30, 40, "b")]
    schema = "stream_id long, frame long, start_us long, end_us long, text string"
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
    first = folds.drain(folds.encode_runs(spark.readStream.schema(schema).parquet(folder)), "append").collect()
    assert [(r.key, r.n, r.refused) for r in first] == [("a", 2, False)]
    spark.createDataFrame([*rows, (1, 9, 30, 35, "late"), (1, 3, 41, 41, None)], schema).write.mode("overwrite").parquet(folder)
    again = folds.drain(folds.encode_runs(spark.readStream.schema(schema).parquet(folder)), "append").collect()
    assert sorted((r.key, r.n, r.refused) for r in again) == [("a", 2, False), ("b", 1, False), ("late", 0, True)]


def test_flags_and_spans(spark):
    one = spark.createDataFrame([("A CAPTION OF CAPITALS", "a caption", None), ("Short", "Short", "short")], "t string, a string, r string")
    assert [r.f for r in one.select(settings.evidence_flags(F.col("t"), F.col("a"), F.col("r")).alias("f")).collect()] == [["all_caps_check", "language_check_disagreement"], ["raster_check_disagreement"]]
    spans = spark.createDataFrame([([True, True, False, None, True],), ([],), ([False],)], "v array<boolean>").select(settings.true_spans(F.col("v")).alias("s")).collect()
    assert [[tuple(x) for x in r.s] for r in spans] == [[(0, 2), (4, 5)], [], []]


def test_calibrations_match_null_for_null(spark):
    fields = ", ".join(f"{k}: double" for k in settings.CALIBRATION)
    rows = spark.createDataFrame([((1.0,) * 6, (1.0,) * 6), ((None,) * 6, (None,) * 6), ((1.0,) * 6, (1.0,) * 5 + (None,))], f"a struct<{fields}>, b struct<{fields}>")
    assert [r.m for r in rows.select(settings.matching_calibration(F.col("a"), F.col("b")).alias("m")).collect()] == [True, True, False]

