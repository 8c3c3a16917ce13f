"""Work that must grow no faster than its input: what is compared, sent and read."""

import random

from pyspark.sql import functions as F

from cuestream.operators import alignment


def _cues(made, n):
    """Cues of a few readings that overlap in all ways."""
    at, out = 0.0, []
    for _ in range(n):
        at += made.choice([0, 0.1, 0.25, 0.5, 1, 2])
        text = "".join(made.choice("ab") for _ in range(made.randint(0, 6)))
        out.append({"start": at, "end": at + made.choice([0.1, 0.5, 1, 1.5]), "text": text, "key": text})
    return out


def test_alignment_with_bounds_is_the_exact_one():
    made = random.Random(3)
    for k in range(300):
        a, b = _cues(made, made.randint(0, 8)), _cues(made, made.randint(0, 8))
        if k % 3 == 0:
            b = [x | {"start": x["start"] + 0.25, "end": x["end"] + 0.25} for x in a if made.random() < 0.8]
        exact = [[alignment.match_cost(x, y) for y in b] for x in a]
        assert alignment.align(a, b) == alignment._best_path(exact, len(a), len(b))


def test_equal_cues_are_aligned_without_comparing_letters(monkeypatch):
    """Cues of two exports 0.3 s apart overlap their neighbours too, whose texts need not be compared."""
    a = [{"start": 2.0 * k, "end": 2.0 * k + 1.9, "text": f"{k} " * 400, "key": f"{k} " * 400} for k in range(40)]
    b = [x | {"start": x["start"] + 0.3, "end": x["end"] + 0.3} for k, x in enumerate(a) if k % 5]
    calls, plain = [], alignment.distance
    monkeypatch.setattr(alignment, "distance", lambda x, y: calls.append(1) or plain(x, y))
    got = alignment.align(a, b)
    assert [(i, None if j is None else b[j]["key"] == a[i]["key"]) for i, j in got] == [(k, True if k % 5 else None) for k in range(40)]
    assert not calls


def test_report_reads_the_alignment_once(spark):
    """Counts and errors come from one pass; a group without an exact pair has no errors."""
    rows = [(1, 0, 0, 0, 5, True, 0.1, -0.3), (1, 1, None, 4, 4, False, None, None), (1, None, 1, 3, 0, False, None, None), (2, 0, 0, 1, 6, False, 0.2, 0.2)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    pairs = spark.createDataFrame(rows, alignment.PAIR).mapInPandas(counted, alignment.PAIR)
    got = sorted(tuple(r) for r in alignment.report(pairs, "stream_id").collect())
    assert got == [(1, 2, 2, 1, 1, 1, 1, round(7 / 9, 6), 0.1, 0.3, 0.3), (2, 1, 1, 0, 0, 0, 1, round(1 / 6, 6), None, None, None)]
    assert seen.value == len(rows)
    assert alignment.report(pairs).select(F.col("reference_cues")).first()[0] == 3


def test_groups_are_worked_through_in_order_and_whole(spark):
    """Groups larger than an Arrow batch stay whole; null values stay null and numbers whole."""
    from cuestream.operators.streams import in_groups

    rows = [(s, p, f, None if f % 3 else f) for s in range(5) for p in range(3) for f in range(700 if s == 1 else 4)] + [(None, 0, f, f) for f in range(3)]
    made = spark.createDataFrame(rows, "stream_id long, part int, frame long, x long").orderBy(F.rand(5)).repartition(3, "stream_id")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        told = lambda group: [(group[0]["stream_id"], len(group), [r["frame"] for r in group] == list(range(len(group))), group[0]["x"], group[-1]["x"])]
        got = sorted((tuple(r) for r in in_groups(made, ("stream_id", "part"), ("frame",), lambda g: told(list(g)), "s long, n long, ordered boolean, a long, z long").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = [(s, n, True, 0, n - 1 if (n - 1) % 3 == 0 else None) for s, n in ((0, 4), (1, 700), (2, 4), (3, 4), (4, 4)) for _ in range(3)] + [(None, 3, True, 0, 2)]
    assert got == sorted(want, key=str)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scan_groups_of_many_blanks_are_one_pass(spark):
    """Blank frames and short groups, against a plain loop; no group has a call of its own."""
    import numpy as np

    from cuestream.operators import evidence as E
    from cuestream.operators import masks as M
    from cuestream.operators import scans

    made, shown = np.random.default_rng(5), {}
    pictures = [made.random((12, 20)) < 0.5 for _ in range(2)]
    for stream in range(3):
        for frame in range(120):
            kind = made.integers(0, 5)
            mask = np.zeros((12, 20), bool) if kind < 2 else pictures[kind % 2].copy()
            mask[0, 0] ^= bool(kind == 4) and bool(mask.any())
            shown[stream, frame] = mask
    shown[0, 50] = shown[0, 50][:, :10]  # another size
    want = []
    for stream in range(3):
        leader, held = None, 0
        for frame in range(120):
            mask = shown[stream, frame]
            if leader is None or (frame - leader) * 0.25 >= 1.5 or held + mask.size > 1000 or not M.compatible(shown[stream, leader], mask):
                leader, held = frame, 0
            held += mask.size
            want.append((stream, frame, leader))
    rows = spark.createDataFrame([(s, f, f * 0.25) for s, f in shown], "stream_id long, frame long, start double")
    masks = spark.createDataFrame([(s, f, *E.packed(m).values()) for (s, f), m in shown.items()], E.MASK)
    got = scans.scan_groups(rows, masks, most_bytes=1000)
    assert sorted(map(tuple, got.collect())) == want
    assert "FlatMapGroupsInPandas" not in _plan(got)


def _track_rows(made, n):
    at, out = 0.0, []
    for i in range(n):
        boxes = [{"x": 0.2 + made.choice([0, 0, 0, 0.02]), "y": y + made.choice([0] * 9 + [0.06]), "w": 0.6, "h": made.choice([0.2] * 9 + [0.3])} for y in (0.2, 0.6)[: made.randint(1, 2)]]
        lines = [{"box": b, "candidates": [{"text": made.choice(["ab"] * 9 + ["c d"]), "confidence": made.choice([0.9, 0.35])}]} for b in boxes]
        out.append({"stream_id": 1, "frame": i, "start": at, "end": at + 0.04, "text": made.choice(["", "ab"]), "lines": lines})
        at += 0.04
    return out


def test_tracks_of_a_stream_are_one_pass(spark):
    """Tracks are those of each part by itself, in the form that the schema asks for; lines without any reading give none."""
    from cuestream.operators import tracks as K
    from cuestream.sources.subtitles import LINE

    made = random.Random(8)
    rows = [r | {"stream_id": s} for s in range(4) for r in _track_rows(made, 200)]
    df = spark.createDataFrame([(r["stream_id"], r["frame"], r["start"], r["end"], r["text"], r["lines"]) for r in rows], f"stream_id long, frame long, start double, end double, text string, lines array<{LINE}>")
    want = sorted((s, i, t["text"], t["first"]["frame"], t["last"]["frame"], t["items"], t["confident"]) for s in range(4) for i, t in enumerate(K.tracks([r for r in rows if r["stream_id"] == s])))
    got = K.line_tracks(df)
    assert want and sorted(map(tuple, got.collect())) == want
    items = K.track_items(df)
    assert items.count() == sum(t[5] for t in want)
    assert "FlatMapGroupsInPandas" not in _plan(got) + _plan(items)
    unread = {"box": {"x": 0.1, "y": 0.1, "w": 0.1, "h": 0.1}, "candidates": []}
    assert K.tracks([{"start": i * 0.04, "end": i * 0.04 + 0.04, "text": "", "lines": [unread]} for i in range(6)]) == []


def test_masks_are_drawn_for_the_frames_that_are_asked_for(spark):
    """Pictures are joined after the frames are chosen, so what is shuffled are the frames."""
    from cuestream.operators import evidence as E
    from cuestream.plans import repair_queries as Q

    masks = Q._masks(spark, "/root/testdata/sf0.001")
    pairs = masks.where("frame % 50 = 3").select("stream_id", F.col("frame").alias("a"), (F.col("frame") + 1).alias("b"))
    seen = E.tested(pairs, masks, lambda a, b, row: a.shape == b.shape)
    plan = _plan(seen).splitlines()
    assert "MapInPandas" not in _plan(masks)
    semi = [len(line) - len(line.lstrip(" :+-")) for line in plan if "Join LeftSemi" in line]
    assert len(semi) == 2 and seen.where("alike").count() > 0


def test_negations_end_at_accented_letters(spark):
    """Word boundaries are those of the reference's pattern (Python's re): an accented letter is part of a word."""
    from cuestream.functions import readings as R
    from cuestream.functions import text as T

    pairs = [("noó es", "si es"), ("la ciónno", "la cióno"), ("le pasé", "le pose"), ("él no es", "él es"), ("ñno", "ñ no"), ("É ne", "é ne")]
    got = spark.createDataFrame(pairs, "a string, b string").select(T.protected_change(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.p for r in got] == [R.protected(a, b) for a, b in pairs] == [False, False, False, True, True, False]


def test_nearest_ranks_of_few_groups_are_spread(spark):
    """As percentile_disc has them, with ties, nulls, a null group and one without values; no task adds up a whole group."""
    from cuestream.operators import cues as C

    made = random.Random(4)
    rows = [("a", float(made.randint(0, 3000))) for _ in range(4000)] + [("b", made.random()) for _ in range(999)] + [("a", None), ("none", None), ("one", 5.0), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    fractions = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "most": 1.0}
    want = df.groupBy("g").agg(*[C.nearest_rank("v", f).alias(n) for n, f in fractions.items()])
    got = C.nearest_ranks(df, "g", "v", fractions)
    key = lambda r: str(r[0])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    spread = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line]
    assert spread and all("__of" in line for line in spread)


def test_segments_are_one_pass(spark):
    """Events of many short parts, as each part by itself gives them; no part has a call of its own."""
    from cuestream.operators import segment as S
    from cuestream.sources.subtitles import LINE

    rows = [(s, f, f * 0.04, f * 0.04 + 0.04, "" if f % 20 >= 11 else f"line {f // 20}", 0.9, []) for s in range(3) for f in range(200)]
    df = spark.createDataFrame(rows, f"stream_id long, frame long, start double, end double, text string, confidence double, lines array<{LINE}>")
    got, shadow = S.segment(df), S.shadow(df)
    assert sorted((r.stream_id, r.id, r.text, r.frames, dict(r.variants)) for r in got.collect()) == [(s, k + 1, f"line {k}", 11, {f"line {k}": 11}) for s in range(3) for k in range(10)]
    assert shadow.count() == 30
    assert "FlatMapGroupsInPandas" not in _plan(got) + _plan(shadow)


def test_frames_are_dealt_by_their_number(spark, monkeypatch):
    """Counts of streams are few bytes: the frames drawn from them still go to a task for so many."""
    from cuestream.plans import repair_queries as Q

    monkeypatch.setattr(Q, "TASK_FRAMES", 500, raising=False)
    rows = Q._rows(spark, "/root/testdata/sf0.01")
    tasks = [r[1] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == spark.read.parquet("/root/testdata/sf0.01/events.parquet").count() == 10_000
    assert len(tasks) > 10 and max(tasks) < 2500


def test_parts_whose_rows_show_their_lines_are_not_sent(spark):
    """Only parts that may have a track are worked through, whatever else readings hold; no track is lost."""
    from cuestream.operators import tracks as K
    from cuestream.sources.subtitles import LINE

    made, at = random.Random(11), 0.0
    said = ["ab", " ab", "a  b", "你 好", "你\u2028好", "e\u0301", "\u0301e", "\u2018a\u2019", "a\tb", "b\x85c", "a\nb", "", "-"]
    rows = []
    for part in range(120):
        held = made.sample(said, 2)
        dips = part % 3 == 0
        for k in range(made.choice([4, 6, 8])):
            box = lambda y: {"x": 0.2, "y": y, "w": 0.6, "h": 0.2}
            lines = [{"box": box(y), "candidates": [{"text": t, "confidence": 0.9 if k % 2 else 0.6}, {"text": "other", "confidence": 0.5}]} for t, y in zip(held, (0.2, 0.6), strict=True)]
            rows.append((1, len(rows), at, at + 0.04, held[0] if dips and k == 2 else "\n".join(held), lines))
            at += 0.04
        rows.append((1, len(rows), at, at + 0.04, "", []))
        at += 0.04
    df = spark.createDataFrame(rows, f"stream_id long, frame long, start double, end double, text string, lines array<{LINE}>")
    names = ("stream_id", "frame", "start", "end", "text", "lines")
    want = sorted((t["text"], t["first"]["frame"], t["items"], t["confident"]) for t in K.tracks([dict(zip(names, r, strict=True)) for r in rows]))
    assert want and sorted(tuple(r)[2:4] + tuple(r)[5:] for r in K.line_tracks(df).collect()) == want
    assert K.track_items(df).count() == sum(t[2] for t in want)
    parts = K._parts(df).groupBy("part").agg(F.count("*").alias("n")).collect()
    assert len(want) <= 2 * len(parts) and all(r.n >= K.LEAST_ITEMS for r in parts)
    assert len(parts) < 60  # 40 dip, and a reading that breaks lines itself is left to the track


def _plain_references(rows):
    """Of the rows (frame, start, end, text, confidence) of a stream: {frame: (expected, near)} by plain loops, and the candidates."""
    from itertools import groupby

    from cuestream.functions import readings as R

    runs = [(k, list(g)) for k, g in groupby(rows, key=lambda r: R.comparison_key(r[3]))]
    asked = []
    for i, (k, g) in enumerate(runs):
        beside = {d: runs[i + d][0] if 0 <= i + d < len(runs) else None for d in (-2, -1, 1, 2)}
        blank = k == "" and bool(beside[-1]) and beside[-1] == beside[1]
        if g[-1][2] - g[0][1] <= 0.6 and (blank or (k and any(R.related(k, x) for x in beside.values() if x is not None))):
            asked += [r[0] for r in g]
    found = {}
    for at in asked:
        near, own = [r for r in rows if abs(r[0] - at) <= 20], rows[at][3]
        told = {t: (len(c := [r[4] for r in near if r[3] == t]), sum(c) / len(c), min(r[0] for r in near if r[3] == t)) for t in {r[3] for r in near}}
        fits = sorted((-n, since, t, mean) for t, (n, mean, since) in told.items() if t not in (own, "") and (own == "" or R.related(own, t)))
        if fits:
            n, _, t, mean = fits[0]
            lines = [0 if x == "" else x.count("\n") + 1 for x in (t, own)]
            if -n >= 3 and lines[0] >= lines[1] and (own == "" or -n > told[own][0] or (-n == told[own][0] and mean > told[own][1] + 0.05)):
                found[at] = (t, min((abs(r[0] - at), r[0]) for r in near if r[3] == t)[1])
    return found, asked


def _unstable_rows(made, n):
    said, out = ["a line of text", "a line of texs", "a  line of text", "한국어 자막 하나", "한국어자막 하나", "two\nlines of it", "two lines of if", ""], []
    while len(out) < n:
        text = made.choice(said)
        for _ in range(made.choice([1, 1, 2, 3, 9])):
            out.append((len(out), len(out) * 0.1, len(out) * 0.1 + 0.1, text, made.choice([0.25, 0.5, 0.75, 1.0])))
    return out


def test_unstable_references_are_those_of_plain_loops(spark):
    """Neighbourhoods that are added up, from stretches of rows, for all candidates and for some; no list of neighbours for each row."""
    from cuestream.operators import repairs as P
    from cuestream.sources.subtitles import LINE

    made = random.Random(6)
    streams = {s: _unstable_rows(made, 300) for s in range(4)}
    told = [(s, *r, []) for s, rows in streams.items() for r in rows]
    df = P.prepared(spark.createDataFrame(told, f"stream_id long, frame long, start double, end double, text string, confidence double, lines array<{LINE}>").repartition(7))
    want = {(s, f): v for s, rows in streams.items() for f, v in _plain_references(rows)[0].items()}
    assert sorted(map(tuple, P.unstable_candidates(df).collect())) == sorted((s, f) for s, rows in streams.items() for f in _plain_references(rows)[1])
    got = P.unstable_references(df)
    assert len(want) > 100 and {(r.stream_id, r.frame): (r.expected, r.near) for r in got.collect()} == want
    assert "collect_list" not in _plan(got)
    some = P.unstable_candidates(df).where("frame % 7 = 3")
    assert {(r.stream_id, r.frame): (r.expected, r.near) for r in P.unstable_references(df, some).collect()} == {k: v for k, v in want.items() if k[1] % 7 == 3}


def test_unstable_frames_are_looked_at_where_a_second_reading_is_sure(spark, monkeypatch):
    """Neighbourhoods of other candidates prove nothing; a reading that is another spelling of the expected one does."""
    from cuestream.operators import repairs as P
    from cuestream.sources.subtitles import LINE

    rows = _unstable_rows(random.Random(7), 400)
    df = spark.createDataFrame([(1, *r, []) for r in rows], f"stream_id long, frame long, start double, end double, text string, confidence double, lines array<{LINE}>")
    want, asked = _plain_references(rows)
    said = {f: (" " + want[f][0] if k % 4 else "something else", (0.75, 0.9, 0.7)[k % 3]) for k, f in enumerate(sorted(want))} | {f: ("more", 0.6) for f in range(400) if f not in want}
    second = spark.createDataFrame([(1, f, *v) for f, v in said.items()], "stream_id long, frame long, text string, confidence double")
    given, plain = [], P.unstable_references
    monkeypatch.setattr(P, "unstable_references", lambda rows, asked=None: given.append(asked) or plain(rows, asked))
    got = sorted((r.frame, r.text, r.confidence) for r in P.unstable_repairs(df, second).collect())
    assert got and got == sorted((f, *said[f]) for f in want if said[f][1] >= 0.75 and said[f][0] != "something else")
    assert sorted(r.frame for r in given[0].collect()) == sorted(f for f in set(asked) if said[f][1] >= 0.75)
