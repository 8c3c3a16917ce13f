"""Every registered query with an SQL twin against DuckDB, and the text functions on hard cases."""

import glob
import os
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuestream.functions import readings as R
from cuestream.functions import text as T
from cuestream.operators import jobs as Q
from cuestream.plans import registry
from cuestream.sources import subtitles

SF = "/root/testdata/sf0.001"


def flat(df):
    df = df[sorted(df.columns)]
    shown = df.map(lambda v: "∅" if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else f"{v:.6g}" if isinstance(v, float) else str(v).removesuffix(".0"))
    return sorted(map(tuple, shown.to_numpy().tolist())), list(df.columns)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, duck, name):
    def same(v):
        return pd.to_numeric(v, errors="coerce") if v.dtype == object and v.map(lambda x: isinstance(x, float) or x is None).all() else v

    got, want = flat(registry.QUERIES[name](spark, SF).toPandas().apply(same)), flat(duck.sql(registry.ORACLES[name]).df().apply(same))
    assert got[1] == want[1]
    assert [[str(_number(x)) for x in r] for r in got[0]] == [[str(_number(x)) for x in r] for r in want[0]]


def _number(x):
    try:
        return f"{float(x):.6g}"
    except ValueError:
        return x


TEXTS = ["Hello\nworld", " tab\there ", "a  b\n\n c ", "你 好 吗 a 你", "‘quoted’ “text”", "e\u0301", "안녕 하세요", "", "\x07bell", "café no", "x\u2028y", "ÄÖ  ß"]


def test_text_functions_agree(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = df.select("t", T.normalize(F.col("t")).alias("n"), T.key(F.col("t")).alias("k"), T.hangul_key(F.col("t")).alias("h"), T.reference_key(F.col("t")).alias("r")).collect()
    for r in got:
        assert (r.n, r.k) == (R.normalize(r.t), R.key(r.t))
        assert r.r == " ".join(unicodedata.normalize("NFC", r.t).split())
        assert r.h == ("".join(R.key(r.t).split()) if any("가" <= c <= "힣" for c in r.t) else R.key(r.t))


def test_protected_changes(spark):
    pairs = [("I can go", "I can't go"), ("Room 2", "Room 3"), ("Go?", "Go!"), ("hello", "hallo"), ("我去", "我不去"), ("Nein", "Nicht"), ("a", "A")]
    got = spark.createDataFrame(pairs, "a string, b string").select(T.protected_change(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.p for r in got] == [R.protected(a, b) for a, b in pairs] == [True, True, True, False, True, True, False]


def test_fixed_formats(spark):
    one = spark.range(1)
    values = one.select(
        T.stamp(F.lit(3599.9996)).alias("srt"), T.stamp(F.lit(3661.23), True).alias("ass"), T.ass_text(F.lit("a{b}\\c\nd")).alias("text"), T.seconds(F.lit("01:02:03,5")).alias("s"),
        T.episode(F.lit("Show.S02E03.mkv")).alias("a"), T.episode(F.lit("剧 第12集")).alias("b"), T.episode(F.lit("movie 2021")).alias("c"), T.video_stem(F.lit("C:\\v\\a.b.mp4")).alias("stem"),
    ).first()
    assert (values.srt, values.ass, values.text, values.s, values.stem) == ("01:00:00,000", "1:01:01.23", "a｛b｝＼c\\Nd", 3723.5, "a.b")
    assert [tuple(x) for x in (values.a, values.b, values.c)] == [(2, 3), (None, 12), (None, None)]
    guesses = spark.createDataFrame([("안녕",), ("こんにちは",), ("你好",), ("hello",), ("1",)], "t string").select(T.guess_language(F.col("t")).alias("g")).collect()
    assert [g.g for g in guesses] == ["ko-KR", "ja-JP", "zh-Hans", "en-US", None]


def test_progress(spark):
    def of(*jobs):
        return Q.progress(spark.createDataFrame(jobs, "status string, duration long, processed long")).first()["progress"]

    assert of(("done", 10, 0), ("pending", 90, 0)) == 100
    assert of(("done", 10, 0), ("running", 90, 45)) == 550
    assert of(("done", 10, 0), ("running", 90, 90)) < 1000
    assert of(("done", 10, 0), ("done", 90, 0)) == 1000


def test_output_stems_refuse_paths_outside(spark):
    entries = spark.createDataFrame([("/a/x.mkv", "s/x.mkv"), ("/b/X.mp4", "s/X.mp4"), ("/c/y.mkv", "s/y.mkv")], "source string, relative string")
    stems = {r.source: r.stem for r in Q.output_stems(entries).collect()}
    assert stems["/c/y.mkv"] == "s/y" and stems["/a/x.mkv"] != stems["/b/X.mp4"] and stems["/a/x.mkv"].endswith("/x")
    with pytest.raises(Exception, match="within the output folder"):
        Q.output_stems(spark.createDataFrame([("/a", "../x.mkv")], "source string, relative string")).collect()


def test_subtitle_files(spark, tmp_path):
    (tmp_path / "a.srt").write_text("﻿2\n00:00:03,000 --> 00:00:04,500 x\nsecond\nline\n\n1\n00:00:01,000 --> 00:00:02,000\nfirst\n", encoding="utf-8")
    (tmp_path / "b.ass").write_text("[Script Info]\nTitle: x\n[Events]\nFormat: Layer, Start, End, Text\nDialogue: 0,0:00:01.00,0:00:02.50,{\\an8}hi\\Nthere, you\n[Fonts]\n", encoding="utf-8")
    (tmp_path / "c.json").write_text('{"events": [{"start": 1, "end": 2, "text": "j"}]}', encoding="utf-8")
    got = sorted((os.path.basename(r.path), r.start, r.end, r.text) for r in subtitles.read_cues(spark, str(tmp_path)).collect())
    assert got == [("a.srt", 1.0, 2.0, "first"), ("a.srt", 3.0, 4.5, "second\nline"), ("b.ass", 1.0, 2.5, "hi\nthere, you"), ("c.json", 1.0, 2.0, "j")]
    with pytest.raises(ValueError):
        subtitles.parse("x.srt", "nothing here")


def test_lines_are_read_in_rows(spark):
    def line(text, x, y, confidence=0.9):
        return ({"x": x, "y": y, "w": 0.1, "h": 0.1}, [(text, confidence)])

    rows = [(1, [line("right", 0.6, 0.51), line("left", 0.1, 0.5), line("below", 0.1, 0.8, 0.6), line("weak", 0.1, 0.1, 0.4), line("--", 0.1, 0.3)])]
    r = subtitles.with_text(spark.createDataFrame(rows, f"frame long, lines array<{subtitles.LINE}>")).first()
    assert (r.text, r.confidence) == ("left right\nbelow", 0.6)
