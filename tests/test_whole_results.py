"""Queries that must take in all of their input."""

import pandas as pd
from pyspark.sql import functions as F

from cuestream.operators import layout as L
from cuestream.plans import cue_queries, job_queries, text_queries
from cuestream.plans.carriers import jobs, observations, table

SF = "/root/testdata/sf0.001"


def test_closure_of_a_chain_of_over_twenty_hops(spark):
    """Each event off the band is within 0.35 s of the one before only; the first is excluded by its layout."""
    rows = [(1, i, i * 50, i * 50 + 20, 80, 30, 10, 50.0, 88, 91, 10.0, "scene_text_layout" if i == 0 else None) for i in range(28)]
    rows.append((1, 99, 28 * 50, 28 * 50 + 20, 50, 90, 10, 50.0, 88, 91, 10.0, None))
    events = spark.createDataFrame(rows, "stream_id long, event_id long, start_cs long, end_cs long, x long, y long, h long, lx double, low long, high long, lh double, reason string")
    closed = L.track_closure(events)
    assert sorted(r.event_id for r in closed.where("reason is not null").collect()) == list(range(28))
    assert [(r.event_id, r.id) for r in L.renumber(closed).collect()] == [(99, 1)]


def test_renumbered_events_leave_out_tracks(spark, monkeypatch):
    rows = [(1, i, i * 100, i * 100 + 50, 30, 50, 90, 10) for i in range(12)] + [(1, 50, 5000, 5020, 3, 80, 30, 20), (1, 51, 5030, 5050, 3, 70, 90, 10), (1, 52, 6000, 6050, 30, 50, 90, 10)]
    rows[-2] = (1, 51, 5030, 5050, 30, 80, 33, 10)
    made = spark.createDataFrame(rows, "stream_id long, event_id long, start_cs long, end_cs long, frames long, x long, y long, h long").withColumn("x", F.when(F.col("event_id") == 51, 68).otherwise(F.col("x")))
    monkeypatch.setattr(text_queries, "layouts", lambda spark, sf_dir: made)
    caught = {r.event_id: r.reason for r in text_queries.scene_track_closure(spark, SF).collect()}
    got = {r.event_id: r.id for r in text_queries.renumbered_events(spark, SF).collect()}
    assert "scene_text_track" in caught.values()
    assert got == {e: i for i, e in enumerate([*range(12), 52], 1)}


def test_restore_removed_reads_all_videos(spark, monkeypatch):
    made = spark.range(1, 1001).select("id", F.concat(F.lit("/v/"), F.col("id").cast("string")).alias("source"))
    monkeypatch.setattr(job_queries, "videos", lambda spark, sf_dir: made)
    assert sorted((r.id, r.pos) for r in job_queries.restore_removed(spark, SF).collect()) == [(i, i - 1) for i in range(1, 1001)]


def test_missing_in_range_knows_all_jobs(spark):
    rows = jobs(spark, SF).select("season", "episode").toPandas()
    want = {(s, e) for s, g in rows.groupby("season") for e in set(range(g.episode.min(), g.episode.max() + 1)) - set(g.episode)}
    assert {(r.season, r.episode) for r in job_queries.missing_in_range(spark, SF).collect()} == want


def test_as_of_asks_for_all_orders(spark):
    seen = observations(spark, SF).select("stream_id", "start_us").toPandas()
    first, times = seen.start_us.min(), {k: sorted(g) for k, g in seen.groupby("stream_id").start_us}
    orders = table(spark, SF, "orders").select("o_orderkey", "o_custkey").toPandas()
    back, ahead = {}, {}
    for key, stream in zip(orders.o_orderkey, orders.o_custkey, strict=True):
        at = first + key % 30 * 86_400_000_000
        if before := [t for t in times.get(stream, []) if t <= at]:
            back[key] = before[-1]
        if after := [t for t in times.get(stream, []) if t >= at]:
            ahead[key] = after[0]
    assert {r.ask_id: r.start_us for r in cue_queries.asof_backward(spark, SF).collect()} == back
    assert {r.ask_id: r.start_us for r in cue_queries.asof_forward(spark, SF).collect()} == ahead


def test_seek_windows_hold_all_frames(spark):
    rows = observations(spark, SF).select("stream_id", "start_us").toPandas().sort_values(["stream_id", "start_us"])
    new = ~(rows.groupby("stream_id").start_us.diff() <= 86_400_000_000)
    want = pd.Series(1, rows.index).groupby([rows.stream_id, new.groupby(rows.stream_id).cumsum()]).sum()
    assert {(r.stream_id, r.window_id): r.n for r in cue_queries.seek_windows(spark, SF).collect()} == want.to_dict()


def test_edit_distance_reads_whole_texts(spark, monkeypatch):
    """Against a plain computation; texts over forty characters and of other scripts are in the result."""
    texts = ["the same beginning of forty characters, 1" + "x" * 30, "the same beginning of forty characters, 1" + "y" * 30, "é你好", "e你", "z"]
    made = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    monkeypatch.setattr(text_queries, "table", lambda spark, sf_dir, name: made)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {i: edits(a, b) for i, (a, b) in enumerate(zip(texts, texts[1:], strict=False))} | {4: None}
    assert {r.item_id: r.edits for r in text_queries.edit_distance(spark, "").collect()} == want
