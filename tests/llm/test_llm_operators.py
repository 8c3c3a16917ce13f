"""The training-data operators against brute force, exact round trips and held-out accuracy, on small tables
with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from cuestream.llm import chat_format, components, decontamination, language_id, near_dedup, packing, quality, sharding, substring_dedup, token_counts, tokens, topk_search  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
rng = random.Random(5)
WORDS = ["the", "of", "and", "über", "straße", "naïve", "don't", "x1", "--", "漢字", "token", "😀", "a", "is", "re-run"]


def prose(n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", "  ", " \n", ". "]) for _ in range(n))


ODD = [None, "", " ", "\n\n", "  two  spaces  ", "tab\t x \n y ", "end ", " <|endoftext|> inside <|endoftext|>", "ends<|endoftext|>", "a" * 3000, "漢" * 500, "don't won't  'll", "\x1c \x85 ", "é" * 40 + " b"]


@pytest.fixture(scope="module")
def documents(spark):
    texts = [*ODD, *[prose(rng.randint(1, 400)) for _ in range(40)], prose(9000)]
    texts += texts[20:30]
    rows = [(i, t, "x", 7) for i, t in enumerate(texts)] + [(3, texts[3], "x", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, n_tokens int")


def ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


def library(cache=[]):  # noqa: B006
    if not cache:
        cache.append(tokens.library(PATH))
    return cache[0]


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 512), (300, 130), (2000, 200)])
def test_token_counts(documents, chunk, overlap):
    got = token_counts.count_tokens(documents, PATH, chunk_chars=chunk, overlap_chars=overlap).collect()
    want = sorted((r.doc_id, len((r.text or "").encode()), len(ids(r.text))) for r in documents.collect())
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_token_counts_of_an_empty_table(documents):
    assert token_counts.count_tokens(documents.limit(0), PATH).count() == 0


def test_word_memo_is_bounded_and_exact():
    w = tokens.Words(PATH)
    w.count_of.size = 7
    for text in [t for t in ODD if t] + [prose(200) for _ in range(20)]:
        assert w.count(text) == len(ids(text))
        assert w.ids(text) == array("I", ids(text)).tobytes()
    assert len(w.count_of) <= 7


def test_long_texts_are_cut_at_safe_spaces():
    text = prose(400)
    parts = list(tokens.segments(text, 50))
    assert len(parts) > 3 and " ".join(parts) == text


def test_packing(documents):
    got = packing.pack(documents, PATH).collect()
    texts = defaultdict(set)
    for r in documents.collect():
        texts[r.doc_id].add(r.text or "")
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        whole = array("I", ids(next(iter(texts[r.doc_id]))) + [2]).tobytes()
        assert zlib.crc32(whole[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
        assert r.length <= 1024 and (r.piece == 0 or r.length == 1024)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r.length for r in got) == sum(len(ids(r.text)) + 1 for r in documents.collect())
    assert packing.pack(documents.limit(0), PATH).count() == 0


def test_plan_holds_every_piece_and_few_sequences():
    for seed in range(5):
        r = random.Random(seed)
        histogram = {r.randint(1, 1024): r.randint(1, 50) for _ in range(120)}
        plan = packing.plan_sequences(histogram, 1024, 60)
        held = defaultdict(int)
        for config, copies in plan:
            assert sum(n * k for n, k in config.items()) <= 1024
            for n, k in config.items():
                held[n] += k * copies
        assert held == histogram
        least = -(-sum(n * k for n, k in histogram.items()) // 1024)
        assert sum(k for _, k in plan) <= least * 1.2 + 2


def test_sharding(documents):
    got = sharding.shard(documents, 4).collect()
    assert len(got) == documents.count()
    want = {r.doc_id: (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in documents.collect()}
    slots = defaultdict(list)
    for r in got:
        assert (r["size"], r.text_crc32) == want[r.doc_id] and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    assert sharding.shard(documents.limit(0)).count() == 0


def test_sharding_divides_a_hot_text(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    sizes = [r["b"] for r in sharding.shard(rows, 16).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 16 and max(sizes) < 1.05 * sum(sizes) / 16 and min(sizes) > 0.95 * sum(sizes) / 16


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 200, "ann", "bye"), (1, 200, "ann", "bye"), (2, 0, None, "alone"), (3, 0, "system", "only"), (None, 1, "ann", "null id")]
    got = chat_format.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("name", F.lit(1))).collect()
    talks = defaultdict(list)
    for r in got:
        talks[r.conv_id, r.perspective].append(r)
    assert set(talks) == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "ann")}
    for talk in talks.values():
        talk.sort(key=lambda r: r.start_char)
        text = "".join(r.rendered for r in talk)
        for r in talk:
            assert text[r.start_char : r.end_char] == r.rendered
            assert (r.mask_start is not None) == bool(r.loss_mask) == (r.role_out == "assistant")
            if r.loss_mask:
                assert text[r.mask_start : r.mask_end].endswith("<|end|>")
    assert [r.role_out for r in talks[1, "bob"]] == ["system", "user", "assistant", "user", "user"]


def shingle_sets(rows):
    out = {}
    for i, text in rows:
        w = (text or "").lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def classes(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
                    low, high = sorted((find(a), find(b)))
                    root[high] = low
    return {i: find(i) for i in sets}


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 16)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "one  TWO"), (4, "x " * 500)]
    for i in range(5, 90):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            words[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))) for i in range(90, 110)] + [(110, rows[30][1]), (111, rows[30][1].upper())]
    docs = spark.createDataFrame(rows + [rows[6]], "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows) + 1
    assert {r.doc_id: r.class_id for r in got} == classes(shingle_sets(rows))
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c in classes(shingle_sets(rows)).values()})
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_that_repeat_a_line(spark):
    """Pairs of Jaccard 0.8 or more, one of which says a line once and the other 200 times."""
    rows = []
    for k in range(0, 120, 2):
        words, line = " ".join(f"t{k}w{i}" for i in range(64)), " ".join(f"t{k}l{i}" for i in range(10))
        rows += [(k, f"{words} {line}"), (k + 1, words + f" {line}" * 200)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: i - i % 2 for i, _ in rows} == classes(shingle_sets(rows))


def test_prob_min_hash_estimates_probability_jaccard():
    r = np.random.default_rng(2)
    x, y = r.integers(1, 9, 60).astype(float), r.integers(1, 9, 60).astype(float)
    x[:15], y[45:] = 0, 0
    hashes = r.integers(1, 2**63, 60).astype(np.uint64)
    signatures = [near_dedup.prob_min_hash(np.zeros((w > 0).sum(), int), hashes[w > 0], w[w > 0], 1, 4096)[0] for w in (x, y)]
    both = (x > 0) & (y > 0)
    exact = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in np.flatnonzero(both))
    assert abs((signatures[0] == signatures[1]).mean() - exact) < 0.04


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (3, 3), (5, 1), (2, 1)], "u long, v long")
    assert {r.node: r.component for r in components.components(links).collect()} == {1: 1, 2: 1, 3: 1, 5: 1, 7: 7, 8: 7, 9: 7}


def brute_dedup(rows):
    seen, out = {}, []
    by_id = sorted(rows, key=lambda r: r[0])
    for i, text in by_id:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for k in range(len(w) - 12):
            seen[tuple(w[k : k + 13])] = min(i, seen.get(tuple(w[k : k + 13]), i))
    for i, text in by_id:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for k in range(len(w) - 12):
            if seen[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_substring_dedup(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "dd"]) for _ in range(rng.randint(0, 120)))) for i in range(40)]
    rows += [(50 + i, prose(30) + " " + " ".join(passage.split()[i % 5 : 20 + i]) + "\t" + prose(20)) for i in range(12)]
    rows += [(70, "r " * 60), (71, "r " * 80), (72, "s " + "r " * 30), (80, None), (81, ""), (82, "\x1c\x85\xa0 same\x0bword"), (83, rows[45][1]), (84, rows[45][1].replace(" ", "  ")), (85, passage)]
    rows += [rows[44], (86, rows[41][1]), (86, passage + " more"), (87, " ".join(["x y"] * 40)), (88, " ".join(["y x"] * 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit(0))
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs).collect())
    assert got == brute_dedup(rows)
    cleaned = substring_dedup.deduplicated(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    before, after = sorted((i, digest(t or "")) for i, t in rows), sorted((r.doc_id, digest(r.text or "")) for r in cleaned.collect())
    removed = {(i, sha) for i, _, n, sha in brute_dedup(rows) if n}
    assert {x for x in after if x not in before} <= removed and len(after) == len(before)
    assert all(after.count(x) >= 1 for x in removed)
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0


def test_anchors_depend_on_the_window_alone():
    texts = [" ".join(rng.choice(["a", "b", "a", "c", "e", "f"]) for _ in range(rng.randint(13, 60))).encode() for _ in range(60)]
    codes, at = substring_dedup.byte_words.flat(texts)
    place, name = substring_dedup.anchors(codes, at)
    of = {}
    for p, n in zip(place, name, strict=True):
        window = tuple(codes[p : p + 13].tolist())
        assert of.setdefault(window, n) == n


def brute_tiles(doc, item, least):
    marked_d, marked_i, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in marked_d and j + n not in marked_i:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return sum(t[0] for t in tiles)
        tiles.append(best)
        marked_d |= set(range(best[1], best[1] + best[0]))
        marked_i |= set(range(best[2], best[2] + best[0]))


def test_tiling_against_brute_force():
    for seed in range(40):
        r = random.Random(seed)
        doc = np.array([r.randint(1, 6) for _ in range(60)], np.uint64)
        item = np.array([r.randint(1, 6) for _ in range(25)], np.uint64)
        tiles = decontamination.tile(doc, item, 3)
        assert sum(t[2] for t in tiles) == brute_tiles(doc.tolist(), item.tolist(), 3)


def test_contamination(spark):
    item = [f"q{k}" for k in range(30)]
    reordered = item[15:] + ["other", "words"] + item[:15]
    texts = [None, "", prose(100), prose(20) + " " + " ".join(item).upper() + "! " + prose(20), " ".join(reordered), " ".join(item[:10]) + " " + prose(30), " ".join(x for k in range(0, 30, 3) for x in (*item[k : k + 3], "cut"))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("coverage", F.lit("clash"))
    tests = spark.createDataFrame([(0, " ".join(item)), (1, "too short"), (2, None), (3, "")], "item_id long, text string")
    got = decontamination.contaminated(docs, tests).collect()
    assert sorted((r.doc_id, r.item_id, r.covered, r.tiles) for r in got) == [(3, 0, 30, 1), (4, 0, 30, 2)]
    assert sorted(r.doc_id for r in decontamination.clean(docs, tests).collect()) == [0, 1, 2, 5, 6]
    assert decontamination.contaminated(docs.limit(0), tests).count() == 0 == decontamination.contaminated(docs, tests.limit(0)).count()


def test_language_id(spark):
    said = {"en": "the cat and the dog were in that house with this thing", "de": "der hund und die katze sind nicht mit einem haus zu sehen", "es": "el perro y la casa con una cosa que no es para el"}
    rows = [(i, " ".join(rng.choice(said[lang].split()) for _ in range(20)), lang) for i, lang in enumerate(list(said) * 60)]
    docs = spark.createDataFrame(rows + [(900, "no label", None), (901, None, "en")], "doc_id long, text string, lang string")
    model = language_id.train(docs.where("doc_id % 4 <> 1 or lang is null"))
    assert model.languages == ["de", "en", "es"]
    asked = spark.createDataFrame([*rows, (1000, None, ""), (1001, "12 !?", ""), (1002, "hundehaus", "")], "doc_id long, text string, score string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(asked, model).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows) and all(0 <= s <= 1 for _, s in got.values())
    assert got[1000] == got[1001] == ("und", 0.0) and got[1002][0] == "de"
    nothing = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(asked, nothing).collect()} == {"und"}


def test_quality(spark):
    good = [(i, " ".join(rng.choice(["calm", "river", "stone", "walks", "under", "trees", "slowly", "birds"]) + rng.choice(["", ".", ","]) for _ in range(rng.randint(20, 90)))) for i in range(150)]
    junk = [(150 + i, " ".join(rng.choice(["BUY!!", "$$$", "NOW!!", "###"]) for _ in range(rng.randint(20, 90)))) for i in range(60)]
    docs = spark.createDataFrame([*good, *junk, (300, None), (301, "")], "doc_id long, text string").withColumn("predicted", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(210)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in quality.scored(docs, model).collect()}
    held = [i for i in range(0, 210, 5)]
    assert sum(got[i].predicted == int(i < 150) for i in held) >= len(held) - 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert quality.fit(np.zeros((0, 2)), np.zeros(0), ["a", "b"]).rules == []
    assert quality.scored(docs.limit(0), model).count() == 0


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SLAB", 64)
    monkeypatch.setattr(topk_search, "BLOCK", 8)
    monkeypatch.setattr(topk_search, "QUERIES_AT_ONCE", 8)
    monkeypatch.setattr(topk_search, "BOX", 16)
    r = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in r.normal(size=6).round(1)]) for i in range(400)]
    vectors[7] = (7, vectors[8][1])
    odd = [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (520, [2.0, 1.0]), (521, [1.0, 3.0]), (None, [0.0] * 6)]
    rows = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for x in topk_search.top_k(rows, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x["rank"], x.vec_id, x.score))
    whole = {i: np.floor(64 * np.array(v)).astype(int) for i, v in vectors}
    for q in range(0, 400, 20):
        best = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:20]
        assert got[q] == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got[520] == [(1, 521, 128 * 64 + 64 * 192)] and set(got) == {*range(0, 400, 20), 520}
    assert topk_search.top_k(rows.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_over_many_partitions(spark, monkeypatch):
    """Groups that meet must meet wherever they are dealt: nothing puts small partitions together here."""
    monkeypatch.setattr(topk_search, "SLAB", 64)
    monkeypatch.setattr(topk_search, "BOX", 16)
    monkeypatch.setattr(topk_search, "QUERIES_AT_ONCE", 8)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    r = np.random.default_rng(13)
    v = r.normal(size=(900, 5))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for x in topk_search.top_k(rows, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    for k, old in before.items():
        spark.conf.set(k, old)
    whole = np.floor(64 * v).astype(int)
    for q in range(0, 900, 20):
        best = sorted(((-int(whole[q] @ whole[i]), i) for i in range(900) if i != q))[:20]
        assert got[q] == [(i, -s) for s, i in best]


def test_box_bounds_hold():
    r = np.random.default_rng(8)
    for size in (3, 40, 10**9):
        docs, queries = r.integers(-size, size, (64, 7)), r.integers(-size, size, (20, 7))
        bounds = topk_search.box_bounds(queries, docs.reshape(4, 16, 7).max(axis=1), docs.reshape(4, 16, 7).min(axis=1))
        best = (queries.astype(object) @ docs.T.astype(object)).reshape(20, 4, 16).max(axis=2)
        assert all(bounds[i, j] >= best[i, j] for i in range(20) for j in range(4))


def test_pruning_skips_blocks():
    r = np.random.default_rng(4)
    centres = r.normal(size=(20, 16)) * 40
    docs = np.floor(np.repeat(centres, 100, axis=0) + r.normal(size=(2000, 16)))
    scores, ids, scored = topk_search.search(docs[::200], np.arange(0, 2000, 200), docs, np.arange(2000), np.full(10, -np.inf), 20, 100)
    assert scored < 10 * 20 * 0.6
    for k, q in enumerate(range(0, 2000, 200)):
        best = sorted((-(docs[q] @ docs[i]), i) for i in range(2000) if i != q)[:20]
        assert [i for _, i in best] == ids[k].tolist()
