"""Near-duplicate detection by ProbMinHash, banding and verification."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuestream.llm.common import checkpointed, map_batches, table, written
from cuestream.llm.components import components
from cuestream.llm.wordcodes import inside, lower_words, mix, slices, windows

SHINGLE, SIMILARITY = 5, 0.8
#: At the similarity asked for, 1 - (1 - 0.8**5)**24 = 0.9999 of the pairs share a band.
BANDS, ROWS = 24, 5
#: What is compared in one task: two blocks of so many nodes and bytes of text at most.
BLOCK_NODES, BLOCK_BYTES = 512, 32 << 20


def shingles(texts: list[str], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, at, text, shingle, count): the distinct shingles of every text, in order of the text.
    A text of fewer words than a shingle has one, of all its words; one without words has none."""
    codes, at = lower_words.flat(texts)
    valid = inside(at, n)
    hashes, owner = windows(codes, n)[valid], np.repeat(np.arange(len(texts)), np.maximum(np.diff(at) - n + 1, 0))
    few = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < n))
    if len(few):
        whole = np.array([xxhash.xxh3_64_intdigest(codes[at[i] : at[i + 1]].tobytes()) for i in few], np.uint64)
        hashes, owner = np.r_[hashes, whole], np.r_[owner, few]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]) if len(hashes) else np.zeros(0, np.int64)
    return codes, at, owner[first], hashes[first], np.diff(np.r_[first, len(hashes)])


def prob_min_hash(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, registers: int) -> np.ndarray:
    """n signatures: registers that agree with the chance of the two weighted sets' probability Jaccard.

    Every element arrives by a Poisson process of its weight's rate, each time at a register that its
    hash picks; a register keeps its first arrival. An element is done when its next arrival is later
    than all of the set's registers have been taken.
    """
    taken = np.full(n * registers, np.inf)
    signature = np.zeros(n * registers, np.uint64)
    time, live, k = np.zeros(len(hashes)), np.arange(len(hashes)), 0
    with np.errstate(over="ignore"):
        while len(live):
            k += 1
            draw = mix(hashes[live] + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15))
            time[live] -= np.log(((draw >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / weights[live]
            place = owner[live] * registers + (mix(draw) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(taken, place, time[live])
            won = taken[place] == time[live]
            signature[place[won]] = hashes[live[won]]
            last = taken.reshape(n, registers).max(axis=1)
            live = live[time[live] < last[owner[live]]]
    return signature.reshape(n, registers)


def _signed(rows: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), f1, f2 (a fingerprint of the words; null without words), bands."""

    def sign(batch: pa.RecordBatch):
        ids, marks, texts = batch["doc_id"], batch["h"], batch["text"]
        for a, b in slices(texts):
            codes, at, owner, hashes, _ = shingles([t.as_py() or "" for t in texts[a:b]])
            # Every shingle weighs 1: registers agree with the chance of the similarity that links are verified by.
            signature = prob_min_hash(owner, hashes, np.ones(len(hashes)), b - a, BANDS * ROWS)
            bands = windows(signature.ravel(), ROWS)[::ROWS].reshape(b - a, BANDS) if b > a else np.zeros((0, BANDS), np.uint64)
            bands = mix(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            prints = [xxhash.xxh3_128_digest(codes[i:j].tobytes()) if j > i else None for i, j in zip(at, at[1:], strict=False)]
            offsets = pa.array(np.arange(0, (b - a + 1) * BANDS, BANDS, dtype=np.int32))
            yield {
                "doc_id": ids.slice(a, b - a), "h": marks.slice(a, b - a), "f1": [x and int.from_bytes(x[:8], "little", signed=True) for x in prints], "f2": [x and int.from_bytes(x[8:], "little", signed=True) for x in prints],
                "bands": pa.ListArray.from_arrays(offsets, pa.array(bands.ravel())),
            }

    return map_batches(rows, sign, "doc_id long, h long, f1 long, f2 long, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes whose shingles' Jaccard similarity is as asked for."""

    def check(batch: pa.RecordBatch):
        sets: dict[str, np.ndarray] = {}

        def of(text: str) -> np.ndarray:
            if text not in sets:
                if len(sets) >= 64:
                    sets.clear()
                sets[text] = shingles([text])[3]
            return sets[text]

        kept = []
        for i, (a, b) in enumerate(zip(batch["u_text"], batch["v_text"], strict=True)):
            a, b = of(a.as_py()), of(b.as_py())
            if min(len(a), len(b)) >= SIMILARITY * max(len(a), len(b)):
                shared = len(np.intersect1d(a, b, assume_unique=True))
                if shared >= SIMILARITY * (len(a) + len(b) - shared):
                    kept.append(i)
        yield {c: batch[c].take(pa.array(kept, pa.int32())) for c in ("u", "v")}

    of_v = texts.select(F.col("node").alias("v"), F.col("text").alias("v_text"))
    of_u = texts.select(F.col("node").alias("u"), F.col("text").alias("u_text"))
    return map_batches(pairs.join(of_v, "v").join(of_u, "u"), check, "u long, v long")


def _links_of(texts: list[str], component: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of texts that are similar and connect different components, as few as connect them."""
    _, _, owner, hashes, _ = shingles(texts)
    size = np.bincount(owner, minlength=len(texts))
    _, column, seen = np.unique(hashes, return_inverse=True, return_counts=True)
    common = seen[column] > 1
    owner, column = owner[common], np.unique(column[common], return_inverse=True)[1]
    shared = np.zeros((len(texts), len(texts)), np.float32)
    for low in range(0, int(column.max(initial=-1)) + 1, 4096):
        part = (column >= low) & (column < low + 4096)
        has = np.zeros((len(texts), 4096), np.float32)
        has[owner[part], column[part] - low] = 1
        shared += has @ has.T
    alike = (shared >= SIMILARITY * (size[:, None] + size[None, :] - shared)) & (component[:, None] != component[None, :])
    root = {int(c): int(c) for c in component}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(alike, 1))), strict=True):
        a, b = find(int(component[i])), find(int(component[j]))
        if a != b:
            root[a] = b
            out.append((i, j))
    return out


def _links_in_buckets(at: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) between different components of a bucket (columns bucket, node, component).

    Buckets of more than a block of nodes, or of bytes, are dealt into blocks that meet two by two, so no
    task holds more than two blocks; pairs are compared within a task and never sent.
    """
    sized = at.join(texts.select("node", F.octet_length("text").alias("size")), "node")
    blocks = sized.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("size") / BLOCK_BYTES)).alias("blocks"))
    own = F.pmod(F.xxhash64(F.lit(41), "node"), F.col("blocks"))
    dealt = at.join(blocks, "bucket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.where("own <> other or blocks = 1")
    dealt = dealt.select("bucket", "node", "component", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        node = pdf["node"].to_numpy()
        found = _links_of(pdf["text"].tolist(), pdf["component"].to_numpy()) if pdf["component"].nunique() > 1 else []
        return pd.DataFrame({"u": node[[i for i, _ in found]], "v": node[[j for _, j in found]]}, dtype="int64")

    return dealt.join(texts, "node").groupBy("bucket", "one", "two").applyInPandas(link, "u long, v long")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))


def _classes(rows: DataFrame) -> DataFrame:
    """doc_id, h, class_id, stands: of every row its group, and whether it stands for it, which only equal rows share."""
    signed = written(_signed(rows))
    worded = signed.where(F.col("f1").isNotNull())
    # A node is a sequence of words, whatever ids say it; a row with it, by id and text, shows where its text is.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "h")).alias("at")
    nodes = worded.groupBy("f1", "f2").agg(least, F.any_value("bands").alias("bands"))
    nodes = checkpointed(nodes.select(F.monotonically_increasing_id().alias("node"), "f1", "f2", "at", "bands"))
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    # A table of its own: the join with it is then by broadcast, or a bucket that many nodes are in can be split.
    leaders = written(buckets.groupBy("bucket").agg(F.min("node").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n"))
    buckets = written(buckets.join(leaders, "bucket"))
    pairs = buckets.where("u != node").select("u", F.col("node").alias("v")).distinct()
    # Texts without a partner are not sent.
    sought = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", F.col("at.doc_id").alias("of"), F.col("at.h").alias("of_h"))
    texts = rows.join(sought, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("of_h"))).select("node", "text").dropDuplicates(["node"])
    links = checkpointed(_verified(pairs, texts))
    found = checkpointed(components(links))
    at = buckets.join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed = written(at.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("bucket"))
    at = checkpointed(at.join(mixed, "bucket"))
    if at.take(1):
        more = checkpointed(_links_in_buckets(at, texts))
        if more.take(1):
            found = checkpointed(components(links.union(more)))
    linked = found.join(nodes.select("node", "f1", "f2", "at"), "node")
    groups = linked.groupBy("component").agg(F.min(F.struct("at", "f1", "f2")).alias("low"))
    grouped = linked.select("f1", "f2", "component").join(groups, "component").select("f1", "f2", "low")
    alone = nodes.join(grouped, ["f1", "f2"], "left_anti").select("f1", "f2", F.struct("at", "f1", "f2").alias("low"))
    classed = worded.select("doc_id", "h", "f1", "f2").join(grouped.union(alone), ["f1", "f2"])
    stands = F.col("doc_id").eqNullSafe(F.col("low.at.doc_id")) & (F.col("h") == F.col("low.at.h")) & (F.col("f1") == F.col("low.f1")) & (F.col("f2") == F.col("low.f2"))
    classed = classed.select("doc_id", "h", F.coalesce("low.at.doc_id", "low.f1").alias("class_id"), stands.alias("stands"))
    without = signed.where(F.col("f1").isNull()).select("doc_id", "h", F.col("doc_id").alias("class_id"), F.lit(None).cast("boolean").alias("stands"))
    return classed.union(without)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, class_id (the least id of its group): one row for each row of docs.

    Words are split at white space without regard to case; two documents are linked if the Jaccard
    similarity of their sets of five-word shingles is 0.8 or more (a text of fewer words is one shingle), and
    groups are what links connect. Documents of equal words are copies and are collapsed first, so a
    group of copies of any size is one node. A null text, and one without words, is alone. Rows that share an id, or
    have none, are told by their texts: each is in the group of its own text. A group without any id takes a number made from
    a text. Extra columns are left out. An empty table gives an empty result.

    In every bucket of a band all nodes are compared with the least, which connects large groups without
    their pairs; then buckets whose nodes are still in different components are compared as a whole, block
    by block, so that no link of a bucket is lost.
    """
    return _classes(_rows(docs, id_col, text_col)).select(F.col("doc_id").alias(id_col), "class_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group, with all columns: that of the least id; of equal rows one. Rows whose text is null
    or without words all stay."""
    key = {"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), "__h": F.xxhash64(text_col)}
    rows = checkpointed(_classes(_rows(docs, id_col, text_col)).where("stands is not null").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__id"), F.col("h").alias("__h"), "stands"))
    later = rows.where("not stands").select("__id", "__h").distinct()
    again = checkpointed(rows.where("stands").groupBy("__id", "__h").count().where("count > 1").drop("count"))
    kept = docs.withColumns(key).join(later, ["__id", "__h"], "left_anti")
    if not again.take(1):
        return kept.select(docs.columns)
    one = kept.join(again, ["__id", "__h"], "left_semi").dropDuplicates(["__id", "__h"])
    return kept.join(again, ["__id", "__h"], "left_anti").select(docs.columns).union(one.select(docs.columns))


def op5_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_prob_minhash": op5_prob_minhash}
ORACLES: dict[str, str] = {}
