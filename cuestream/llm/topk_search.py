"""Exact top-k inner-product search with block-at-a-time pruning."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuestream.llm.common import checkpointed, map_batches, ship, table

TOP = 20
SCALE = 64
#: Vectors of a block, which share bounds, and of a slab, which is searched in one go.
BLOCK, SLAB = 128, 1 << 13
#: Vectors of a box, by which slabs are bounded before any vector is sent, and boxes that are bounded together.
BOX, BOXES_AT_ONCE = 512, 1 << 14
#: Queries that are searched for together, and slabs that a query is sent to at first.
QUERIES_AT_ONCE, FIRST_SLABS = 1024, 2
#: A bounded sample of vectors orders the index and gives each query a first threshold.
SAMPLE, CENTRES = 4096, 64
_EXACT = float(1 << 53)


def _quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, dim, v: integer components of every vector that takes part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(~bad).select(F.col("vec_id").cast("long").alias("vec_id"), F.size(x).alias("dim"), whole.alias("v"))


def _matrix(rows, dim: int) -> np.ndarray:
    """Rows of integers; as doubles where every inner product of such rows is exact in them, else as objects."""
    flat = np.array([x for row in rows for x in row], dtype=np.int64).reshape(len(rows), dim)
    most = float(np.abs(flat.astype(float)).max(initial=0))
    return flat.astype(float) if most * most * max(dim, 1) < _EXACT else flat.astype(object)


def _merge(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of both, by score and then the smaller id, for each row."""
    s, i = np.concatenate([scores, more], axis=1), np.concatenate([ids, more_ids], axis=1)
    if s.shape[1] > 4 * k and s.dtype != object:
        # Whatever ties with the k-th best is kept until ids decide.
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        width = max(k, int((s >= kth[:, None]).sum(axis=1).max(initial=0)))
        at = np.argsort(-s, axis=1, kind="stable")[:, :width] if width > 4 * k else np.argpartition(-s, width - 1, axis=1)[:, :width]
        s, i = np.take_along_axis(s, at, 1), np.take_along_axis(i, at, 1)
    order = np.stack([np.lexsort((b, -a)) for a, b in zip(s, i, strict=True)])[:, :k] if len(s) else np.zeros((0, k), int)
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def search(queries: np.ndarray, query_ids: np.ndarray, docs: np.ndarray, doc_ids: np.ndarray, floor: np.ndarray, k: int = TOP, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """Block-at-a-time search of one slab: scores and ids (-1: none) of each query's best k that may
    be among its best overall, and how many (query, block) pairs were scored.

    A block is a range of documents. Its bound for a query sums the greatest contribution that each
    term can have in it: by the block's maximum where the query's component is positive, by its
    minimum where it is negative. Each query takes blocks from the highest bound down and stops when a
    bound is below its k-th score, or below floor, a lower bound of that from elsewhere; one that
    ties is still scored, as a smaller id may win.
    """
    n, q = len(docs), len(queries)
    starts = np.arange(0, n, block)
    kind = object if object in (docs.dtype, queries.dtype) else float
    top = np.maximum.reduceat(docs, starts, axis=0) if n else docs
    low = np.minimum.reduceat(docs, starts, axis=0) if n else docs
    bounds = np.where(queries > 0, queries, 0) @ top.T + np.where(queries < 0, queries, 0) @ low.T
    order = np.argsort(-bounds.astype(float), axis=1, kind="stable")
    worst = -np.inf
    scores, ids = np.full((q, k), worst, dtype=kind), np.full((q, k), -1, np.int64)
    live, scored = np.arange(q), 0
    for turn in range(len(starts)):
        b = order[live, turn]
        need = np.maximum(scores[live, k - 1].astype(float), floor[live])
        keep = bounds[live, b].astype(float) >= need
        live, b = live[keep], b[keep]
        if not len(live):
            break
        scored += len(live)
        for at in np.unique(b):
            rows = live[b == at]
            span = slice(starts[at], starts[at] + block)
            got = queries[rows] @ docs[span].T
            own = query_ids[rows][:, None] == doc_ids[span][None, :]
            got = np.where(own, worst, got)
            found = np.where(own, -1, np.broadcast_to(doc_ids[span], own.shape))
            scores[rows], ids[rows] = _merge(scores[rows], ids[rows], got, found, k)
    return scores, ids, scored


def _centres(sample: np.ndarray, n: int) -> np.ndarray:
    """Centres of a bounded sample, by a few rounds of the usual two steps from evenly spaced rows."""
    x = sample.astype(float)
    centres = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)] if len(x) else x
    for _ in range(5):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1) if len(x) else []
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = x[near == c].mean(axis=0)
    return centres


def _boxes(slabs: DataFrame) -> DataFrame:
    """slab, dim, top, low: the greatest and least component of each term in every BOX consecutive vectors of a slab."""

    def fit(batch):
        slab, dims = batch["slab"].to_numpy(), batch["dim"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, (slab[1:] != slab[:-1]) | (dims[1:] != dims[:-1])])
        out = {"slab": [], "dim": [], "top": [], "low": []}
        for a, b in zip(cuts, np.r_[cuts[1:], len(slab)], strict=True):
            for k in range(a, b, BOX):
                rows = batch["v"].slice(k, min(BOX, b - k))
                m = rows.flatten().to_numpy().reshape(len(rows), int(dims[a])) if dims[a] else np.zeros((len(rows), 0), np.int64)
                for name, x in (("slab", slab[a]), ("dim", dims[a]), ("top", m.max(axis=0)), ("low", m.min(axis=0))):
                    out[name].append(x)
        yield out

    return map_batches(slabs.select("slab", "dim", "v"), fit, "slab long, dim int, top array<long>, low array<long>")


def box_bounds(queries: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and box no less than the best score in the box, whatever the rounding."""
    queries, top, low = (x.astype(float) for x in (queries, top, low))
    most = np.abs(queries) @ np.maximum(np.abs(top), np.abs(low)).T
    return np.maximum(queries, 0) @ top.T + np.minimum(queries, 0) @ low.T + most * 1e-12


def top_k(vectors: DataFrame, is_query, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """Columns query_id, rank, vec_id, score: for each row where is_query holds its k best others.

    Vectors that are null or hold null or non-finite components take no part; a null vec_id neither. Vectors
    of another length than the query's are no candidates. Ties go to the smaller vec_id; a query with
    fewer than k candidates gets them all. Rows that repeat a vec_id are candidates each, but never of
    that id. Extra columns are left out. An empty table gives an empty result.

    The index is sorted by centre and id, over a bounded sample's centres, and cut into slabs of consecutive
    vectors, each with its blocks; all vectors are in it. Before vectors meet, queries are bounded against small boxes
    of each slab, and go only to slabs that may hold something above what the sample gives them; first to the
    best of these, and to the others if their bound still reaches the k-th score found there.
    """
    spark = vectors.sparkSession
    ship(spark)
    whole = checkpointed(_quantised(vectors, scale))
    shape = {r["dim"]: r for r in whole.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).collect()}
    n = sum(r["n"] for r in shape.values())
    drawn = whole.where(F.pmod(F.xxhash64(F.lit(11), "vec_id"), F.lit(max(n, 1))) < SAMPLE).limit(2 * SAMPLE).orderBy("vec_id").collect()
    samples = {d: (np.array([r["vec_id"] for r in drawn if r["dim"] == d], np.int64), _matrix([r["v"] for r in drawn if r["dim"] == d], d)) for d in shape}
    fitted = spark.sparkContext.broadcast((samples, {d: _centres(m, CENTRES) for d, (_, m) in samples.items()}))
    schema = "vec_id long, dim int, v array<long>"

    def place(batch):
        dims = batch["dim"].to_numpy()
        centre = np.zeros(len(dims), np.int32)
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            centres = fitted.value[1][int(d)]
            if d and len(centres):
                x = np.asarray(batch["v"].take(at).flatten().to_numpy(), float).reshape(len(at), d)
                centre[at] = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        yield {c: batch[c] for c in ("vec_id", "dim", "v")} | {"centre": centre}

    placed = map_batches(whole, place, schema + ", centre int")
    parts = max(1, math.ceil(n / SLAB))
    ordered = placed.repartitionByRange(parts, "dim", "centre", "vec_id").sortWithinPartitions("dim", "centre", "vec_id")
    slabs = checkpointed(ordered.withColumn("slab", F.spark_partition_id().cast("long") * (1 << 24) + F.floor((F.monotonically_increasing_id() % (1 << 33)) / SLAB)))
    boxes = checkpointed(_boxes(slabs).withColumn("b_group", F.floor(F.rand(19) * max(1, math.ceil(n / (BOX * BOXES_AT_ONCE)))).cast("int")))
    groups = boxes.select(F.col("dim").alias("g_dim"), F.col("b_group").alias("q_group")).distinct()
    batches = {d: max(1, math.ceil(r["q"] / QUERIES_AT_ONCE)) for d, r in shape.items()}
    count = F.coalesce(*[F.when(F.col("dim") == d, F.lit(b)) for d, b in batches.items()], F.lit(1))
    queries = whole.where(is_query).withColumn("batch", F.pmod(F.xxhash64(F.lit(13), "vec_id"), count).cast("int"))
    # Keys of both sides of a cogroup must be of one type: rows are dealt by their bytes.
    asked = queries.join(groups, F.col("dim") == F.col("g_dim")).select(F.col("dim").alias("q_dim"), F.col("batch").alias("q_batch"), "q_group", "vec_id", "v")
    offered = boxes.withColumn("batch", F.explode(F.sequence(F.lit(0), count - 1)))

    def bound(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "dim": [], "slab": [], "bound": [], "floor": []}
        if len(left) and len(right):
            d = int(key[0])
            m, ids = _matrix(left["v"].tolist(), d), left["vec_id"].to_numpy()
            sample_ids, sample = fitted.value[0][d]
            floor = np.full(len(left), -np.inf)
            if len(sample) > k + 1:
                got = np.where(ids[:, None] == sample_ids[None, :], -np.inf, (m @ sample.T).astype(float))
                floor = np.partition(got, got.shape[1] - k, axis=1)[:, got.shape[1] - k]
            slab, of = np.unique(right["slab"].to_numpy(), return_inverse=True)
            by_box = box_bounds(m, *(np.array(right[c].tolist(), np.int64).reshape(len(right), d) for c in ("top", "low")))
            by_slab = np.full((len(left), len(slab)), -np.inf)
            np.maximum.at(by_slab.T, of, by_box.T)
            rows, columns = np.nonzero(by_slab >= floor[:, None])
            out = {"query_id": ids[rows], "dim": np.full(len(rows), d), "slab": slab[columns], "bound": by_slab[rows, columns], "floor": floor[rows]}
        return pd.DataFrame(out).astype({"query_id": "int64", "dim": "int32", "slab": "int64", "bound": "float64", "floor": "float64"})

    met = asked.groupBy("q_dim", "q_batch", "q_group").cogroup(offered.groupBy("dim", "batch", "b_group")).applyInPandas(bound, "query_id long, dim int, slab long, bound double, floor double")
    best = F.row_number().over(W.partitionBy("query_id", "dim").orderBy(F.desc("bound"), "slab"))
    meetings = met.groupBy("query_id", "dim", "slab").agg(F.max("bound").alias("bound"), F.min("floor").alias("floor"))
    meetings = checkpointed(meetings.withColumn("turn", best))

    def pair(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            d = int(right["dim"].iloc[0])
            right = right.sort_values(["centre", "vec_id"])
            queries, docs = _matrix(left["v"].tolist(), d), _matrix(right["v"].tolist(), d)
            query_ids, doc_ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
            scores, ids, _ = search(queries, query_ids, docs, doc_ids, left["floor"].to_numpy(), k)
            rows, columns = np.nonzero(ids >= 0) if (doc_ids >= 0).all() else np.nonzero(scores.astype(float) > -np.inf)
            out = {"query_id": query_ids[rows], "vec_id": ids[rows, columns], "score": [int(x) for x in scores[rows, columns]]}
        return pd.DataFrame(out).astype("int64")

    def searched(pairs: DataFrame) -> DataFrame:
        """The best of each query in the slabs that it is sent to. A slab is copied for every so many queries that it gets."""
        load = pairs.groupBy("slab", "dim").agg(F.ceil(F.count("*") / QUERIES_AT_ONCE).cast("int").alias("copies"))
        dealt = pairs.join(load, ["slab", "dim"]).withColumn("batch", F.pmod(F.xxhash64(F.lit(23), "query_id"), F.col("copies")).cast("int"))
        left = dealt.join(whole.select(F.col("vec_id"), F.col("dim").alias("v_dim"), "v"), (F.col("query_id") == F.col("vec_id")) & (F.col("dim") == F.col("v_dim"))).select("vec_id", "v", F.col("slab").alias("q_slab"), F.col("dim").alias("q_dim"), F.col("batch").alias("q_batch"), "floor")
        right = slabs.join(load, ["slab", "dim"]).withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        return left.groupBy("q_slab", "q_dim", "q_batch").cogroup(right.groupBy("slab", "dim", "batch")).applyInPandas(pair, "query_id long, vec_id long, score long")

    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    first = checkpointed(searched(meetings.where(F.col("turn") <= FIRST_SLABS)).withColumn("rank", rank).where(F.col("rank") <= k))
    kth = first.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("kth"))
    rest = meetings.where(F.col("turn") > FIRST_SLABS).join(kth, "query_id", "left").withColumn("floor", F.greatest("floor", "kth")).where(F.col("bound") >= F.col("floor")).select("query_id", "dim", "slab", "floor")
    found = first.drop("rank").union(searched(rest))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_block_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SEARCH_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id AND len(q.v) = len(d.v)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_block_pruning": op2_block_pruning}
ORACLES: dict[str, str] = {"op2_block_pruning": SEARCH_SQL}
