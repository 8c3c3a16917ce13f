"""Packing documents into sequences by a configuration linear program."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuestream.llm import tokens
from cuestream.llm.common import checkpointed, map_batches, table

CAPACITY = 1024
END_ID = 2
#: Rounds of multiplicative weights in one solution of the program, and how often what rounding leaves is solved again.
ROUNDS, SOLUTIONS = 150, 8
#: Tokens of room that a configuration may waste to be rounded, by how often the program has been solved.
WASTE = (0, 0, 1, 4, 16, 64, 256, CAPACITY)
#: A round serves configurations worth this share of the dearest, each up to so much of its scarcest length's demand.
WORTH, STEP = 0.98, 1.0
#: How much dearer than its length the longest is at first, and how fast a length loses weight as its demand is served.
LONG, RATE = 0.3, 0.2

Plan = list[tuple[dict[int, int], int]]


def price(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """An unbounded knapsack by dynamic programming: for every room the greatest value of a configuration, and the
    place among lengths of an item that one takes (-1: none, the room below is as good)."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(lengths[0]), capacity + 1):
        fits = int(np.searchsorted(lengths, room, "right"))
        got = best[room - lengths[:fits]] + values[:fits]
        k = fits - 1 - int(np.argmax(got[::-1]))  # of equals the longest
        if got[k] > best[room - 1]:
            best[room], take[room] = got[k], k
        else:
            best[room] = best[room - 1]
    return best, take


def configuration(lengths: np.ndarray, take: np.ndarray, room: int) -> Counter[int]:
    """What the knapsack takes into a room."""
    config: Counter[int] = Counter()
    while room >= lengths[0]:
        if take[room] < 0:
            room -= 1
        else:
            config[int(lengths[take[room]])] += 1
            room -= int(lengths[take[room]])
    return config


def solve(demand: dict[int, int], capacity: int, rounds: int = ROUNDS) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """Multiplicative weights on the covering program: (fractions of sequences by configuration, lower bound).

    The dual prices begin at the lengths, long ones somewhat dearer as they combine with fewer others, and a length
    loses weight by the share of its demand that has been served. Each round one knapsack prices all configurations:
    for every length the dearest one that holds it comes from the same table, and those worth nearly as much as the
    dearest of all serve a step. Any prices bound the program from below, by the demand's value over the
    dearest configuration's.
    """
    lengths = np.array(sorted(demand))
    left = {n: float(k) for n, k in demand.items()}
    fractions: Counter[tuple[tuple[int, int], ...]] = Counter()
    bound = sum(n * k for n, k in demand.items()) / capacity
    for turn in range(rounds):
        lengths = np.array([n for n in lengths.tolist() if left[n] > 1e-6])
        if not len(lengths):
            break
        served = np.array([1 - left[n] / demand[n] for n in lengths.tolist()])
        values = lengths * (1 + LONG * lengths / capacity) * np.exp(-RATE * served)
        best, take = price(lengths, values, capacity)
        if not turn:
            bound = max(bound, float(values @ np.array([demand[n] for n in lengths.tolist()]) / best[capacity]))
        worth = values + best[capacity - lengths]
        least = WORTH * best[capacity]
        moved = False
        for i in np.flatnonzero((worth >= least) | (np.arange(len(lengths)) == np.argmax(worth)))[::-1].tolist():
            n = int(lengths[i])
            if left[n] <= 1e-6:
                continue
            config = configuration(lengths, take, capacity - n)
            config[n] += 1
            step = min(left[m] / k for m, k in config.items())
            if step <= 1e-6:
                continue
            step = step if step < 1 else float(max(1, int(STEP * step)))  # whole copies lose nothing to rounding
            fractions[tuple(sorted(config.items(), reverse=True))] += step
            for m, k in config.items():
                left[m] -= step * k
            moved = True
        if not moved:
            break
    return dict(fractions), bound


def serve(config: tuple[tuple[int, int], ...], copies: int, left: dict[int, int], plan: Counter) -> None:
    """Take as many whole copies as what is left allows."""
    copies = min(copies, *(left.get(n, 0) // k for n, k in config))
    if copies > 0:
        plan[config] += copies
        for n, k in config:
            left[n] -= k * copies
            if not left[n]:
                del left[n]


def best_fit(left: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on a histogram: items of one length go to bins with equal room at once."""
    rooms: dict[int, list[tuple[dict[int, int], int]]] = {}
    for n in sorted(left, reverse=True):
        todo = left[n]
        while todo:
            room = min((r for r in rooms if r >= n and rooms[r]), default=None)
            if room is None:
                per = min(capacity // n, todo)
                full, rest = divmod(todo, per)
                made = [({n: per}, full)] + [({n: rest}, 1)] * bool(rest)
                for config, k in made:
                    rooms.setdefault(capacity - n * config[n], []).append((config, k))
                break
            config, k = rooms[room].pop()
            per = min(room // n, todo)
            use = min(k, todo // per)
            if use < k:
                rooms[room].append((config, k - use))
            rooms.setdefault(room - n * per, []).append((config | {n: config.get(n, 0) + per}, use))
            todo -= use * per
    return [x for made in rooms.values() for x in made if x[1]]


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, report: dict | None = None) -> Plan:
    """Configurations (length: how many) with how many sequences use each; every piece is in one.

    The configuration program is solved over the lengths that occur and rounded: whole copies of each fraction, then
    single copies, the greatest rest first, as long as a whole one is left. What rounding leaves is a program of
    its own and is solved again; lengths that no rounding serves any more are packed by best fit. report takes
    `placed` (pieces by configurations), `pieces`, `bound` (of the program) and `sequences`.
    """
    left = {int(n): int(k) for n, k in histogram.items() if k > 0}
    pieces, bound = sum(left.values()), 0.0
    plan: Counter[tuple[tuple[int, int], ...]] = Counter()
    if capacity in left:
        bound = float(left[capacity])
        plan[((capacity, 1),)] += left.pop(capacity)
    for turn in range(SOLUTIONS):
        if not left:
            break
        fractions, least = solve(left, capacity, rounds)
        bound += least if not turn else 0
        # Room that a configuration wastes is lost for good, so those without any come first; what is left at last can do with some.
        slack = WASTE[min(turn, len(WASTE) - 1)]
        full = [c for c in fractions if capacity - sum(n * k for n, k in c) <= slack]
        for config in sorted(full, key=lambda c: (-fractions[c], c)):
            serve(config, int(fractions[config]), left, plan)
        for config in sorted(full, key=lambda c: (int(fractions[c]) - fractions[c], c)):
            serve(config, 1, left, plan)
    placed = pieces - sum(left.values())
    for config, k in best_fit(left, capacity):
        plan[tuple(sorted(config.items(), reverse=True))] += k
    if report is not None:
        report |= {"placed": placed, "pieces": pieces, "bound": bound, "sequences": sum(plan.values())}
    return [(dict(c), k) for c, k in plan.items()]


def ranges(plan: Plan) -> dict[int, np.ndarray]:
    """For each length rows of first rank, how many in a sequence, first sequence, offset: pieces of
    one length, by rank, fill the places for that length. As many rows as configurations have lengths."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: Counter[int] = Counter()
    sequence = 0
    for config, copies in plan:
        offset = 0
        for n, k in config.items():
            out.setdefault(n, []).append((rank[n], k, sequence, offset))
            rank[n] += k * copies
            offset += n * k
        sequence += copies
    return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones, but for a shorter first."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
) -> DataFrame:
    """Columns id_col, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece.

    A null or empty text is a document of the end id alone. Repeated rows are packed each. Documents
    over capacity are cut, the first piece taking the remainder. Extra columns are left out. An empty
    table gives an empty result. Only the histogram of lengths, of at most capacity rows, and the plan
    made from it, of configurations that grow with the lengths and not with the documents, reach the driver; pieces of one length
    take their places by rank, counted within a partition and offset by the partitions before.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    seen: dict = {}

    def encode(batch: pa.RecordBatch):
        context = TaskContext.get()
        task = (context.stageId(), context.partitionId(), context.attemptNumber(), context.taskAttemptId()) if context else 0
        if seen.get("task") != task:
            seen.clear()
            seen.update(task=task, ranks=Counter())
        ranks, part = seen["ranks"], context.partitionId() if context else 0
        words, end = tokens.words(path), int(end_id).to_bytes(4, "little")
        names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "rank")
        out = {k: [] for k in names}
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            ids = words.ids(text.as_py()) + end
            for k, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                for name, x in zip(names, (doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, ranks[length]), strict=True):
                    out[name].append(x)
                ranks[length] += 1
        yield out

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, part int, rank long"
    pieces = checkpointed(map_batches(base, encode, schema))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(ranges(plan_sequences(histogram, capacity)))

    def place(batch: pa.RecordBatch):
        length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy() + batch["before"].to_numpy()
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            rows = places.value[int(n)]
            row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
            nth = rank[at] - row[:, 0]
            sequence[at], offset[at] = row[:, 2] + nth // row[:, 1], row[:, 3] + nth % row[:, 1] * n
        yield {c: batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": sequence, "offset": offset}

    ranked = pieces.join(before.drop("n"), ["length", "part"])
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_batches(ranked, place, schema).withColumnRenamed("doc_id", id_col)


def op4_config_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).withColumn("doc_id", F.col("doc_id").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_config_packing": op4_config_packing}
ORACLES: dict[str, str] = {}
