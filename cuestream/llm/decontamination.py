"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuestream.llm.common import begin_task, map_batches, ship, table
from cuestream.llm.wordcodes import BASE, drop_empty, inside, plain_words, slices, windows

#: Words of the shortest match that counts, and the share of an item that matches must cover.
LEAST_MATCH = 5
COVERAGE = 0.5
#: Tests go to the executors in blocks of about so many bytes.
BLOCK_BYTES = 8 << 20
_TABLE_BITS = 22


@dataclass
class Seeds:
    """The places of each seed of n words in the items that have such seeds."""

    n: int
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    maybe: np.ndarray


@dataclass
class Tests:
    """A bounded block of benchmark items: codes of their words, and their seeds by length."""

    ids: list
    codes: list[np.ndarray]
    seeds: list[Seeds]

    @staticmethod
    def of(ids: list, texts: list[str | None], least: int = LEAST_MATCH) -> "Tests":
        codes, at = drop_empty(*plain_words.flat([t or "" for t in texts]))
        # An item of fewer words than a seed is a seed as a whole.
        length, found = np.minimum(np.diff(at), least), []
        for n in np.unique(length[length > 0]).tolist():
            seeds, valid = windows(codes, n), inside(at, n)
            owner = np.searchsorted(at, np.arange(len(seeds)), "right") - 1
            place = np.flatnonzero(valid & (length[owner] == n))
            order = np.argsort(seeds[place], kind="stable")
            maybe = np.zeros(1 << _TABLE_BITS, bool)
            maybe[(seeds[place] >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
            found.append(Seeds(n, seeds[place][order], owner[place][order], (place - at[owner[place]])[order], maybe))
        return Tests(list(ids), [codes[a:b] for a, b in zip(at, at[1:], strict=False)], found)


def _rolling(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin prefix hashes and powers of the base, modulo 2**64."""
    with np.errstate(over="ignore"):
        powers = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(len(codes), BASE))])
        prefix = np.zeros(len(codes) + 1, np.uint64)
        # sum of code[i] * base**-i, scaled back in _hashes, would need an inverse; an odd base has one.
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        shrinking = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(len(codes), inverse))])[: len(codes)]
        prefix[1:] = np.add.accumulate(codes * shrinking)
    return prefix, powers


def _hashes(prefix: np.ndarray, powers: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (prefix[n:] - prefix[:-n]) * powers[: len(prefix) - n]


def tile(doc: np.ndarray, item: np.ndarray, least: int = LEAST_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in doc, place in item, words) of non-overlapping matches, the
    longest first; of equally long ones the first in doc, then in item."""
    tiles: list[tuple[int, int, int]] = []
    doc_hash, item_hash = _rolling(doc), _rolling(item)
    doc_marked, item_marked = np.zeros(len(doc) + 1, np.int64), np.zeros(len(item) + 1, np.int64)

    def free(hashes, marked, n):
        if len(marked) - 1 < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        taken = np.concatenate([[0], np.cumsum(marked[:-1])])
        at = np.flatnonzero(taken[n:] == taken[:-n])
        return at, _hashes(*hashes, n)[at]

    def shared(n):
        (i, x), (j, y) = free(doc_hash, doc_marked, n), free(item_hash, item_marked, n)
        seen = np.isin(x, y)
        return i[seen], x[seen], j, y

    longest = min(len(doc), len(item))
    while longest >= least:
        low, high = least - 1, longest  # a shared run of n words holds one of n - 1
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if len(shared(n)[0]) else (low, n - 1)
        longest = low
        if longest < least:
            break
        at, x, places, y = shared(longest)
        found = len(tiles)
        for i, h in zip(at.tolist(), x, strict=True):
            if doc_marked[i : i + longest].any():
                continue
            for j in places[y == h].tolist():
                if not item_marked[j : j + longest].any() and np.array_equal(doc[i : i + longest], item[j : j + longest]):
                    tiles.append((i, j, longest))
                    doc_marked[i : i + longest] = item_marked[j : j + longest] = 1
                    break
        if len(tiles) == found:  # equal hashes of different words
            longest -= 1
    return tiles


def _near_seeds(codes: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """The words of a text that its seeds at places cover, with a word of no item between runs of them."""
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, places, 1)
    np.add.at(cover, places + n, -1)
    kept = np.cumsum(cover[:-1]) > 0
    # The first word after a run stays as a bar; codes of words are never 0.
    bar = np.r_[False, kept[:-1]] & ~kept
    return np.where(kept, codes, np.uint64(0))[kept | bar]


def matches(texts: list[str], tests: Tests, coverage: float = COVERAGE) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, covered words, tiles) where tiles cover the share of the item that is asked for."""
    codes, at = drop_empty(*plain_words.flat(texts))
    for s in tests.seeds:
        seeds = windows(codes, s.n)
        hit = np.flatnonzero(s.maybe[(seeds >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] & inside(at, s.n))
        hit = hit[s.seeds[np.minimum(np.searchsorted(s.seeds, seeds[hit]), len(s.seeds) - 1)] == seeds[hit]]
        if not len(hit):
            continue
        of = np.searchsorted(at, hit, "right") - 1
        # A text's distinct seeds, and their places in items; tiles can't cover more of an item than its seeds do.
        each = np.unique(np.stack([of.astype(np.uint64), seeds[hit]], axis=1), axis=0)
        low = np.searchsorted(s.seeds, each[:, 1], "left")
        n = np.searchsorted(s.seeds, each[:, 1], "right") - low
        owner = np.repeat(each[:, 0].astype(np.int64), n)
        ref = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        order = np.lexsort((s.place[ref], s.item[ref], owner))
        owner, ref = owner[order], ref[order]
        item = s.item[ref]
        ends = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (item[1:] != item[:-1]), True])
        for a, b in zip(ends, ends[1:], strict=False):
            text, which = int(owner[a]), int(item[a])
            words = tests.codes[which]
            most = np.zeros(len(words) + 1, np.int64)
            np.add.at(most, s.place[ref[a:b]], 1)
            np.add.at(most, s.place[ref[a:b]] + s.n, -1)
            if (np.cumsum(most) > 0).sum() < coverage * len(words):
                continue
            own = slice(*np.searchsorted(of, [text, text + 1]))
            places = hit[own][np.isin(seeds[hit[own]], s.seeds[ref[a:b]])] - at[text]
            tiles = tile(_near_seeds(codes[at[text] : at[text + 1]], places, s.n), words, s.n)
            covered = sum(t[2] for t in tiles)
            if covered >= coverage * len(words):
                yield text, which, covered, len(tiles)


def found_in(texts: pa.Array, tests: Tests, coverage: float) -> Iterator[tuple[int, int, int, int]]:
    """matches of a column, a slice of its texts at a time."""
    for a, b in slices(texts):
        for text, *rest in matches([t.as_py() or "" for t in texts[a:b]], tests, coverage):
            yield a + text, *rest


def _blocks(benchmark: DataFrame, least: int) -> Iterator[Tests]:
    """The benchmark in blocks of bounded size, so that one of any size is never in memory as a whole."""
    items = benchmark.select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow()
        yield Tests.of(part["item_id"].to_pylist(), part["text"].to_pylist(), least)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, least: int = LEAST_MATCH, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Columns id_col, item_id, n_words (of the item), covered, coverage, tiles: documents that hold an item.

    Words are compared without case and marks. Tiles are runs of at least `least` shared words that
    overlap neither in the document nor in the item, the longest first, wherever they stand: a reordered
    passage is found too. An item of fewer words than that is looked for as a whole. Null and empty texts, and items without
    words, hold nothing. Repeated documents and items give a row each. Extra columns are left out. Empty tables give
    an empty result.
    """
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, n_words int, covered int, coverage double, tiles int"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for tests in _blocks(benchmark, least):
        shared = docs.sparkSession.sparkContext.broadcast(tests)

        def find(batch: pa.RecordBatch, shared=shared):
            tests, ids = shared.value, batch["doc_id"].to_pylist()
            found = list(found_in(batch["text"], tests, coverage))
            words = [len(tests.codes[i]) for _, i, _, _ in found]
            covered = [c for _, _, c, _ in found]
            yield {"doc_id": [ids[d] for d, _, _, _ in found], "item_id": [tests.ids[i] for _, i, _, _ in found], "n_words": words, "covered": covered, "coverage": [c / n for c, n in zip(covered, words, strict=True)], "tiles": [t for _, _, _, t in found]}

        part = map_batches(rows, find, schema)
        out = part if out is None else out.union(part)
    return out.withColumnRenamed("doc_id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_MATCH, coverage: float = COVERAGE, text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item, with all their columns; nothing is shuffled."""
    ship(docs.sparkSession)
    for tests in _blocks(benchmark, least):
        shared = docs.sparkSession.sparkContext.broadcast(tests)

        def keep(batches, shared=shared):
            begin_task()
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col))
                mask = np.ones(len(texts), bool)
                mask[[d for d, _, _, _ in found_in(texts, shared.value, coverage)]] = False
                yield batch.filter(pa.array(mask))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op8_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_string_tiling": op8_string_tiling}
ORACLES: dict[str, str] = {}
