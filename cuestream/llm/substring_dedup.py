"""Substring deduplication by recompression of the texts' words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuestream.llm.common import begin_task, map_batches, ship, table, written
from cuestream.llm.wordcodes import BASE, byte_words, inside, mix, slices, windows

#: Words of a window.
WINDOW = 13
#: Rounds in which pairs are named; a symbol of the last stands for about 1.33 ** ROUNDS words.
ROUNDS = 3
#: Levels whose symbols may be the anchor of a window, the highest first; level 0, the words, always can.
LEVELS = (3, 0)
#: Words of a window that its anchor is named by: half of it, on the side where it has them.
HALF = (WINDOW + 1) // 2


def recompress(codes: np.ndarray, at: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level (name, first, last): its symbols and the span of words that settles each.

    Level 0 are the words. First each run of one word is named by the word and its length. In each
    round the hash of its name puts every symbol on the left or on the right, and neighbours left-right
    become one symbol, named by both. Names are hashes, the same everywhere. Whether a symbol arises is
    settled within its span: the words that it stands for and those that kept it from growing. So
    wherever a span's words stand in the corpus they give the same symbol. A symbol at the edge of
    its text has no such span; its own is given as reaching beyond.
    """
    n = len(codes)
    words = np.arange(n, dtype=np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    far = np.int64(1 << 40)
    levels = [(codes, words, words)]
    if not n:
        return levels * (rounds + 1)
    with np.errstate(over="ignore"):
        starts = np.r_[True, (codes[1:] != codes[:-1]) | (text[1:] != text[:-1])]
        first = np.flatnonzero(starts)
        length = np.diff(np.r_[first, n])
        text = text[first]
        names = np.where(length > 1, mix(codes[first] * BASE + length.astype(np.uint64)), codes[first])
        # A run is settled by the words beside it.
        low, high = first - 1, first + length
        low = np.where(first == at[text], -far, low)
        high = np.where(first + length == at[text + 1], far, high)
        for k in range(1, rounds + 1):
            left = (mix(names + np.uint64(k) * BASE) >> np.uint64(63)).astype(bool)
            same = np.r_[text[1:] == text[:-1], False]
            joined = left & same & np.r_[~left[1:], False]
            after = np.r_[False, joined[:-1]]
            # Left symbols stay alone for the sake of their right neighbour, right ones of their left.
            reach_high = np.where(left, np.where(same, np.r_[high[1:], far], far), high)
            reach_low = np.where(left, low, np.where(np.r_[False, same[:-1]], np.r_[-far, low[:-1]], -far))
            pair = np.flatnonzero(joined)
            new_names, new_low, new_high = names.copy(), reach_low, reach_high
            new_names[pair] = mix(names[pair] * BASE + (names[pair + 1] ^ np.uint64(k)))
            new_low[pair], new_high[pair] = low[pair], high[pair + 1]
            kept = ~after
            names, low, high, text = new_names[kept], new_low[kept], new_high[kept], text[kept]
            levels.append((names, low, high))
    return levels


def anchors(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, name) of every window within a text: the name of its anchor, the symbol of the least hash
    among those of the highest level that the window's words settle. Half of the window's words, from the
    anchor on or up to its end, are part of the name. Equal windows have equal anchors."""
    levels = recompress(codes, at)
    place = np.flatnonzero(inside(at, WINDOW))
    name, begin, end = np.zeros(len(place), np.uint64), np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    todo = np.arange(len(place))
    for level in LEVELS:
        names, low, high = levels[level]
        settled = (low >= 0) & (high - low < WINDOW)
        names, low, high = names[settled], low[settled], high[settled]
        # Both ends of the spans are in order, so those within a window are neighbours.
        first, stop = np.searchsorted(low, place[todo], "left"), np.searchsorted(high, place[todo] + WINDOW, "left")
        rank = mix(names ^ np.uint64(level + 1))
        best, at_best = np.full(len(todo), np.uint64(2**64 - 1)), np.full(len(todo), -1)
        for k in range(int((stop - first).max(initial=0))):
            i = np.minimum(first + k, len(rank) - 1)
            less = (first + k < stop) & (rank[i] < best)
            best[less], at_best[less] = rank[i[less]], i[less]
        found = at_best >= 0
        name[todo[found]] = rank[at_best[found]]
        begin[todo[found]], end[todo[found]] = low[at_best[found]], high[at_best[found]]
        todo = todo[~found]
    halves = windows(codes, HALF)
    from_it = begin + HALF <= place + WINDOW
    half = halves[np.where(from_it, begin, end - HALF + 1)] if len(place) else halves
    with np.errstate(over="ignore"):
        return place, mix(name ^ (half * np.where(from_it, np.uint64(1), np.uint64(3))))


def _texts(batch: pa.RecordBatch):
    ids, texts = batch["doc_id"], batch["text"]
    for a, b in slices(texts):
        yield ids.slice(a, b - a), [t.as_py() or b"" for t in texts[a:b]]


def prints_of(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each text's words."""
    return np.array([xxhash.xxh3_64_intdigest(codes[a:b].tobytes()) for a, b in zip(at, at[1:], strict=False)], np.uint64).view(np.int64)


#: Marks windows that a batch has settled by itself.
SETTLED = -1


def _spread(n: int, ids: np.ndarray) -> np.ndarray:
    """Keys that deal settled rows out evenly."""
    with np.errstate(over="ignore"):
        return mix(ids.view(np.uint64) * BASE + np.arange(n, dtype=np.uint64)).view(np.int64)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by keys (the last is the first) and, in it, where groups of equal keys but the first begin."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys[1:]:
        new[1:] |= key[order][1:] != key[order][:-1]
    return order, np.flatnonzero(new)


def _spans(base: DataFrame) -> DataFrame:
    """name, of, span: windows from a first place on that have the anchor, as place * 16 + number.

    `of` is a hash of the document's words and stands for it here: copies share it, so a name that only copies have is not shared.
    Before the shuffle, a slice's spans of a name that two of its texts have are settled: they go on
    under keys of their own with a negative span, and two rows without windows stand for the
    name. So what many documents share is not dealt to one task."""

    def find(batch: pa.RecordBatch):
        for _, texts in _texts(batch):
            codes, at = byte_words.flat(texts)
            prints = prints_of(codes, at)
            place, name = anchors(codes, at)
            begins = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (place[1:] != place[:-1] + 1)]) if len(place) else np.zeros(0, np.int64)
            # No more than 13 windows share an anchor, but for names that repeat: those go on in parts.
            ends = np.r_[begins[1:], len(place)]
            for k in np.flatnonzero(ends - begins > WINDOW):
                begins = np.r_[begins, np.arange(begins[k] + WINDOW, ends[k], WINDOW)]
            begins.sort()
            owner = np.searchsorted(at, place[begins], "right") - 1
            span, name = (place[begins] - at[owner]) * 16 + np.diff(np.r_[begins, len(place)]), name[begins].view(np.int64)
            of = prints[owner]
            order, starts = _groups(of, name)
            low, high = of[order][starts], of[order][np.r_[starts[1:], len(order)] - 1] if len(order) else of
            local = low < high
            settled = np.zeros(len(order), bool)
            settled[order] = np.repeat(local, np.diff(np.r_[starts, len(order)]))
            marks = name[order][starts][local]
            yield {
                "name": np.r_[np.where(settled, _spread(len(of), of), name), marks, marks], "of": np.r_[of, low[local], high[local]], "span": np.r_[np.where(settled, -span, span), np.zeros(2 * len(marks), np.int64)],
            }

    return map_batches(base, find, "name long, of long, span long")


def _runs_of(order: np.ndarray, starts: np.ndarray, places: np.ndarray) -> list[bytes]:
    """The places of each group, as bytes."""
    ends, of = np.r_[starts[1:], len(order)], places.astype("<i4")[order]
    return [of[i:j].tobytes() for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]


def _windows(candidates: DataFrame) -> DataFrame:
    """doc_id, of, place, more, w1, w2: the words' hash of every window whose anchor is shared, once for a document: place is
    where it begins first, more has all its places where there are several.

    A batch settles windows that a document of its own with a smaller id has: they go on in one row for each document,
    with place SETTLED and under a key of its own. So what many documents, or many lines of one, share is not dealt to one task."""

    def find(batch: pa.RecordBatch):
        spans, of, row, found = batch["spans"], batch["of"].to_numpy(), 0, []
        for ids, texts in _texts(batch):
            ids = ids.to_numpy()
            codes, at = byte_words.flat(texts)
            one, two, own = windows(codes, WINDOW), windows(codes, WINDOW, 1), prints_of(codes, at)
            part, meant = spans.slice(row, len(texts)), of[row : row + len(texts)]
            row += len(texts)
            n, (first, count) = part.value_lengths().to_numpy(), np.divmod(part.flatten().to_numpy(), 16)
            place = np.repeat(first + np.repeat(at[:-1], n), count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            owner = np.repeat(np.repeat(np.arange(len(texts)), n), count)
            # Rows with one id meet each other's spans; only a text's own are its windows.
            good = (own == meant)[owner]
            place, owner = place[good], owner[good]
            found.append((ids[owner], own[owner], place - at[owner], one[place].view(np.int64), two[place].view(np.int64)))
        doc, own, place, w1, w2 = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
        order, starts = _groups(doc, w1, w2)
        least = np.zeros(len(order), np.int64)
        least[order] = np.repeat(doc[order][starts], np.diff(np.r_[starts, len(order)]))
        settled = np.flatnonzero(least < doc)
        if len(settled):
            by, at_doc = _groups(place[settled], own[settled], doc[settled])
            first = settled[by[at_doc]]
            yield {
                "doc_id": doc[first], "of": own[first], "place": np.full(len(first), SETTLED), "more": _runs_of(by, at_doc, place[settled]), "w1": np.zeros(len(first), np.int64), "w2": _spread(len(first), doc[first]),
            }
        kept = np.flatnonzero(least == doc)
        by, at_window = _groups(place[kept], own[kept], doc[kept], w1[kept], w2[kept])
        first, several = kept[by[at_window]], np.diff(np.r_[at_window, len(by)]) > 1
        more = [m if s else None for m, s in zip(_runs_of(by, at_window, place[kept]), several.tolist(), strict=True)] if several.any() else pa.nulls(len(first), pa.binary())
        yield {"doc_id": doc[first], "of": own[first], "place": place[first], "more": more, "w1": w1[first], "w2": w2[first]}

    return map_batches(candidates, find, "doc_id long, of long, place int, more binary, w1 long, w2 long")


def places_of(found: dict) -> np.ndarray:
    """All places of a document's windows."""
    alone = np.array([p for p, m in zip(found["places"], found["more"], strict=True) if m is None], np.int64)
    return np.concatenate([alone, *(np.frombuffer(m, "<i4") for m in found["more"] if m is not None)])


def kept_words(text: bytes, places: np.ndarray) -> list[bytes]:
    """Words that no window covers that begins at one of the places."""
    words = text.split()
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, places, 1)
    np.add.at(cover, places + WINDOW, -1)
    return [w for w, c in zip(words, np.cumsum(cover[:-1]).tolist(), strict=True) if not c]


def _copies(base: DataFrame) -> DataFrame:
    """doc_id, n_words, sha256 and of (hashes of the words), copy (whether a smaller id has the words)."""

    def digest(batch: pa.RecordBatch):
        for ids, texts in _texts(batch):
            words = [t.split() for t in texts]
            yield {"doc_id": ids, "n_words": [len(w) for w in words], "sha256": [hashlib.sha256(b" ".join(w)).hexdigest() for w in words], "of": prints_of(*byte_words.flat(texts))}

    digests = written(map_batches(base, digest, "doc_id long, n_words long, sha256 string, of long"))
    # Only texts that several rows have, as a table of its own: the join is then by broadcast, or its skewed keys can be split.
    first = written(digests.groupBy("sha256").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).alias("copy")
    return written(digests.join(first, "sha256", "left").select("doc_id", "n_words", "sha256", "of", copy))


def _candidates(base: DataFrame, digests: DataFrame) -> DataFrame:
    """doc_id, of, spans: where the anchors of its windows are shared; without documents that are copies."""
    of_name = W.partitionBy("name")
    shared = (F.min("of").over(of_name) < F.max("of").over(of_name)).alias("shared")
    spans = _spans(base).select("of", "span", shared).where("span < 0 or (shared and span > 0)")
    lists = spans.groupBy("of").agg(F.array_distinct(F.collect_list(F.abs("span"))).alias("spans"))
    return written(digests.where("not copy").select("doc_id", "of").distinct().join(lists, "of"))


def repeats(base: DataFrame, digests: DataFrame) -> DataFrame:
    """doc_id, of, places, more: where windows begin that also begin in a document with a smaller id; texts that have
    some and are no copies, all of whose windows are repeats."""
    lists = _candidates(base, digests)
    least = F.min("doc_id").over(W.partitionBy("w1", "w2"))
    later = _windows(base.join(lists, "doc_id")).withColumn("least", least).where(f"place = {SETTLED} or least < doc_id")
    found = F.struct("place", "more")
    listed = later.groupBy("doc_id", "of").agg(F.collect_list(found).alias("w"))
    return written(listed.select("doc_id", "of", F.transform("w", lambda x: x["place"]).alias("places"), F.transform("w", lambda x: x["more"]).alias("more")))


def _by_id(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("of", "places", "more")).alias("found"))


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Null ids become the least of all, null texts empty."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def _cut(batch: pa.RecordBatch, text_col: str = "text"):
    """Of each text of a batch, as bytes, the words that stay; None if it is not among its id's found texts."""
    for text, found in zip(batch[text_col], batch["found"].to_pylist(), strict=True):
        text = text.as_py()
        text = text.encode() if isinstance(text, str) else text or b""
        own = int(prints_of(*byte_words.flat([text]))[0]) if found else None
        mine = next((f for f in found or () if f["of"] == own), None)
        yield text, None if mine is None else [] if mine["places"] is None else kept_words(text, places_of(mine))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, n_words, n_removed, kept_sha256: one row for each row of docs.

    Words are what stands between ASCII white space. A word goes if a window of 13 words over it also
    begins in a document with a smaller id; repeats within a document stay. Null and empty texts have no
    words, and texts of fewer than 13 lose none. Rows with one id are no repeats of each other; null
    ids count as one, the least of all. Extra columns are left out. An empty table gives an empty result.

    Every window has an anchor, a high-level symbol of the recompressed text that its words alone
    settle. Windows with an anchor that only one document has are unique; the others are verified by a 128-bit
    hash of their words, and the least id that has each is found. Copies are told by a digest before
    that, so a group of copies of any size is one document to it.
    """
    base = _base(docs, id_col, text_col)
    digests = _copies(base)
    repeated = repeats(base, digests)

    def trim(batch: pa.RecordBatch):
        out = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": []}
        for doc_id, (text, words) in zip(batch["doc_id"].to_pylist(), _cut(batch), strict=True):
            if words is not None:
                n = len(text.split())
                for name, x in zip(out, (doc_id, n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()), strict=True):
                    out[name].append(x)
        yield out

    cut = map_batches(base.join(_by_id(repeated), "doc_id"), trim, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    gone = F.col("copy") & (F.col("n_words") >= WINDOW)
    whole = digests.join(repeated.select("doc_id", "of"), ["doc_id", "of"], "left_anti").select(
        "doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(0).cast("long").alias("n_removed"), F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("sha256")).alias("kept_sha256")
    )
    return cut.union(whole).select(F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")).alias(id_col), "n_words", "n_removed", "kept_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the texts that lose words cut to the kept ones, joined by one space; other texts and all
    other columns stay as they are. A document that loses all of its words keeps its row, with an empty text."""
    base = _base(docs, id_col, text_col)
    digests = _copies(base)
    repeated = repeats(base, digests)
    copies = digests.where(F.col("copy") & (F.col("n_words") >= WINDOW)).select("doc_id", "of", F.lit(None).cast("array<int>").alias("places"), F.lit(None).cast("array<binary>").alias("more")).distinct()
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    changed = _by_id(repeated.union(copies)).withColumnRenamed("doc_id", "__id")
    joined = docs.withColumn("__id", key).join(changed, "__id", "left").drop("__id")
    order = docs.columns
    at = order.index(text_col)

    def trim(batches):
        begin_task()
        for batch in batches:
            texts = [old.as_py() if words is None else b" ".join(words).decode() for (_, words), old in zip(_cut(batch, text_col), batch[text_col], strict=True)]
            columns = [batch[c] for c in order]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=order)

    ship(docs.sparkSession)
    return joined.mapInArrow(trim, docs.schema)


def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_recompression": op9_recompression}
ORACLES: dict[str, str] = {}
