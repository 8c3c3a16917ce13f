"""Token counts by overlap resynchronisation."""

from __future__ import annotations

import bisect
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuestream.llm import tokens
from cuestream.llm.common import checkpointed, map_batches, table

#: Texts of more characters are encoded in chunks, by many tasks.
CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 512
#: What a chunk says of its last characters may change with text that it doesn't hold: a
#: lookahead of one character, or a special string that its end cuts off.
MARGIN_CHARS = 64
MAX_TOKENS = 1024


def cut(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of overlapping chunks over n characters."""
    spans, start = [], 0
    while True:
        end = min(n, start + chunk)
        spans.append((start, end))
        if end == n:
            return spans
        start = end - overlap


def boundaries(tok, text: str, start: int, zones: list[tuple[int, int]]) -> tuple[int, list[int], list[int]]:
    """The chunk's token count, and within zones each place (in the document) where a pre-token
    begins, with the count of the chunk's tokens before it."""
    enc = tok.encode(text, add_special_tokens=False)
    offsets, words = enc.offsets, enc.word_ids
    at, before = [], []
    for low, high in zones:
        i = bisect.bisect_left(offsets, (low - start, 0))
        while i < len(offsets) and offsets[i][0] < high - start:
            if not i or words[i] is None or words[i] != words[i - 1]:
                if not i or offsets[i][0] >= offsets[i - 1][1]:
                    at.append(offsets[i][0] + start)
                    before.append(i)
            i += 1
    return len(offsets), at, before


def splice(chunks: list[tuple[int, int, int, list[int], list[int]]]) -> int | None:
    """The count of the whole text from (start, end, count, at, before) of its chunks in order;
    None if two neighbours share no boundary.

    A place that both hold as the beginning of a pre-token is proven: up to MARGIN_CHARS before its
    end the left chunk cuts as the whole text does, and cutting goes from left to right without
    memory, so from that place on the right chunk does too."""
    total, left_from = 0, 0
    for (_, end, _, at, before), (_, _, _, at2, before2) in zip(chunks, chunks[1:], strict=False):
        right = dict(zip(at2, before2, strict=True))
        shared = [(p, b) for p, b in zip(at, before, strict=True) if p in right and p <= end - MARGIN_CHARS and b >= left_from]
        if not shared:
            return None
        p, b = shared[0]
        total += b - left_from
        left_from = right[p]
    return total + chunks[-1][2] - left_from


def _long_counts(long_texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """key, n_tokens (null where the overlap was too short) of distinct long texts."""

    def explode(batch: pa.RecordBatch):
        for key, text in zip(batch["key"].to_pylist(), batch["text"], strict=True):
            text = text.as_py()
            spans = cut(len(text), chunk, overlap)
            for k in range(0, len(spans), 16):
                part = spans[k : k + 16]
                yield {"key": [key] * len(part), "n_chunks": [len(spans)] * len(part), "start": [a for a, _ in part], "stop": [b for _, b in part], "chunk_text": [text[a:b] for a, b in part]}

    def encode(batch: pa.RecordBatch):
        tok = tokens.library(path)
        out = {k: [] for k in ("key", "n_chunks", "start", "stop", "n", "at", "before")}
        for key, n_chunks, a, b, text in zip(*(batch[c].to_pylist() for c in ("key", "n_chunks", "start", "stop", "chunk_text")), strict=True):
            n, at, before = boundaries(tok, text, a, [(a + (a > 0), a + overlap), (max(a + overlap, b - overlap), b)])
            for name, x in zip(out, (key, n_chunks, a, b, n, at, before), strict=True):
                out[name].append(x)
        yield out

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["start"], pdf["stop"], pdf["n"], map(list, pdf["at"]), map(list, pdf["before"]), strict=True))
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "n_tokens": pd.array([splice(rows)], dtype="Int64")})

    chunks = map_batches(long_texts, explode, "key string, n_chunks long, start long, stop long, chunk_text string")
    chunks = chunks.repartition("key", "start")
    ends = map_batches(chunks, encode, "key string, n_chunks long, start long, stop long, n long, at array<long>, before array<long>")
    return ends.groupBy("key").applyInPandas(join, "key string, n_tokens long")


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS,
    chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """Columns id_col, n_bytes, n_tokens, over_limit: one row for each row of docs.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each; equal long texts
    are encoded once. Extra columns are left out, so their names can't clash. An empty table gives an
    empty result. Long texts are cut into overlapping chunks that separate tasks encode with offsets;
    neighbours are spliced at a boundary that both prove. Texts for which none lies in an overlap are
    cut again with overlaps four times as wide, at last as one chunk.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def short(batch: pa.RecordBatch):
        words = tokens.words(path)
        texts = batch["text"].to_pylist()
        yield {"doc_id": batch["doc_id"], "n_bytes": [len(x.encode()) for x in texts], "n_tokens": [words.count(x) for x in texts]}

    id_type = base.schema["doc_id"].dataType.simpleString()
    counted = map_batches(base.where(F.length("text") <= chunk_chars), short, f"doc_id {id_type}, n_bytes long, n_tokens long")
    long_rows = base.where(F.length("text") > chunk_chars).withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    texts = long_rows.select("key", "text").dropDuplicates(["key"])
    found = checkpointed(_long_counts(texts, path, chunk_chars, overlap_chars))
    done, chunk, overlap = found.where("n_tokens is not null"), chunk_chars, overlap_chars
    while (failed := found.where("n_tokens is null").select("key")).take(1):
        chunk, overlap = 4 * chunk, 4 * overlap
        found = checkpointed(_long_counts(texts.join(failed, "key", "left_semi"), path, chunk, overlap))
        done = done.union(found.where("n_tokens is not null"))
    whole = long_rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "key").join(done, "key").select("doc_id", "n_bytes", "n_tokens")
    return counted.union(whole).select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).withColumn("doc_id", F.col("doc_id").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_token_counts": op1_token_counts}
ORACLES: dict[str, str] = {}
