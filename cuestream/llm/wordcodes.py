"""Words as 64-bit codes in flat arrays, and hashes of their windows."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from cuestream.llm.common import TwoGenerations

#: Bytes of one generation of a worker's memo.
MEMO_BYTES = 24 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
_MARKS = re.compile(r"[\W_]+")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of a public generator)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def plain(word: str) -> int:
    """Code of a word without case and marks; 0 if nothing is left."""
    word = _MARKS.sub("", word.lower())
    return xxhash.xxh3_64_intdigest(word) | 1 if word else 0


class Coder:
    """Codes of the words of texts; one for each worker process and kind of word."""

    def __init__(self, split: Callable, code: Callable):
        self.split, self.memo = split, TwoGenerations(code, MEMO_BYTES)

    def flat(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words, and where each text's begin (one more for the end)."""
        counts, parts = [0], []
        for text in texts:
            words = self.split(text)
            parts.append(np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words)))
            counts.append(len(words))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.cumsum(counts)


plain_words = Coder(str.split, plain)
#: Words between ASCII white space, as bytes, unchanged.
byte_words = Coder(bytes.split, xxhash.xxh3_64_intdigest)


def drop_empty(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kept = codes != 0
    return codes[kept], np.concatenate([[0], np.cumsum(kept)])[at]


def windows(codes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash for each place at which n words begin (also across texts: see inside)."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        codes = mix(codes + np.uint64(seed) * BASE) if seed else codes
        out = codes[: len(codes) - n + 1].copy()
        for k in range(1, n):
            out = out * BASE + codes[k : len(codes) - n + 1 + k]
            out ^= out >> np.uint64(29)
        return mix(out)


def inside(at: np.ndarray, n: int) -> np.ndarray:
    """For each place of windows(), whether its n words lie within one text."""
    total = int(at[-1])
    if total < n:
        return np.zeros(0, bool)
    left = np.repeat(at[1:], np.diff(at))[: total - n + 1] - np.arange(total - n + 1)
    return left >= n


#: Words between white space without regard to case.
lower_words = Coder(str.split, lambda w: xxhash.xxh3_64_intdigest(w.lower()))


def slices(texts, size: int = 2 << 20):
    """Spans of texts (strings or an Arrow array) of about so many bytes in all, so that their arrays stay small."""
    if isinstance(texts, pa.Array):
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    else:
        lengths = list(map(len, texts))
    start, total = 0, 0
    for i, length in enumerate(lengths):
        if i > start and total + length > size:
            yield start, i
            start, total = i, 0
        total += length
    if start < len(lengths):
        yield start, len(lengths)
