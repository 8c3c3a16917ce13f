"""Token ids of whole texts, word by word, with a bounded memo of words.

A byte-level BPE of the usual pattern never joins a pre-token across a space that has text on its
right: text from such a space on is encoded as if it stood alone. So a text falls apart at its
spaces, and each distinct piece is encoded once while it stays in the memo. Pieces of Latin script
are encoded from the same vocabulary stored as ranks, the others and all texts with a special
string by the tokenizers library; tests hold the ids against that library on whole texts.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

from cuestream.llm.common import TwoGenerations, forgotten_between_stages

#: A space that isn't followed by text: the quick split at every space is then not safe.
LOOSE = re.compile(r" (?:\s|\Z)")
#: A space with text on both sides is a safe cut in any text.
SAFE = re.compile(r"(?<=\S) (?=\S)")
LATIN = re.compile(r"[\x00-ɏ]*\Z")
#: Bytes of one generation of a worker's memo.
MEMO_BYTES = 52 << 20
#: Characters worked on at a time; longer texts are cut at safe spaces.
SEGMENT = 1 << 20

_open: dict[str, "Words"] = {}
forgotten_between_stages(_open.clear)


def library(path: str):
    """The tokenizers object of a .json file, single-threaded within a task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> dict[str, int]:
    """The letters that a byte-level vocabulary writes bytes as: printable ones as they are, the others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


def words(path: str) -> "Words":
    """One memo per worker process and tokenizer file."""
    if path not in _open:
        _open[path] = Words(path)
    return _open[path]


class Words:
    def __init__(self, path: str):
        self.tok = library(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.ranks = self._ranks(path, self.tok)
        self.ids_of = TwoGenerations(lambda w: self._ids(" " + w), MEMO_BYTES)
        self.count_of = TwoGenerations(lambda w: len(self._ids(" " + w)) // 4, MEMO_BYTES)

    @staticmethod
    def _ranks(path: str, tok):
        """The encoder of the .tiktoken file of the same name, if there is one and it has the same vocabulary."""
        other = path.removesuffix(".json") + ".tiktoken"
        if not os.path.exists(other):
            return None
        import base64

        import public_tokenizers
        import tiktoken

        with open(other, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special, byte_of = {t.content for t in tok.get_added_tokens_decoder().values()}, byte_letters()
        vocabulary = {token: i for token, i in tok.get_vocab().items() if token not in special}
        if len(vocabulary) != len(ranks) or any(ranks.get(bytes(map(byte_of.get, token))) != i for token, i in vocabulary.items()):
            return None
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _ids(self, piece: str) -> bytes:
        if self.ranks and LATIN.match(piece):
            return array("I", self.ranks(piece)).tobytes()
        return array("I", self.tok.encode(piece, add_special_tokens=False).ids).tobytes()

    def _pieces(self, text: str) -> list[str]:
        return text.split(" ") if not LOOSE.search(text) else SAFE.split(text)

    def whole(self, text: str) -> bool:
        """True if the text has a special string, so that only the library may cut it."""
        return any(s in text for s in self.special)

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.whole(text):
            return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        parts = []
        for i, segment in enumerate(segments(text)):
            pieces = self._pieces(segment)
            # A later segment begins after the space at which it was cut.
            parts.append(self._ids(pieces[0]) if not i else self.ids_of[pieces[0]])
            parts.extend(map(self.ids_of.__getitem__, pieces[1:]))
        return b"".join(parts)

    def count(self, text: str) -> int:
        if self.whole(text):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        total = 0
        for i, segment in enumerate(segments(text)):
            pieces = self._pieces(segment)
            total += len(self._ids(pieces[0])) // 4 if not i else self.count_of[pieces[0]]
            total += sum(map(self.count_of.__getitem__, pieces[1:]))
        return total


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Cut a long text at safe spaces, each dropped from the text; a short one comes whole."""
    start = 0
    while len(text) - start > size:
        m = SAFE.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.end()
    yield text[start:] if start else text
