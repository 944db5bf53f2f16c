"""Token ids of a word-level byte BPE file of the tokenizers library.

The file's pre-tokenizer never joins across white space, so a text's ids are
those of its blank-separated chunks in a row.  Chunks repeat; each worker
keeps the ids of those it has met.  A new chunk of plain Latin letters, digits
and ASCII signs is split and merged by a rank table built from the same file
(a word's end is one more byte, and its merge comes before all others);
anything else goes to the library itself, so that results are always its own.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np

from .common import process_cache

#: Chunks that a worker remembers at most, and the longest that it remembers.
REMEMBERED, LONGEST = 300_000, 48
_ODD_BLANKS = re.compile("[\x1c-\x1f]")
_PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-įı-ž]+")
_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+"


def _byte_alphabet() -> dict[str, int]:
    """The library's printable stand-ins for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain}
    return names | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class WordBpe(dict):
    """chunk -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.marks = tuple(special)
        alphabet = _byte_alphabet()
        ranks = {}
        for token, i in vocabulary.items():
            if token in special:
                continue
            ends = len(token) > 4 and token.endswith("</w>")
            ranks[bytes(alphabet[c] for c in (token[:-4] if ends else token)) + b"\xff" * ends] = i
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.pieces = re.compile(_PIECE).findall

    def _ids(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk) and not any(m in chunk for m in self.marks):
            ids = [i for p in self.pieces(chunk.lower()) for i in self.merge(p.encode() + b"\xff")]
        else:
            ids = self.library.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: str) -> bytes:
        ids = self._ids(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _ODD_BLANKS.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.__getitem__, text.split()))


def word_bpe(path: str) -> WordBpe:
    return process_cache(f"word_bpe:{path}", lambda: WordBpe(path))
