"""SentencePiece models on the tokenizers library.

The model file's protocol buffer is read here, field by field, and its parts
rebuilt: the normaliser (its character map, squeezing of blanks, the leading
metaspace), unigram scores or, for a byte-pair model, the merges that follow
from its scores, byte fallback, and the decoder.

If no piece has a metaspace after another character, no merge can cross from a
word into the next blank, so a text without normalisation falls into chunks of
a run of blanks and the word behind it, each encoded alike wherever it stands.
A batch's texts are split and coded by Arrow; only its distinct new chunks go
to the library's threads, many to a string, and a worker remembers the chunks
of its last batches.  The sentencepiece library encodes the same strings, and
the ids of every chunk of every text must agree for its ``parity``.  All other
models encode whole texts by both libraries.  ``round_trip`` says whether
decoding gives the text back.

Defined results: a null or empty text has no ids, and parity; texts that hold
the metaspace itself can't come back and say so; repeated rows give repeated
results; an empty table gives no rows; columns of the input that clash with
the new ones are replaced.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import small_batches
from .common import groups, process_cache

SPACE = "▁"
#: Chunks that a worker remembers before it starts anew, and the longest of them.
REMEMBERED, LONGEST = 400_000, 64
#: Chunks that are encoded as one string.
TOGETHER = 128
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


# ---- the protocol buffer -----------------------------------------------------


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and raw values of a message's fields."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind}")
            value, at = data[at : at + size], at + size
            if len(value) != size:
                raise ValueError("a field is cut off")
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True

    @staticmethod
    def parse(data: bytes) -> Model:
        m = Model()
        for number, value in fields(data):
            if number == 1:
                f = dict(fields(value))
                score = struct.unpack("<f", f[2])[0] if 2 in f else 0.0
                m.pieces.append((f.get(1, b"").decode(), score, f.get(3, NORMAL)))
            elif number == 2:
                f = dict(fields(value))
                m.kind, m.byte_fallback, m.suffix = f.get(3, UNIGRAM), bool(f.get(35, 0)), bool(f.get(24, 0))
            elif number == 3:
                f = dict(fields(value))
                m.charsmap, m.dummy_prefix, m.squeeze = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1))
        return m


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Pairs that make a piece, the best score first."""
    known = {p: s for p, s, kind in pieces if kind in (NORMAL, USER)}
    found = [(-s, k, p[:k], p[k:]) for p, s in known.items() for k in range(1, len(p)) if p[:k] in known and p[k:] in known]
    return [(a, b) for _, _, a, b in sorted(found)]


class Codec:
    """A tokenizers-library encoder for one model, with the sentencepiece library beside it."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

        self.model = m = Model.parse(data)
        if m.suffix or m.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models with the metaspace in front")
        unknown = next(i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN)
        if m.kind == UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=unknown, byte_fallback=m.byte_fallback)
        else:
            core = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, merges(m.pieces), unk_token=m.pieces[unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback)
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
        if m.dummy_prefix:
            steps.append(normalizers.Prepend(SPACE))
        self.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
        self.chunked = Tokenizer(core)
        self.chunked.add_tokens([AddedToken(p, normalized=False) for p, _, kind in m.pieces if kind == USER])
        self.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.chunked.decoder = self.decoder
        self.original = sentencepiece.SentencePieceProcessor(model_proto=data)
        plain = not (m.charsmap or m.squeeze) and m.dummy_prefix and not any(kind == USER for _, _, kind in m.pieces)
        self.splits = plain and all(SPACE not in p.lstrip(SPACE) for p, _, kind in m.pieces if kind in (NORMAL, USER))
        self.opens = np.array([p.startswith(SPACE) for p, _, _ in m.pieces])
        self.blank = np.array([not p.strip(SPACE) for p, _, _ in m.pieces])
        self.forget()

    def forget(self) -> None:
        """Known chunks have a place in the arrays; their ids stand in ``pool``."""
        self.place: dict[str, int] = {}
        self.pool, self.start, self.size, self.good = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros((0, 2), dtype=bool)

    def whole(self, texts: list[str]) -> Iterator[tuple[bytes, bool, bool]]:
        """ids as little-endian unsigned 32-bit numbers, parity, round trip."""
        found = [e.ids for e in self.chunked.encode_batch_fast([self.normalizer.normalize_str(t) if t else "" for t in texts], add_special_tokens=False)]
        theirs = self.original.encode(texts, num_threads=max(1, os.cpu_count() or 1))
        for text, x, y, back in zip(texts, found, theirs, self.chunked.decode_batch(found, skip_special_tokens=False)):
            yield struct.pack(f"<{len(x)}I", *x), x == y, (back[1:] if self.model.dummy_prefix and back[:1] == " " else back) == text

    def learn(self, new: list[str]) -> np.ndarray:
        """The places of new chunks, whose first blank isn't written; those that end in a word are joined to longer strings."""
        joined = [i for i, c in enumerate(new) if c and c[-1] != " "]
        alone = [i for i, c in enumerate(new) if not c or c[-1] == " "]
        parts = [joined[i : i + TOGETHER] for i in range(0, len(joined), TOGETHER)]
        pools, sizes, good, order = [], [], [], []
        for part, (ids, parity, back) in zip(parts, self.whole([" ".join([new[i] for i in p]) for p in parts])):
            flat = np.frombuffer(ids, dtype="<u4")
            begins = self.opens[flat]
            begins[1:] &= ~self.blank[flat[:-1]]
            at = np.flatnonzero(begins)
            if not (parity and back) or len(at) != len(part) or at[0]:
                alone += part
                continue
            pools.append(flat)
            sizes.append(np.diff(at, append=len(flat)))
            good.append(np.ones((len(part), 2), dtype=bool))
            order += part
        for ids, parity, back in self.whole([new[i] for i in alone]) if alone else ():
            pools.append(np.frombuffer(ids, dtype="<u4"))
            sizes.append(np.array([len(ids) // 4]))
            good.append(np.array([[parity, back]]))
        size = np.concatenate(sizes)
        out = np.empty(len(new), dtype=np.int64)
        out[order + alone] = np.arange(len(new)) + len(self.size)
        self.start = np.concatenate([self.start, size.cumsum() - size + len(self.pool)])
        self.pool, self.size, self.good = np.concatenate([self.pool, *pools]), np.concatenate([self.size, size]), np.concatenate([self.good, *good])
        self.place.update((c, k) for c, k in zip(new, out.tolist()) if len(c) <= LONGEST)
        return out

    def chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct chunks, the place of each chunk in them, and the number of chunks up to each text's end."""
        parts = pc.split_pattern(texts, " ")
        words, ends = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)[1:]
        full = np.flatnonzero(pc.binary_length(words).to_numpy() > 0)
        begins = np.concatenate([[0], ends[:-1]])
        last = np.searchsorted(full, ends)  # full words up to each text's end
        empty = last == np.concatenate([[0], last[:-1]])
        owner = np.searchsorted(ends, full, side="right")
        before = full - np.maximum(np.concatenate([[-1], full[:-1]]), begins[owner] - 1) - 1
        after = np.zeros(len(full), dtype=np.int64)
        after[last[~empty] - 1] = (ends - 1)[~empty] - full[last[~empty] - 1]
        found = words.take(pa.array(full))
        odd = (before > 0) | (after > 0)
        if odd.any():
            blanks = lambda n: pc.binary_repeat(pa.array([" "] * int(odd.sum()), pa.large_string()), pa.array(n[odd]))
            found = pc.replace_with_mask(found, pa.array(odd), pc.binary_join_element_wise(blanks(before), found.filter(pa.array(odd)), blanks(after), pa.scalar("", pa.large_string())))
        # Texts of blanks alone are one chunk, put behind all others of the batch and moved to their place.
        only = np.flatnonzero(empty & (ends - begins > 1))
        coded = pa.concat_arrays([found, pa.array([" " * int(n) for n in (ends - begins - 1)[only]], pa.large_string())]).dictionary_encode()
        codes = coded.indices.to_numpy()
        count = np.bincount(owner, minlength=len(ends)) + np.bincount(only, minlength=len(ends))
        order = np.argsort(np.concatenate([owner, only]), kind="stable") if len(only) else slice(None)
        return coded.dictionary, codes[order], count.cumsum()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids, where each text's end, parity and round trip."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.splits:
            rows = list(self.whole(texts.to_pylist())) if len(texts) else []
            flat, sizes = np.frombuffer(b"".join(r[0] for r in rows), dtype="<u4"), np.array([len(r[0]) // 4 for r in rows], dtype=np.int64)
            return flat, sizes.cumsum(), np.array([r[1] for r in rows], dtype=bool), np.array([r[2] for r in rows], dtype=bool)
        if len(self.size) > REMEMBERED or len(self.pool) > 20 * REMEMBERED:
            self.forget()
        names, codes, ends = self.chunks(pc.replace_substring(texts, SPACE, " "))
        names = names.to_pylist()
        places = np.fromiter(map(self.place.get, names, repeat(-1)), dtype=np.int64, count=len(names))
        if len(new := np.flatnonzero(places < 0)):
            places[new] = self.learn([names[i] for i in new.tolist()])
        places = places[codes]
        own = self.size[places]
        upto = own.cumsum()
        flat = self.pool[np.repeat(self.start[places] - (upto - own), own) + np.arange(upto[-1] if len(upto) else 0)]
        tally = lambda x: np.concatenate([[0], x])[ends]
        parity, back = (np.diff(tally((~self.good[places, i]).cumsum()), prepend=0) == 0 for i in (0, 1))
        return flat, tally(upto), parity, back & ~pc.match_substring(texts, SPACE).to_numpy(zero_copy_only=False)

    def decode(self, ids: list[int]) -> str:
        text = self.chunked.decode(ids, skip_special_tokens=False)
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


def codec(data: bytes) -> Codec:
    return process_cache(f"pieces:{zlib.crc32(data)}:{len(data)}", lambda: Codec(data))


# ---- on tables ---------------------------------------------------------------

KINDS = {"ids": pa.list_(pa.int32()), "n_ids": pa.int64(), "ids_crc32": pa.int64(), "parity": pa.bool_(), "round_trip": pa.bool_()}
RESULT = "ids array<int>, n_ids long, ids_crc32 long, parity boolean, round_trip boolean"


def encode(docs: DataFrame, model: bytes, want: tuple[str, ...] = ("ids", "n_ids", "ids_crc32", "parity", "round_trip")) -> DataFrame:
    """docs with the wanted columns of ``RESULT``."""
    small_batches(docs.sparkSession)
    left = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in want])
    text_name = next(c for c in left.columns if c.lower() == "text")
    at = left.columns.index(text_name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(model)
        for batch, _ in groups(batches, text_name, 4_000_000):
            flat, ends, parity, back = made.encode(batch.column(at))
            new = {"parity": pa.array(parity), "round_trip": pa.array(back)}
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            if "ids" in want:
                new["ids"] = pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)).astype(np.int32)), pa.array(flat.astype(np.int32)))
            if "ids_crc32" in want:
                new["ids_crc32"] = pa.array([zlib.crc32(flat[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64())
            new["n_ids"] = pa.array(ends - starts, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(new[k] for k in want)], names=[*batch.schema.names, *want])

    fields_ = {f.name: f for f in T._parse_datatype_string(RESULT).fields}
    return left.mapInArrow(run, T.StructType([*left.schema.fields, *(fields_[k] for k in want)]))


def decode(rows: DataFrame, model: bytes, ids: str = "ids", to: str = "text") -> DataFrame:
    """rows with the text of their ids; null ids give null."""
    small_batches(rows.sparkSession)
    left = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c.lower() != to.lower()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(model)
        for batch in batches:
            found = [None if x is None else made.decode(x) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, to])

    return left.mapInArrow(run, T.StructType([*left.schema.fields, T.StructField(to, T.StringType())]))
