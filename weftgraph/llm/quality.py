"""Quality rules with a distribution-divergence verdict.

Base rules count words, signs, repeated lines and repeated three-word windows.
The verdict compares two histograms of a document with its language's own:
the classes of its characters, and its common words (each of the language's
``COMMON`` most frequent words, and all others together).  Both distances are
Jensen-Shannon distances in bits, between 0 and 1.  A document is judged only
if it has ``MIN_WORDS`` words.  A language of fewer than ``REFERENCE_WORDS``
words has no histograms of its own; its documents are compared with those of
all documents together.  References are a table joined by language.

A short sample lies far from its own source by chance.  The limit of the word
distance is therefore the mean distance of samples of that length drawn from
the reference itself (fixed seed) plus ``EXCESS``.

The references come from all rows: words are counted inside each task first,
and the counts by language and word are summed with one shuffle.

Defined results: a null or empty text has no words and fails the base rules;
a null language is judged as the language "und"; repeated rows give repeated
results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..runtime import materialize, small_batches
from .common import BLANKS, groups, words

MIN_WORDS = 50
COMMON = 100
#: A language with fewer words is judged by all documents together.
REFERENCE_WORDS = 10_000
#: The character distance may be a + b / sqrt(n words).
MAX_CHARACTERS = (0.17, 1.2)
EXCESS = 0.17
#: Sample lengths at which the references are sampled, and how often.
LENGTHS, SAMPLES = (25, 50, 71, 100, 141, 200, 283, 400, 800, 1600, 6400, 25600, 102400), 30
#: Distinct words that a task holds before it passes its counts on.
HELD = 400_000

CLASSES = ("vowel", "consonant", "upper", "digit", "blank", "line", "stop", "quote", "sign", "control", "latin", "letter")


def _class_table() -> np.ndarray:
    """Class by first byte of a character; continuation bytes count nowhere."""
    table = np.full(256, 255, dtype=np.uint8)
    at = {name: i for i, name in enumerate(CLASSES)}
    for b in range(128):
        c = chr(b)
        name = "vowel" if c in "aeiou" else "consonant" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "line" if c == "\n" else "blank" if c in BLANKS else "control" if b < 32 or b == 127 else "stop" if c in ".,;:!?" else "quote" if c in "'\"()-" else "sign"
        table[b] = at[name]
    table[0xC2:0xCA] = at["latin"]
    table[0xCA:] = at["letter"]
    return table


_TABLE = _class_table()


def characters(text: str | None) -> np.ndarray:
    """Characters of each class."""
    if not text:
        return np.zeros(len(CLASSES), dtype=np.int64)
    found = np.bincount(_TABLE[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)], minlength=256)
    return found[: len(CLASSES)]


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    total = 0.0
    for x in (p, q):
        k = x > 0
        total += float((x[k] * np.log2(x[k] / m[k])).sum()) / 2
    return max(total, 0.0) ** 0.5


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    found = words(text)
    n_blank = sum(map(text.count, BLANKS))
    signs = sum(map(text.count, "#*$%&|<>"))
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n") if "\n" in text else ():
        if line.strip(BLANKS):
            repeated += line in seen
            seen.add(line)
    windows = list(zip(found, found[1:], found[2:]))
    again = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        end = 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                again += i + 3 - max(i, end)
                end = i + 3
    return len(found), len(text) - n_blank, signs, repeated, again


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts: (lang, kind, word, n); kind 0 words, 1 character classes, 2 all words."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names=["lang", "kind", "word", "n"])

    held: dict[str, Counter] = {}
    rest: Counter = Counter()
    for batch, texts in groups(batches, "text"):
        for lang, text in zip(batch.column(0).to_pylist(), texts):
            if found := words(text):
                held.setdefault(lang, Counter()).update(found)
                rest[lang, 2, b""] += len(found)
                for i, n in enumerate(characters(text)):
                    rest[lang, 1, b"%d" % i] += int(n)
        if sum(map(len, held.values())) > HELD:
            yield out([(lang, 0, w, n) for lang, counts in held.items() for w, n in counts.items()])
            held = {}
    yield out([(lang, 0, w, n) for lang, counts in held.items() for w, n in counts.items()] + [(*k, n) for k, n in rest.items()])


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


Reference = tuple[np.ndarray, dict[bytes, int], np.ndarray, np.ndarray]


def expected(counts: np.ndarray) -> np.ndarray:
    """Mean distance of samples of each of ``LENGTHS`` words to their source."""
    rng, shares = np.random.default_rng(8), counts / counts.sum()
    return np.array([np.mean([divergence(rng.multinomial(n, shares), counts) for _ in range(SAMPLES)]) for n in LENGTHS])


def _references(rows: pa.Table) -> pa.Table:
    """The pickled ``Reference`` of the rows (lang, kind, word, n, r) of one language."""
    classes, frequent, total = np.zeros(len(CLASSES), dtype=np.int64), [], 0
    for r in rows.to_pylist():
        if r["kind"] == 0:
            frequent.append((r["r"], r["word"], r["n"]))
        elif r["kind"] == 1:
            classes[int(r["word"])] = r["n"]
        else:
            total = r["n"]
    frequent.sort()
    found = [n for _, _, n in frequent]
    made = classes, {bytes(word): i for i, (_, word, _) in enumerate(frequent)}, (all_words := np.array([*found, total - sum(found)])), expected(all_words)
    return pa.table({"lang": rows.column("lang").slice(0, 1), "reference": pa.array([pickle.dumps(made)], pa.binary())})


def references(docs: DataFrame, common: int = COMMON, least: int = REFERENCE_WORDS) -> DataFrame:
    """``(lang, reference)`` of each language with at least so many words, and of all documents together (lang null).

    A reference holds the counts of character classes, places of the common words, their counts and the others', and the distances by chance.
    """
    small_batches(docs.sparkSession)
    counts = _plain(docs).mapInArrow(_counted, "lang string, kind int, word binary, n long").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "quality-words")
    pooled = counts.groupBy("kind", "word").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "kind", "word", "n")
    top = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "word")
    kept = counts.where((F.col("kind") == 2) & (F.col("n") >= least)).select("lang")
    own = counts.join(kept, "lang", "left_semi").unionByName(pooled)
    ranked = own.withColumn("r", F.row_number().over(top)).where(F.col("r") <= max(common, len(CLASSES))).where((F.col("kind") != 0) | (F.col("r") <= common))
    ranked = materialize(ranked, "quality-counts")
    return materialize(ranked.groupBy("lang").applyInArrow(_references, "lang string, reference binary"), "quality-references")


def judge(text: str | None, reference: tuple | None, limits: tuple = (*MAX_CHARACTERS, EXCESS), min_words: int = MIN_WORDS) -> tuple:
    n, chars, signs, lines, again = base_counts(text)
    failed = n < min_words or 100 * again > 50 * n
    if reference is None or n < min_words:
        return n, chars, signs, lines, again, failed, None, None, not failed
    classes, place, counts, chance = reference
    own = np.zeros(len(counts), dtype=np.int64)
    for w in words(text):
        own[place.get(w, -1)] += 1
    by_class, by_word = divergence(characters(text), classes), divergence(own, counts)
    most = limits[0] + limits[1] / n**0.5, float(np.interp(np.log(n), np.log(LENGTHS), chance)) + limits[2]
    return n, chars, signs, lines, again, failed, by_class, by_word, not failed and by_class <= most[0] and by_word <= most[1]


OUTPUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, js_characters double, js_words double, kept boolean"


def rules(docs: DataFrame, limits: tuple = (*MAX_CHARACTERS, EXCESS), min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the columns of ``OUTPUT``; columns of docs that have such a name are replaced."""
    found = references(docs)
    pooled = [pickle.loads(bytes(r["reference"])) for r in found.where("lang is null").collect()]  # one row
    mine = [c.split()[0] for c in OUTPUT.split(",")]
    left = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in mine])
    at = [c.lower() for c in left.columns]
    schema = pa.schema([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("js_characters", pa.float64()), ("js_words", pa.float64()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, Reference] = {}
        for batch, texts in groups(batches, text_name):
            rows = []
            for blob, t in zip(batch.column(batch.num_columns - 1).to_pylist(), texts):
                if blob is not None and blob not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[blob] = pickle.loads(blob)
                rows.append(judge(t, known[blob] if blob is not None else pooled[0], limits, min_words))
            new = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], *schema.names])

    text_name = left.columns[at.index("text")]
    own = F.coalesce(F.col(f"`{left.columns[at.index('lang')]}`").cast("string"), F.lit("und"))
    named = found.where("lang is not null").select(F.col("lang").alias("_reference_lang"), F.col("reference").alias("_reference"))
    judged = left.join(named, own == F.col("_reference_lang"), "left").drop("_reference_lang")
    return judged.mapInArrow(run, T.StructType([*left.schema.fields, *T._parse_datatype_string(OUTPUT).fields]))
