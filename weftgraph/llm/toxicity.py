"""Toxic spans by a linear-chain conditional random field.

Learning.  Labels are of documents.  A bounded sample of labelled rows
(``PER_LABEL`` rows of each label, least hashes first, their texts whole) gives labelled tokens: a word, or a word's first
letters, is a mark if it occurs in toxic rows among so many different pairs of
neighbours that chance is ruled out (Chernoff bound, corrected for the number
of words tried).  Neighbours rather than rows are counted, so that copies of
one text bring no marks.  Tokens of toxic rows with a mark are labelled 1, all
others 0, and the field is fitted to windows of ``WINDOW`` tokens (windows that
together hold every mark, and one at random from each text; of all these a
random ``WINDOWS`` at most) by forward-backward gradients (AdaGrad on hashed
features of a token's word, its first and last letters and its shape, and the
transitions).

Scoring.  Marginals come from the exact forward-backward recursion over the
whole text, as scans of 2 x 2 matrices over all tokens of a batch.  Expected
toxic tokens, the probability that there is any, and their share are turned
into the document's score by a logistic regression on the same sample,
weighted to the labels' own rate.  All learning runs in a process of its own
beside the driver (``field.py``), which gives its memory back.

Defined results: a null or empty text scores like any text without tokens; no
labels give score 0 everywhere; a row with several labels counts as toxic if
one says so; null labels are ignored; repeated rows score alike; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import small_batches
from . import field as learning
from .common import bucket, groups
from .field import _TOKEN, Field, _scored, bare, document_traits, fit_apart, marginals  # noqa: F401

PER_LABEL = 2000
THRESHOLD = 0.3


def spans(text: str, p: np.ndarray, least: float = 0.5) -> list[tuple[int, int]]:
    """Code point offsets of the offending tokens; neighbours are joined."""
    out: list[tuple[int, int]] = []
    last = -2
    for i, m in enumerate(_TOKEN.finditer(text)) if (p >= least).any() else ():
        if p[i] >= least:
            if last == i - 1:
                out[-1] = out[-1][0], m.end()
            else:
                out.append((m.start(), m.end()))
            last = i
    return out


def fit(texts: list[str], labels: list[int], rate: float, steps: int = 400, seed: int = 1) -> Field | None:
    """In this process; ``train`` learns in another one."""
    return learning.fit(texts, labels, rate, steps, seed, document_traits)


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Field | None:
    """The field of all rows in labels; the driver gets at most 2 * per_label texts."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    count = one.agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).first()
    picked = None
    for y in (0, 1):
        some = one.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    # 2 * per_label rows of two numbers at most: small enough to send to every executor.
    rows = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic").collect()
    rows = sorted({(r["doc_id"], r["text"], r["toxic"]) for r in rows})
    return fit_apart([r[1] for r in rows], [r[2] for r in rows], (count["k"] or 0) / max(count["n"], 1)) if rows else None


RESULT = "score double, toxic_tokens double, toxic_spans array<struct<start:long,end:long>>"


def score(docs: DataFrame, field: Field | None) -> DataFrame:
    """docs with the columns of ``RESULT``; columns of docs that have such a name are replaced."""
    from pyspark.sql import types as T

    small_batches(docs.sparkSession)
    mine = ("score", "toxic_tokens", "toxic_spans")
    left = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in mine])
    text_name = next(c for c in left.columns if c.lower() == "text")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch, texts in groups(batches, text_name, 1_000_000):
            scores, sums, places = [], [], []
            for text, (p, _) in zip(texts, _scored(field, texts, known) if field else ((np.zeros(0), []) for _ in texts)):
                z = (field.scale * np.array([1, *document_traits(p)])).sum() if field else -np.inf
                scores.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))) if field else 0.0)
                sums.append(float(p.sum()))
                places.append([{"start": a, "end": b} for a, b in spans(text, p)] if text else [])
            new = [pa.array(scores, pa.float64()), pa.array(sums, pa.float64()), pa.array(places, span)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *mine])

    return left.mapInArrow(run, T.StructType([*left.schema.fields, *T._parse_datatype_string(RESULT).fields]))


def trainable(labels: DataFrame) -> DataFrame:
    """Rows that may teach: crc32 of the id modulo 4 isn't 2."""
    return labels.where(bucket("doc_id", 4) != 2)
