"""Sequence packing as a cutting-stock problem.

A document's tokens are cut into full sequences and one rest.  The rests are
counted by length class (``WIDTH`` tokens wide, rounded up); only that
histogram, at most ``capacity / WIDTH`` counts whatever the corpus, reaches
the driver.  There a linear program over filling patterns is solved by column
generation: an unbounded knapsack, by dynamic programming, prices the next
pattern; it ends when the tokens' own bound or the pricing bound says that no plan
is better by more than ``GAP``.  The counts of the patterns are rounded down and the few rests left
over are packed largest first, again on the histogram.

Documents are ranked inside their class in salted buckets, so that a length
that a third of all documents share isn't sorted in one task, and the rank
says the pattern, the sequence and the slot.

Defined results: a null or empty text is the end token alone; repeated rows
are packed as often as they occur; no rows give no pieces; extra columns are
ignored.  Sequence ids run from 0 without gaps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import materialize, small_batches
from .common import groups
from .wordbpe import word_bpe

CAPACITY = 2048
WIDTH = 8
GAP = 0.003
END = b"\x01\0\0\0"
SALT = 256


# ---- the plan, on counts by length class ------------------------------------


def price(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: the best worth within room and how often each size is in it."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fits = np.searchsorted(sizes, c, side="right")
        best[c] = best[c - 1]
        if fits:
            worth = values[:fits] + best[c - sizes[:fits]]
            k = int(worth.argmax())
            if worth[k] > best[c] + 1e-12:
                best[c], took[c] = worth[k], k
    counts, c = np.zeros(len(sizes)), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= int(sizes[took[c]])
    return float(best[room]), counts


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan by whole rows: small, and free of the linear-algebra library's threads."""
    m = len(matrix)
    both = np.hstack([matrix, np.eye(m)])
    for k in range(m):
        p = k + int(np.abs(both[k:, k]).argmax())
        both[[k, p]] = both[[p, k]]
        both[k] /= both[k, k]
        factors = both[:, k].copy()
        factors[k] = 0
        both -= np.multiply.outer(factors, both[k])
    return both[:, m:]


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a column) and how often each is used, at least meeting the demand.

    The demand is raised by less than a thousandth of a piece, differently for
    every size: no two ratios tie then, so that no basis comes back.
    """
    m = len(sizes)
    demand = demand + np.sqrt(np.arange(2, m + 2)) / (1000 * np.sqrt(m + 2))
    basis = np.diag((room // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    used = (inverse * demand).sum(axis=1)
    least = float((demand * sizes).sum()) / room  # no plan has fewer sequences than the tokens fill
    for step in count():
        if used.sum() <= (1 + gap) * least:
            break
        duals = inverse.sum(axis=0)
        worth, pattern = price(duals, sizes, room)
        if worth <= 1 + 1e-9 or used.sum() * (1 - 1 / worth) <= gap * used.sum():
            break
        turn = (inverse * pattern).sum(axis=1)
        rises = turn > 1e-9
        if not rises.any():
            break
        ratios = np.where(rises, used / np.where(rises, turn, 1), np.inf)
        out = int(ratios.argmin())
        basis[:, out] = pattern
        if step % 200 == 199:
            inverse = _inverse(basis)
        else:
            row = inverse[out] / turn[out]
            inverse -= np.multiply.outer(turn, row)
            inverse[out] = row
        used = np.maximum((inverse * demand).sum(axis=1), 0)
    return basis, used


@dataclass(frozen=True)
class Plan:
    """ranges: (class, from rank, to rank, first sequence, pieces of the class in one sequence)."""

    ranges: list[tuple[int, int, int, int, int]]
    sequences: int


def plan(counts: dict[int, int], room: int, gap: float = GAP) -> Plan:
    """counts: pieces by class, 1 to room."""
    sizes = np.array(sorted(k for k, n in counts.items() if n), dtype=int)
    if not len(sizes):
        return Plan([], 0)
    left = np.array([counts[int(k)] for k in sizes], dtype=np.int64)
    done, todo = np.zeros_like(left), []
    columns, used = column_generation(sizes, left.astype(float), room, gap)
    for k in np.argsort(-used):
        pattern = np.rint(columns[:, k]).astype(np.int64)
        within = np.where(pattern > 0, left // np.maximum(pattern, 1), np.iinfo(np.int64).max).min()
        if times := int(min(np.floor(used[k] + 1e-9), within)):
            todo.append((pattern, times))
            left = left - times * pattern
    while left.any():
        pattern, free = np.zeros_like(left), room
        for k in range(len(sizes) - 1, -1, -1):
            if left[k] and sizes[k] <= free:
                pattern[k] = min(left[k], free // sizes[k])
                free -= int(pattern[k] * sizes[k])
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        todo.append((pattern, times))
        left = left - times * pattern
    ranges, first = [], 0
    for pattern, times in todo:
        for k in np.flatnonzero(pattern):
            n = int(pattern[k]) * times
            ranges.append((int(sizes[k]), int(done[k]), int(done[k]) + n, first, int(pattern[k])))
            done[k] += n
        first += times
    return Plan(ranges, first)


# ---- pieces and their places ------------------------------------------------


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens)`` of every document's full cuts and rest."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch, texts in groups(batches, "text"):
            ids, rows = batch.column(0).to_pylist(), []
            for doc, text in zip(ids, texts):
                found = bpe.encode(text) + END
                n = len(found) // 4
                for start in range(0, n, capacity):
                    part = found[4 * start : 4 * (start + capacity)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), n))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def place(cut: DataFrame, capacity: int = CAPACITY, width: int = WIDTH, gap: float = GAP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces; cut must be a table, it is read twice."""
    spark = cut.sparkSession
    kind = F.when(F.col("length") == capacity, 0).otherwise(F.ceil(F.col("length") / width)).cast("int")
    cut = cut.withColumn("kind", kind).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.spark_partition_id()), F.lit(SALT)).cast("int"))
    cut = materialize(cut, "packing-classes")
    buckets = cut.groupBy("kind", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("kind").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(buckets.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "packing-offsets")
    counts = {r["kind"]: r["n"] for r in offsets.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    full = counts.pop(0, 0)
    found = plan(counts, capacity // width, gap)
    ranges = [*found.ranges, (0, 0, full, found.sequences, 1)]
    slots = spark.createDataFrame(ranges, "kind int, low long, high long, first long, per long")
    inside = Window.partitionBy("kind", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("place", F.row_number().over(inside) - 1)
    # At most capacity / width classes times SALT rows, and as many ranges as patterns have parts: both sides are bounded.
    ranked = ranked.join(F.broadcast(offsets.select("kind", "salt", "before")), ["kind", "salt"]).withColumn("rank", F.col("before") + F.col("place"))
    ranked = ranked.join(F.broadcast(slots), "kind").where("rank >= low and rank < high")
    ranked = ranked.withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("per")))
    so_far = Window.partitionBy("sequence_id").orderBy(F.desc("kind"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("offset", F.coalesce(F.sum("length").over(so_far), F.lit(0)))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, width: int = WIDTH, gap: float = GAP) -> DataFrame:
    return place(materialize(pieces(docs, tokenizer, capacity), "packing-cut"), capacity, width, gap)
