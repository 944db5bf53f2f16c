"""SimHash near-duplicates by segment popcounts.

A fingerprint is mapped to the popcounts of its 16 four-bit segments.  The
Manhattan distance of two such vectors never exceeds the Hamming distance of
the fingerprints, so a pair within two bits lies within distance two on that
grid: both sides look up their own cell and the cells one step away, and such
a pair meets in at least one of them.  Pairs in a cell are verified exactly.

A cell can hold very many fingerprints (a family of near copies).  Cells over
``pair_cell`` members are therefore not expanded into pairs: their members
list the 65 fingerprints within one bit of themselves, and two of them are
within two bits exactly if these lists meet.  At most 65 distinct fingerprints
can meet in one entry, so that way is linear and misses nothing.

Defined results: a null text counts as empty; no words give fingerprint zero,
linked like any other; equal fingerprints form one class before any linking,
so copies are never paired.  A null doc_id stays in the result, links others
like any id, and never names a component that has another id.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..runtime import materialize, small_batches
from .common import folded_words, groups

SHINGLE = 3
SEED = 42
SEGMENTS = 16
PAIR_CELL = 24


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits as an unsigned int; bit i is set if over half the shingle hashes have it."""
    from xxhash import xxh64_digest

    found = folded_words(text)
    if not found:
        return 0
    grams = [b" ".join(found)] if len(found) < width else list(map(b" ".join, zip(*(found[i:] for i in range(width)))))
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(grams), 32768):
        part = b"".join([xxh64_digest(g, seed) for g in grams[at : at + 32768]])
        total += np.unpackbits(np.frombuffer(part, dtype=np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * total > len(grams)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``(doc_id, fp)``, one row per input row; fp is the signed view of the 64 bits."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in groups(batches, "text"):
            made = np.array([fingerprint(t, width, seed) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _cell(fp: Column) -> Column:
    """The popcounts of the 16 segments, four bits each.  Halves keep ANSI sums from overflowing."""

    def half(x: Column) -> Column:
        pairs = x.bitwiseAND(F.lit(0x55555555)) + F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(0x55555555))
        return pairs.bitwiseAND(F.lit(0x33333333)) + F.shiftrightunsigned(pairs, 2).bitwiseAND(F.lit(0x33333333))

    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    return F.shiftleft(half(high), 32).bitwiseOR(half(low))


def _grid(classes: DataFrame) -> DataFrame:
    """One row for each class and each cell within one step of its own."""
    own = F.col("own")
    steps = [own]
    for i in range(SEGMENTS):
        count = F.shiftrightunsigned(own, 4 * i).bitwiseAND(F.lit(15))
        steps += [F.when(count < 4, own + (1 << 4 * i)), F.when(count > 0, own - (1 << 4 * i))]
    return classes.withColumn("own", _cell(F.col("fp"))).select("fp", F.explode(F.array(*steps)).alias("cell")).where("cell is not null")


def _ball(fp: Column) -> Column:
    bits = [1 << i for i in range(63)] + [-(1 << 63)]
    return F.array(fp, *(fp.bitwiseXOR(F.lit(b).cast("long")) for b in bits))


def links(classes: DataFrame, distance: int = 2, pair_cell: int = PAIR_CELL) -> DataFrame:
    """``(src, dst)``: links between the fingerprints of classes(fp) that join all within ``distance`` (at most 2) bits.

    Every component of the full link graph is a component of these.
    """
    if distance > 2:
        raise ValueError("the grid looks one step around each cell: distances over 2 need a wider one")
    grid = _grid(classes)
    shared = materialize(grid.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "simhash-cells")
    near = materialize(grid.join(shared, "cell"), "simhash-near")
    few = near.where(F.col("n") <= pair_cell).select("cell", "fp")
    other = few.select("cell", F.col("fp").alias("fp2"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2")))
    pairs = few.join(other, (few["cell"] == other["cell"]) & (F.col("fp") < F.col("fp2")) & (apart <= distance)).select(F.col("fp").alias("src"), F.col("fp2").alias("dst"))
    crowded = near.where(F.col("n") > pair_cell).select("fp").distinct()
    met = crowded.select("fp", F.explode(_ball(F.col("fp"))).alias("at")).groupBy("at").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    first = F.array_min("all")
    star = met.select(first.alias("first"), F.explode("all").alias("one")).where(F.bit_count(F.col("first").bitwiseXOR(F.col("one"))) <= 2)
    if distance < 2:  # a shared list entry only says two bits; check every pair of the at most 65 members
        star = met.select(F.explode("all").alias("first"), "all").select("first", F.explode("all").alias("one")).where(F.bit_count(F.col("first").bitwiseXOR(F.col("one"))) <= distance)
    return pairs.unionByName(star.where("first <> one").select(F.col("first").alias("src"), F.col("one").alias("dst"))).distinct()


def near_duplicates(docs: DataFrame, width: int = SHINGLE, seed: int = SEED, distance: int = 2, pair_cell: int = PAIR_CELL) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of docs."""
    made = materialize(fingerprints(docs, width, seed), "simhash-docs")
    classes = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    parts = connected_components(links(classes.select("fp"), distance, pair_cell)).withColumnRenamed("id", "fp")
    placed = materialize(classes.join(parts, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component")), "simhash-parts")
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = materialize(placed.join(materialize(least, "simhash-least"), "component").select("fp", "component_id"), "simhash-labels")
    return made.join(label, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
