"""Connected components by contraction.

In each round a vertex names the vertex of its closed neighbourhood that comes
first in a random order; named vertices stand for all that named them, and only
edges between different ones stay.  That leaves at most three quarters of the
vertices in expectation, half of a long chain, so that all rounds together move
a few times the edges.  Then the names are followed back.  A round is one partial
aggregation and two equi-joins whose larger sides are plain scans, so that
adaptive execution can split a hub with very many edges; its tables are written
to the shared folder, and the driver sees one number a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, materialize

_LOW = (1 << 32) - 1


def _half(x: Column, seed: int) -> Column:
    return F.hash(x, F.lit(seed)).cast("long").bitwiseAND(F.lit(_LOW))


def _shuffled(x: Column, seed: int) -> Column:
    """A random number for an id, another for each id: two turns of a Feistel net, which ``_restored`` undoes."""
    high, low = F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(_LOW))
    b = high.bitwiseXOR(_half(low, seed))
    return F.shiftleft(b, 32).bitwiseOR(low.bitwiseXOR(_half(b, ~seed)))


def _restored(x: Column, seed: int) -> Column:
    b, d = F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(_LOW))
    low = d.bitwiseXOR(_half(b, ~seed))
    return F.shiftleft(b.bitwiseXOR(_half(low, seed)), 32).bitwiseOR(low)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """``(id, component)`` for every vertex that has an edge to another one.

    ``component`` is the least id that can be reached.  Self loops, repeated
    edges and null ends are ignored; vertices without edges aren't returned.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    now = materialize(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(a.alias("u"), b.alias("v")), "cc-edges")
    names, least = [], None  # least(id, lo): the least id that a vertex stands for, itself where it isn't listed
    for turn in range(max_rounds):
        if now.isEmpty():
            break
        pick = F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("w")), F.struct(F.col("v").alias("id"), F.col("u").alias("w"))))
        first = now.select(pick.alias("e")).groupBy("e.id").agg(F.min(_shuffled(F.col("e.w"), turn)).alias("h"), F.count("*").alias("n"))
        # Every other round a leaf names its neighbour in any case, so that a hub takes all its leaves at once.
        chosen = F.least("h", _shuffled(F.col("id"), turn)) if turn % 2 else F.when(F.col("n") == 1, F.col("h")).otherwise(F.least("h", _shuffled(F.col("id"), turn)))
        name = materialize(first.select("id", _restored(chosen, turn).alias("rep")), "cc-names")
        held = name.withColumn("lo", F.col("id")) if least is None else name.join(least, "id").select("id", "rep", "lo")
        last, least = least, materialize(held.groupBy(F.col("rep").alias("id")).agg(F.min("lo").alias("lo")), "cc-least")
        to = lambda end, other, name=name: name.select(F.col("id").alias(end), F.col("rep").alias(other))
        moved = now.join(to("u", "a"), "u").join(to("v", "b"), "v").where("a <> b")
        old, now = now, materialize(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "cc-edges")
        names.append((name, least))
        discard(old)
    else:
        raise RuntimeError(f"no end within {max_rounds} rounds")
    discard(now)
    if not names:
        return edges.select(a.alias("id"), b.alias("component")).limit(0)
    # A vertex that no later round renames stands for itself from there on.
    name, least = names.pop()
    found = materialize(name.join(least.select(F.col("id").alias("rep"), F.col("lo").alias("component")), "rep").select("id", "component"), "cc-found")
    discard(name)
    discard(least)
    while names:
        name, least = names.pop()
        known = least.join(found, "id", "left").select(F.col("id").alias("rep"), F.coalesce("component", "lo").alias("component"))
        last, found = found, materialize(name.join(known, "rep").select("id", "component"), "cc-found")
        for done in (last, name, least):
            discard(done)
    return found
