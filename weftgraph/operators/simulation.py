"""Graph simulation: the greatest relation between a pattern's nodes and vertices.

(u, v) is in it if the labels agree and every child of u has a match among the
children of v.  Refinement removes pairs until none has to go.  It counts once
how many children of v match each child node; a round then only looks at the
edges into the pairs that the last round removed, takes them off the counts,
and removes what has none left.  Patterns are lists that the caller writes
down, so they are sent to all executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..runtime import materialize


@dataclass(frozen=True)
class Pattern:
    nodes: tuple[tuple[int, str], ...]
    edges: tuple[tuple[int, int], ...]


def simulation(g: Graph, pattern: Pattern, limit: int = 100_000) -> DataFrame:
    """``(u, v)``."""
    spark = g.vertices.sparkSession
    q = F.broadcast(spark.createDataFrame(list(pattern.nodes), "u long, label string"))
    f = F.broadcast(spark.createDataFrame(list(pattern.edges), "u long, u2 long"))
    inner = F.broadcast(spark.createDataFrame([(u,) for u in sorted({a for a, _ in pattern.edges})], "u long"))
    found = g.vertices.join(q, "label").select("u", F.col("id").alias("v"))
    # A node with children needs a vertex with children.
    start = found.join(inner, "u", "left_anti").unionByName(found.join(inner, "u", "left_semi").join(g.edges.select(F.col("src").alias("v")).distinct(), "v", "left_semi").select("u", "v"))
    state = materialize(start, "simulation")
    labels = g.vertices.join(q, "label", "left_semi").select("id")
    # Only edges between candidates can witness anything.
    edges = materialize(g.edges.join(labels.select(F.col("id").alias("src")), "src", "left_semi").join(labels.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct(), "simulation-edges")
    hits = edges.join(state, edges["dst"] == state["v"]).groupBy(F.col("u").alias("u2"), F.col("src").alias("v")).agg(F.count("*").alias("n"))
    hits = materialize(hits.join(F.broadcast(spark.createDataFrame([(c,) for c in sorted({b for _, b in pattern.edges})], "u2 long")), "u2", "left_semi"), "simulation-hits")
    wanted = state.join(f, "u")
    removed = materialize(wanted.join(hits, ["u2", "v"], "left_anti").select("u", "v").distinct(), "simulation-gone")
    gone, lost = removed, None
    for turn in range(limit):
        if removed.isEmpty():
            return materialize(state.join(gone, ["u", "v"], "left_anti"), "simulation")
        less = materialize(edges.join(removed, edges["dst"] == removed["v"]).groupBy(F.col("u").alias("u2"), F.col("src").alias("v")).agg(F.count("*").alias("less")), "simulation-less")
        # What was lost before matters only where something is lost now.
        lost = less if lost is None else lost.unionByName(less)
        keys = less.select("u2", "v")
        total = lost.join(keys, ["u2", "v"], "left_semi").groupBy("u2", "v").agg(F.sum("less").alias("less"))
        empty = total.join(hits, ["u2", "v"]).where("less >= n").select("u2", "v")
        removed = materialize(wanted.join(empty, ["u2", "v"], "left_semi").select("u", "v").distinct().join(gone, ["u", "v"], "left_anti"), "simulation-gone")
        gone = gone.unionByName(removed)
        if turn % 16 == 15:  # few and large files again
            gone, lost = materialize(gone, "simulation-gone"), materialize(lost.groupBy("u2", "v").agg(F.sum("less").alias("less")), "simulation-less")
    raise RuntimeError(f"no fixpoint within {limit} rounds")


def assembled(sim: DataFrame) -> DataFrame:
    """``(u, matches)``: a sorted set for every node that has any."""
    return sim.groupBy("u").agg(F.sort_array(F.collect_set("v")).alias("matches"))
