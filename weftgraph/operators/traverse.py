"""Queries that run until nothing changes: breadth first, shortest paths, cycles.

Each round joins only the last round's new rows with the edges; the state is
written to the shared folder between rounds, so lineage never grows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import Graph
from ..runtime import discard, materialize
from .components import connected_components


def rounds(frontier: DataFrame, seen: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], limit: int | None) -> DataFrame:
    """Union of all that step reaches; a key is kept from the first round that has it."""
    frontier = materialize(frontier, "frontier")
    seen, n = materialize(seen, "seen"), 0
    while (limit is None or n < limit) and not frontier.isEmpty():
        frontier = materialize(step(frontier).join(seen, keys, "left_anti"), "frontier")
        seen = seen.unionByName(frontier)  # only the new rows are written
        n += 1
        if n % 16 == 0:
            old, frontier, seen = seen, materialize(frontier, "frontier"), materialize(seen, "seen")
            discard(old)
    return seen


def bfs(edges: DataFrame, sources: DataFrame, bound: int | None = None) -> DataFrame:
    """``(source, id, dist)``; give both directions of edges for an undirected search."""
    start = sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("dist"))

    def step(front: DataFrame) -> DataFrame:
        return front.join(edges, front["id"] == edges["src"]).select("source", F.col("dst").alias("id"), (F.col("dist") + 1).alias("dist")).distinct()

    return rounds(start, start, step, ["source", "id"], bound)


def _bounded(g: Graph, sources: DataFrame, all_of_them: bool, most: int = 64) -> DataFrame:
    """``(id, low, high)``: bounds of the eccentricity of the sources in the undirected view, equal if all_of_them, else equal wherever a diameter may be.

    A search from s bounds every vertex v that it reaches: from below by their distance and by how much further s has to
    go than that, from above by the sum.  Searches start where the bounds are furthest apart, at the largest upper and
    the least lower ones of each component in turn, and end when nothing is open; the results are exact.  Trees and
    graphs of the world take a few searches.  Where every vertex needs its own, as on a ring, the time is quadratic, but
    no more than ``most`` searches a component are held at once.
    """
    edges = materialize(g.undirected(), "far-edges")
    parts = materialize(connected_components(edges), "far-parts")
    wanted = sources.select("id").distinct().join(parts, "id")
    state = materialize(wanted.select("id", "component", F.lit(0).cast("long").alias("low"), F.lit((1 << 62)).cast("long").alias("high")), "far")
    wide = 2
    while True:
        left = state.where("low < high")
        if not all_of_them:
            top = state.agg(F.max("low")).first()[0]
            left = left.where(F.col("high") > F.lit(top or 0))
        # Two lists of each component: the largest upper bounds and the least lower bounds; unlike ones first.
        kinds = left.select("id", "component", F.explode(F.array(F.struct(F.lit(0).alias("kind"), (-F.col("high")).alias("key")), F.struct(F.lit(1).alias("kind"), F.col("low").alias("key")))).alias("k"))
        at = Window.partitionBy("component", "k.kind").orderBy("k.key", F.xxhash64("id", F.lit(wide)), "id")
        picked = materialize(kinds.withColumn("r", F.row_number().over(at)).where(F.col("r") <= wide // 2).select("id").distinct(), "far-picked")
        if picked.isEmpty():
            break
        found = bfs(edges, picked)
        far = found.groupBy("source").agg(F.max("dist").cast("long").alias("ecc"))
        met = found.join(far, "source").groupBy("id").agg(F.max(F.greatest(F.col("dist").cast("long"), F.col("ecc") - F.col("dist"))).alias("l"), F.min(F.col("ecc") + F.col("dist")).alias("h"), F.max(F.when(F.col("source") == F.col("id"), F.col("ecc"))).alias("own"))
        low, high = F.greatest("low", F.coalesce("own", "l", F.lit(0))), F.least("high", F.coalesce("own", "h", "high"))
        last, state = state, materialize(state.join(met, "id", "left").select("id", "component", low.alias("low"), high.alias("high")), "far")
        for done in (last, found, picked):
            discard(done)
        wide = min(2 * wide, most)
    alone = sources.select("id").distinct().join(parts, "id", "left_anti").select("id", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))
    return state.select("id", "low", "high").unionByName(alone)


def eccentricity(g: Graph, sources: DataFrame) -> DataFrame:
    """``(id, eccentricity)`` on the undirected view; what can't be reached doesn't count."""
    return _bounded(g, sources, True).select("id", F.col("low").alias("eccentricity"))


def diameter(g: Graph) -> DataFrame:
    """The longest shortest path."""
    return _bounded(g, g.vertices, False).agg(F.max("low").alias("diameter"))


def ego(g: Graph, center: int, bound: int) -> Graph:
    """Vertices within bound steps, and the edges at those within bound - 1."""
    spark = g.vertices.sparkSession
    near = bfs(g.undirected(), spark.createDataFrame([(center,)], "id long"), bound)
    inner = near.where(F.col("dist") < bound).select("id")
    touching = g.edges.join(inner.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst").unionByName(g.edges.join(inner.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
    return Graph(g.vertices.join(near.select("id"), "id", "left_semi"), touching.distinct())


def ordered(levels: DataFrame) -> DataFrame:
    """``(id, place)``: a breadth-first order of one source's levels, by distance and id."""
    from .order import numbered

    return numbered(levels.select("id", "dist"), [F.col("dist"), F.col("id")], "place").select("id", "place")


def distances(g: Graph, edges: DataFrame, source: int) -> DataFrame:
    """``(id, dist)`` of every vertex; -1 where there is no way."""
    return g.vertices.select("id").join(sssp(edges, source), "id", "left").select("id", F.coalesce("dist", F.lit(-1.0)).alias("dist"))


def sssp(edges: DataFrame, source: int, limit: int = 10_000) -> DataFrame:
    """``(id, dist)`` over edges(src, dst, w) with w >= 0, only what can be reached."""
    spark = edges.sparkSession
    front = materialize(spark.createDataFrame([(source, 0.0)], "id long, dist double"), "sssp")
    log = front  # a round adds what got shorter; the least entry of an id holds
    for turn in range(limit):
        best = log.groupBy("id").agg(F.min("dist").alias("dist"))
        tried = front.join(edges, front["id"] == edges["src"]).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        front = materialize(tried.join(best, "id", "left").where("dist is null or new < dist").select("id", F.col("new").alias("dist")), "sssp-front")
        if front.isEmpty():
            return materialize(best, "sssp")
        log = log.unionByName(front)
        if turn % 16 == 15:
            log = materialize(log.groupBy("id").agg(F.min("dist").alias("dist")), "sssp")
    raise RuntimeError(f"no fixpoint within {limit} rounds")


def cyclic_core(g: Graph) -> DataFrame:
    """Edges left when vertices without in-edges or without out-edges are peeled off again and again."""
    edges, n = materialize(g.edges.distinct(), "peel"), -1
    while True:
        now = edges.count()
        if now in (n, 0):
            return edges
        n = now
        fed, feeding = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        last, edges = edges, materialize(edges.join(fed, "src", "left_semi").join(feeding, "dst", "left_semi").select("src", "dst"), "peel")
        discard(last)


def has_cycles(g: Graph) -> DataFrame:
    """Peels as ``cyclic_core`` does, but contracts paths meanwhile, so that a chain halves each round instead of losing its ends."""
    edges, turn = materialize(g.edges.select("src", "dst"), "cycle-edges"), 0
    none = F.lit(None).cast("long")
    while True:
        if edges.isEmpty():
            return _answer(g, False)
        ends = F.explode(F.array(F.struct(F.col("src").alias("id"), none.alias("before"), F.col("dst").alias("after")), F.struct(F.col("dst").alias("id"), F.col("src").alias("before"), none.alias("after"))))
        around = edges.select(ends.alias("e")).groupBy("e.id").agg(F.count("e.before").alias("n_in"), F.count("e.after").alias("n_out"), F.max("e.before").alias("before"), F.max("e.after").alias("after"))
        luck = lambda c, turn=turn: F.xxhash64(c, F.lit(turn))
        dead = (F.col("n_in") == 0) | (F.col("n_out") == 0)
        # Of a path's vertices with one way in and one out, none next to another: the edge before takes over the one after.
        skip = (F.col("n_in") == 1) & (F.col("n_out") == 1) & (luck("id") < luck("before")) & (luck("id") < luck("after"))
        marks = materialize(around.where(dead | skip).select("id", dead.alias("dead"), "before"), "cycle-marks")
        if marks.where("dead").isEmpty():  # every vertex that is left has a way in
            return _answer(g, True)
        at = lambda end, name: marks.select(F.col("id").alias(end), F.col("dead").alias(f"{name}_dead"), F.col("before").alias(f"{name}_before"))
        # Gone with a dead end; an edge into a skipped vertex goes, as the one out of it starts where that one did.
        kept = edges.join(at("src", "a"), "src", "left").where("a_dead is null or not a_dead").join(at("dst", "b"), "dst", "left").where("b_dead is null")
        last, edges = edges, materialize(kept.select(F.coalesce("a_before", "src").alias("src"), "dst"), "cycle-edges")
        discard(last)
        discard(marks)
        turn += 1


def _answer(g: Graph, cyclic: bool) -> DataFrame:
    return g.edges.sparkSession.createDataFrame([(cyclic,)], "has_cycles boolean")
