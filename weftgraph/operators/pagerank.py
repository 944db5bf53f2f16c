"""PageRank by messages, and as a random walk with restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..runtime import discard, materialize


def _links(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(src, d)``, and ``(src, d, to)`` with the targets as lists: a round moves a number for each edge, not a row; a hub has many lists."""
    out = edges.groupBy("src").agg(F.count("*").alias("d"))
    lists = edges.join(out, "src").groupBy("src", "d", F.pmod(F.xxhash64("dst"), F.ceil(F.col("d") / 4096)).alias("part")).agg(F.collect_list("dst").alias("to"))
    return out, materialize(lists.select("src", "d", "to"), "links")


def _sent(rank: DataFrame, links: DataFrame) -> DataFrame:
    """``(id, m)``: what the vertices of rank(src, rank) send, summed by receiver."""
    return rank.join(links, "src").select((F.col("rank") / F.col("d")).alias("share"), F.explode("to").alias("id")).groupBy("id").agg(F.sum("share").alias("m"))


def message_driven(g: Graph, updates: int = 9, first: float = 0.5) -> DataFrame:
    """``(id, rank)``: all start at ``first``; only who got messages updates, to 0.15 / out-degree + 0.85 * their sum, and sends on.

    A vertex without out-edges has no teleport part.
    """
    out, links = _links(g.edges)
    rank = materialize(g.vertices.select("id", F.lit(first).alias("rank"), F.lit(True).alias("active")).join(out.withColumnRenamed("src", "id"), "id", "left"), "pagerank")
    for _ in range(updates):
        sent = _sent(rank.where("active").select(F.col("id").alias("src"), "rank"), links)
        last, teleport = rank, F.when(F.col("d") > 0, 0.15 / F.col("d")).otherwise(0.0)
        rank = materialize(rank.join(sent, "id", "left").select("id", F.when(F.col("m").isNull(), F.col("rank")).otherwise(teleport + 0.85 * F.col("m")).alias("rank"), F.col("m").isNotNull().alias("active"), "d"), "pagerank")
        discard(last)
    return rank.select("id", "rank")


def random_walk(g: Graph, damping: float = 0.8, iterations: int = 10, restart: DataFrame | None = None, eps: float | None = None) -> DataFrame:
    """``(id, rank, iterations)``; restart(id, r) sums to one, by default it is even.  With eps it stops when no rank moves by more."""
    n = g.vertices.count()
    if not n:
        return g.vertices.select("id", F.lit(0.0).alias("rank"), F.lit(0).alias("iterations"))
    out, links = _links(g.edges)
    even = g.vertices.select("id", F.lit(1.0 / n).alias("r")) if restart is None else g.vertices.join(restart, "id", "left").select("id", F.coalesce("r", F.lit(0.0)).alias("r"))
    rank = materialize(even.join(out.select(F.col("src").alias("id"), "d"), "id", "left").select("id", "r", F.col("d").isNull().alias("sink"), F.col("r").alias("rank"), F.lit(1.0).alias("moved")), "walk")
    done = 0
    for done in range(1, iterations + 1):
        lost = rank.where("sink").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        into = _sent(rank.select(F.col("id").alias("src"), "rank"), links)
        new = damping * (F.lit(lost) * F.col("r") + F.coalesce("m", F.lit(0.0))) + (1 - damping) * F.col("r")
        last = rank
        rank = materialize(rank.join(into, "id", "left").select("id", "r", "sink", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved")), "walk")
        discard(last)
        if eps is not None and rank.agg(F.max("moved")).first()[0] < eps:
            break
    return rank.select("id", "rank", F.lit(done).alias("iterations"))


def random_restart(g: Graph, seed: int = 0) -> DataFrame:
    """``(id, r)``: a random restart vector that sums to one, the same for the same seed."""
    raw = g.vertices.select("id", (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) + 1).cast("double").alias("x"))
    total = raw.agg(F.sum("x")).first()[0] or 1.0
    return raw.select("id", (F.col("x") / total).alias("r"))


def largest_step(g: Graph, ranks: DataFrame) -> DataFrame:
    """``(src, dst, step)``: the edge whose ends' ranks are furthest apart; ties by ends."""
    a, b = ranks.select(F.col("id").alias("src"), F.col("rank").alias("a")), ranks.select(F.col("id").alias("dst"), F.col("rank").alias("b"))
    steps = g.edges.join(a, "src").join(b, "dst").select("src", "dst", F.abs(F.col("a") - F.col("b")).alias("step"))
    return steps.agg(F.min(F.struct((-F.col("step")).alias("less"), "src", "dst")).alias("m")).where("m is not null").select("m.src", "m.dst", (-F.col("m.less")).alias("step"))


def personalized(g: Graph, source: int, damping: float = 0.8, iterations: int = 10) -> DataFrame:
    return random_walk(g, damping, iterations, g.vertices.where(F.col("id") == source).select("id", F.lit(1.0).alias("r")))
