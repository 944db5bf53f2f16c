"""Exact top-k search by inner product with a k-d tree per shard.

The top of one tree, made from a sample of ``SAMPLE`` vectors, deals all vectors
to shards of about ``SHARD`` rows; a leaf with more (a vector that very many
rows share) is dealt further by ids.  The sample only bears on speed.  Each
shard's own tree splits at the median of its box's widest side, and keeps a
tight box for every node.  A query walks the tree best first: a node's bound
is the largest product that its box allows, and it is left unread if the bound
is below the k-th best so far.

The boxes of whole shards are a small table.  Blocks of queries are held
against blocks of boxes first: each query visits the shard of its best bound
(``pilot``), and the k-th best found there is handed on to all others.  Only
pairs of a query and a shard whose bound reaches that floor are ever sent.
Bounds equal to it are kept, so ties go to the smaller id.  A shard's tree
travels once for every ``BLOCK`` queries that come to it; no task holds more
than one tree and one such block.  Products are exact integers.

Defined results: a vector that is null, or has a null, NaN or infinite
component, takes no part; shorter vectors count as filled up with zeros; a row
never answers its own id, repeated rows included; with fewer than k other rows
all are returned; an empty table gives no rows; a null id takes no part; rows
that share a query's id are told apart by their vectors, and each gets its own
answer; components whose 1024-fold leaves 64 bits are held at its ends.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import batches_of, materialize

SHARD = 8192
BLOCK = 2048
BOXES = 2048
SAMPLE = 20_000
LEAF = 128
SCALE = 1024
TREE = "shard long, tree binary, low array<double>, high array<double>"


def _multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of the rows of a with b; int64 where they fit, Python's integers beyond."""
    if not a.size:
        return np.zeros(len(a), dtype=np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] if a.dtype != object else 1 << 63
    if most < 1 << 53:
        return np.rint(np.einsum("ij,j->i", a.astype(np.float64), b.astype(np.float64))).astype(np.int64)
    if most < 1 << 62:
        return np.einsum("ij,j->i", a, b)
    return np.array([sum(int(x) * int(y) for x, y in zip(r, b)) for r in a], dtype=object)


@dataclass
class Tree:
    ids: np.ndarray
    points: np.ndarray  # in leaf order
    low: np.ndarray  # boxes of nodes
    high: np.ndarray
    span: np.ndarray  # rows from, to
    kids: np.ndarray  # two of each node, or -1

    @staticmethod
    def build(ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.arange(len(ids))
        low, high, span, kids = [], [], [], []
        stack = [(0, len(ids), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            here, part = len(low), points[order[a:b]]
            if parent >= 0:
                kids[parent][side] = here
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            span.append((a, b))
            kids.append([-1, -1])
            if b - a > leaf and (high[-1] > low[-1]).any():
                axis, mid = int((high[-1] - low[-1]).argmax()), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, axis], mid, kind="introselect")]
                stack += [(a, a + mid, here, 0), (a + mid, b, here, 1)]
        return Tree(ids[order], points[order], np.array(low), np.array(high), np.array(span), np.array(kids))

    def search(self, query: np.ndarray, own: int, k: int, floor: float) -> tuple[list[tuple[int, int]], int]:
        """Up to k of (score, id), best first, among scores of at least floor; nodes opened."""
        q = query.astype(np.float64)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        bounds = np.einsum("ij,j->i", self.high.astype(np.float64), up) + np.einsum("ij,j->i", self.low.astype(np.float64), down)
        bounds += np.abs(bounds) * 1e-12 + 1e-6
        best: list[tuple[int, int]] = []  # (score, -id), the worst first
        queue, opened = [(-bounds[0], 0)], 0
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < floor or len(best) == k and -bound < best[0][0]:
                break
            a, b = self.span[node]
            opened += 1
            if self.kids[node][0] >= 0:
                for kid in self.kids[node]:
                    heapq.heappush(queue, (-bounds[kid], kid))
                continue
            scores = _multiply(self.points[a:b].astype(np.int64), query)
            least = max(floor, best[0][0]) if len(best) == k else floor
            for i in np.flatnonzero(scores >= least) if least > -np.inf else range(b - a):
                one = (int(scores[i]), -int(self.ids[a + i]))
                if -one[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, one)
                elif one > best[0]:
                    heapq.heapreplace(best, one)
        return [(s, -i) for s, i in sorted(best, reverse=True)], opened


def _whole(vector: Column) -> Column:
    """floor(1024 * x) of each component; null if the vector takes no part."""
    good = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _narrow(points: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest type that holds them."""
    ends = points.min(initial=0), points.max(initial=0)
    return points.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= ends[0] and ends[1] <= np.iinfo(t).max))


@dataclass(frozen=True)
class Top:
    """The top of a k-d tree; a node below zero is leaf ``-1 - node``."""

    axis: list[int]
    cut: list[int]
    kids: list[list[int]]
    leaves: int

    @staticmethod
    def build(sample: np.ndarray, leaves: int) -> Top:
        axes, cuts, kids, found = [], [], [], 0
        stack = [(np.arange(len(sample)), leaves, -1, 0)]
        while stack:
            rows, parts, parent, side = stack.pop()
            part = sample[rows]
            axis = int((part.max(axis=0) - part.min(axis=0)).argmax()) if len(rows) and sample.shape[1] else 0
            values = np.sort(part[:, axis]) if parts > 1 and len(rows) and sample.shape[1] else np.zeros(1)
            cut = values[len(values) * (parts // 2) // parts] if parts > 1 else 0
            if values[0] == cut:  # many equal values: split right above them
                cut = values[min(np.searchsorted(values, cut, side="right"), len(values) - 1)]
            node = -1 - found if values[0] == cut else len(axes)
            if parent >= 0:
                kids[parent][side] = node
            if node < 0:
                found += 1
                continue
            axes.append(axis)
            cuts.append(int(cut))
            kids.append([0, 0])
            low = part[:, axis] < cut
            stack += [(rows[low], parts // 2, node, 0), (rows[~low], parts - parts // 2, node, 1)]
        return Top(axes, cuts, kids, found)

    def route(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), dtype=np.int64)
        stack = [(0, np.arange(len(points)))] if self.axis else []
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                low = points[rows, self.axis[node]] < self.cut[node]
                stack += [(self.kids[node][0], rows[low]), (self.kids[node][1], rows[~low])]
        return out


def _bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest product that each box allows each query, a little more for rounding."""
    q = queries.astype(np.float64)
    found = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    size = np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T
    return found + size * 1e-12 + 1e-6


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, shard_rows: int = SHARD) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows whose id is divisible by ``every``, against all rows."""
    spark = vectors.sparkSession
    with batches_of(spark, 1024):
        return _top_k(vectors, k, every, shard_rows)


def _top_k(vectors: DataFrame, k: int, every: int, shard_rows: int) -> DataFrame:
    spark = vectors.sparkSession
    points = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), _whole(F.col("embedding").cast("array<double>")).alias("v")).where("vec_id is not null and v is not null")
    size = points.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    n, width = size["n"], size["w"] or 0
    leaves = max(1, -(-n // shard_rows))
    some = points.where(F.pmod(F.xxhash64("vec_id"), F.lit(n // SAMPLE + 1)) == 0).select("v").limit(2 * SAMPLE).toPandas() if leaves > 1 else None
    top = Top.build(_matrix(some["v"], width), leaves) if leaves > 1 else Top([], [], [], 1)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(leaf=top.route(_matrix(rows["v"], width)))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = Tree.build(rows["vec_id"].to_numpy(), _narrow(_matrix(rows["v"], width)))
        return pd.DataFrame({"shard": [key[0]], "tree": [pickle.dumps((tree.ids, tree.points, tree.low, tree.high, tree.span, tree.kids))], "low": [tree.low[0].astype(float)], "high": [tree.high[0].astype(float)]})

    routed = materialize(points.mapInPandas(route, "vec_id long, v array<long>, leaf long"), "kdtree-points")
    parts = materialize(routed.groupBy("leaf").agg(F.ceil(F.count("*") / shard_rows).alias("parts")), "kdtree-leaves")
    shard = F.col("leaf") * (1 << 20) + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))
    trees = materialize(routed.join(parts, "leaf").select(shard.alias("shard"), "vec_id", "v").groupBy("shard").applyInPandas(build, TREE), "kdtree-trees")
    asked = routed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("key"), "v").distinct()
    asked = materialize(asked, "kdtree-queries")
    query_blocks, box_blocks = max(1, -(-n // (every * BLOCK))), max(1, -(-2 * leaves // BOXES))
    boxes = trees.select(F.pmod(F.xxhash64("shard"), F.lit(box_blocks)).cast("int").alias("at"), F.struct("shard", "low", "high").alias("box")).groupBy("at").agg(F.collect_list("box").alias("boxes"))
    boxes = materialize(boxes, "kdtree-boxes")

    def pairs(queries: DataFrame, pilots: bool) -> DataFrame:
        """``(query_id, key, v, floor, shard, bound)`` of queries(query_id, key, v, floor, pilot): their best shard of each block of boxes, or all that reach their floor but the pilot."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for block, here in zip(rows["queries"], rows["boxes"]):
                    block, here = pd.DataFrame(list(block), columns=["query_id", "key", "v", "floor", "pilot"]), list(here)
                    bounds = _bounds(_matrix(block["v"], width), np.array([b["low"] for b in here]), np.array([b["high"] for b in here]))
                    shards = np.array([b["shard"] for b in here])
                    if pilots:
                        q, s = np.arange(len(block)), bounds.argmax(axis=1)
                    else:
                        floors = block["floor"].astype(float).fillna(-np.inf).to_numpy()
                        q, s = np.nonzero((bounds >= floors[:, None]) & (shards[None] != block["pilot"].to_numpy()[:, None]))
                    for at in range(0, len(q), 4096):
                        yield block.iloc[q[at : at + 4096]].drop(columns="pilot").assign(shard=shards[s[at : at + 4096]], bound=bounds[q[at : at + 4096], s[at : at + 4096]])

        blocks = queries.groupBy(F.pmod(F.xxhash64("query_id", "key"), F.lit(query_blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", "key", "v", "floor", "pilot")).alias("queries"))
        both = blocks.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(box_blocks - 1)))).join(boxes, "at")
        with batches_of(spark, 1):
            return materialize(both.select("queries", "boxes").mapInPandas(run, "query_id long, key long, v array<long>, floor double, shard long, bound double"), "kdtree-pairs")

    def search(left: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in left:
            for tree, block in zip(rows["tree"], rows["queries"]):
                found = Tree(*pickle.loads(tree))
                out = [(q["query_id"], q["key"], i, s) for q in block for s, i in found.search(np.pad(np.asarray(q["v"], dtype=np.int64), (0, width - len(q["v"]))), q["query_id"], k, -np.inf if q["floor"] is None or np.isnan(q["floor"]) else q["floor"])[0]]
                yield pd.DataFrame(out, columns=["query_id", "key", "vec_id", "score"])

    def against(pairs: DataFrame) -> DataFrame:
        sizes = materialize(pairs.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "kdtree-sizes")
        sent = pairs.join(sizes, "shard").groupBy("shard", F.pmod(F.xxhash64("query_id", "key"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("query_id", "key", "v", "floor")).alias("queries"))
        with batches_of(spark, 1):
            return materialize(sent.join(trees.select("shard", "tree"), "shard").select("tree", "queries").mapInPandas(search, "query_id long, key long, vec_id long, score long"), "kdtree-found")

    tried = pairs(asked.select("*", F.lit(None).cast("double").alias("floor"), F.lit(None).cast("long").alias("pilot")), True)
    chosen = tried.groupBy("query_id", "key").agg(F.max(F.struct("bound", "shard", "v")).alias("b")).select("query_id", "key", "b.v", F.lit(None).cast("double").alias("floor"), "b.shard")
    chosen = materialize(chosen, "kdtree-pilots")
    first = against(chosen)
    floors = first.groupBy("query_id", "key").agg(F.when(F.count("*") >= k, F.min("score").cast("double") - F.abs(F.min("score").cast("double")) * 3e-16).alias("floor"))
    others = pairs(chosen.drop("floor").join(floors, ["query_id", "key"], "left").select("query_id", "key", "v", "floor", F.col("shard").alias("pilot")), False)
    every_one = first.unionByName(against(others.drop("bound")))
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return every_one.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
