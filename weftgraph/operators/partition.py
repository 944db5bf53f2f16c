"""Multilevel k-way partitioning.

Star clusters contract the graph on the cluster until it is small (``coarse``
vertices, so the driver's part doesn't grow with the graph): a hash picks one
vertex in ``STEP`` as a centre, and all others join the centre they are most
tied to.  The driver grows k parts there; the parts are projected back level by
level and improved by moves of boundary vertices that gain most, within the
balance.  A level sums every vertex' ties to the parts once; a pass then only
looks at the edges of what the last pass moved.  Edges are held in one
direction.  Ties and alternation are settled by hashes, so a run can be
repeated.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, both_ways
from ..runtime import discard, materialize

STEP = 8  # vertices to one centre


def _match(vertices: DataFrame, edges: DataFrame, most: float, seed: int, share: float = 1 / STEP) -> DataFrame:
    """``(id, coarse_id)``: a share of the vertices are centres, the others join their best centre; clusters weigh about ``most`` at most.

    What would make a cluster too heavy forms further ones of the same ties.  So do vertices next to no centre that are
    most tied to the same vertex, as the leaves of a hub.  Weights of edges are whole numbers.
    """
    luck = lambda c, n: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(n))
    centre = lambda c: luck(c, 1 << 20) < int(share * (1 << 20))
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    tie = F.pmod(F.xxhash64(low, high, F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    order = F.when(centre("dst"), float(1 << 30)).otherwise(0.0) + F.least("ew", F.lit(float(1 << 29))) + tie
    best = both_ways(edges).where(~centre("src")).groupBy("src").agg(F.max_by("dst", order).alias("dst"))
    joins = vertices.join(best.select(F.col("src").alias("id"), F.col("dst").alias("c")), "id")
    joins = materialize(joins.select("id", "c", "w"), "joins")
    # A group of each centre's own, numbered 0, and as many more as its members' weight needs.
    groups = joins.groupBy("c").agg(F.ceil(F.sum("w") / most).alias("groups"))
    dealt = joins.join(groups, "c").select("id", "c", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.col("groups")).alias("group"))
    named = dealt.groupBy("c", "group").agg(F.min("id").alias("least")).select("c", "group", F.when((F.col("group") == 0) & centre("c"), F.col("c")).otherwise(F.col("least")).alias("coarse_id"))
    found = materialize(dealt.join(named, ["c", "group"]).select("id", "coarse_id"), "joined")
    out = materialize(vertices.select("id").join(found, "id", "left").select("id", F.coalesce("coarse_id", "id").alias("coarse_id")), "match")
    discard(joins)
    discard(found)
    return out


def _grow(vertices: list[tuple[int, float]], edges: list[tuple[int, int, float]], k: int, most: float) -> dict[int, int]:
    """Greedy growing: the smallest part takes the vertex most tied to it."""
    near: dict[int, dict[int, float]] = {v: {} for v, _ in vertices}
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0) + w
    weight, part, load = dict(vertices), {}, [0.0] * k
    free = sorted(weight, key=lambda v: (-weight[v], v))
    queues: list[list[tuple[float, int]]] = [[] for _ in range(k)]
    at = 0
    while len(part) < len(weight):
        p = min(range(k), key=lambda i: (load[i], i))
        v = None
        while queues[p] and v is None:
            _, c = heapq.heappop(queues[p])
            v = c if c not in part else None
        if v is None:
            while free[at] in part:
                at += 1
            v = free[at]
        part[v] = p
        load[p] += weight[v]
        for u, w in near[v].items():
            if u not in part:
                heapq.heappush(queues[p], (-sum(x for y, x in near[u].items() if part.get(y) == p), u))
    return part


def _shares(load: dict[int, float], want: dict[tuple[int, int], tuple[float, float]], most: float) -> dict[tuple[int, int], float]:
    """What share of the wanted moves from part to part may be done: half, so that neighbours don't swap places for ever, or what leaves room for the heaviest of them."""
    share = dict.fromkeys(want, 0.5)
    for _ in range(100):
        full = False
        for q in {q for _, q in want}:
            into = {e: s * want[e][0] for e, s in share.items() if e[1] == q and s}
            leave = sum(s * want[e][0] for e, s in share.items() if e[0] == q)
            room = max(0.0, most - load.get(q, 0.0) + leave - max((want[e][1] for e in into), default=0.0))
            if sum(into.values()) > room * 1.000001:
                full = True
                share |= {e: share[e] * room / sum(into.values()) for e in into}
        if not full:
            return {e: s if s > 0.001 else 0.0 for e, s in share.items()}
    return dict.fromkeys(want, 0.0)


def _refine(vertices: DataFrame, edges: DataFrame, owner: DataFrame, k: int, most: float, passes: int) -> DataFrame:
    both = both_ways(edges)
    ties = materialize(both.join(owner.select(F.col("id").alias("dst"), F.col("pid").alias("to")), "dst").groupBy("src", "to").agg(F.sum("ew").alias("t")), "ties")
    for turn in range(passes):
        own = owner.join(vertices, "id").select(F.col("id").alias("src"), "pid", "w")
        # The strongest tie to another part, of equal ones the last part's: whole numbers, in one number.
        strong = F.max(F.when(F.col("to") != F.col("pid"), F.col("t") * k + F.col("to")))
        best = ties.join(own, "src").groupBy("src", "pid", "w").agg(strong.alias("b"), F.coalesce(F.sum(F.when(F.col("to") == F.col("pid"), F.col("t"))), F.lit(0.0)).alias("inner"))
        best = best.select("src", "pid", "w", "inner", F.floor(F.col("b") / k).cast("double").alias("t"), (F.col("b") - F.floor(F.col("b") / k) * k).cast("int").alias("to"))
        moves = materialize(best.where(F.col("t") > F.col("inner")).select(F.col("src").alias("id"), "pid", "to", "w"), "moves")
        load = {r["pid"]: r["w"] for r in owner.join(vertices, "id").groupBy("pid").agg(F.sum("w").alias("w")).collect()}  # k rows
        want = {(r["pid"], r["to"]): (r["w"], r["m"]) for r in moves.groupBy("pid", "to").agg(F.sum("w").alias("w"), F.max("w").alias("m")).collect()}
        share = _shares(load, want, most)
        if not any(share.values()):
            discard(moves)
            break
        room = owner.sparkSession.createDataFrame([(p, q, s) for (p, q), s in share.items()], "pid int, to int, share double")
        # Of the moves between two parts a hashed share: expected loads stay within the balance.
        luck = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1000)) < F.col("share") * 1000
        taken = materialize(moves.join(F.broadcast(room), ["pid", "to"]).where(luck).select("id", F.col("pid").alias("old"), F.col("to").alias("new")), "taken")
        last, owner = owner, materialize(owner.join(taken, "id", "left").select("id", F.coalesce("new", "pid").cast("int").alias("pid")), "owner")
        discard(last)
        if turn + 1 < passes:
            way = lambda to, t: F.struct(F.col(to).alias("to"), t.alias("t"))
            less = both.join(taken.withColumnRenamed("id", "dst"), "dst").select("src", F.explode(F.array(way("old", -F.col("ew")), way("new", F.col("ew")))).alias("e")).select("src", "e.to", "e.t")
            less = less.groupBy("src", "to").agg(F.sum("t").alias("t"))
            last, ties = ties, materialize(ties.unionByName(less).groupBy("src", "to").agg(F.sum("t").alias("t")).where("t > 0"), "ties")
            discard(last)
        discard(moves)
        discard(taken)
    discard(ties)
    return owner


def multilevel(g: Graph, k: int, imbalance: float = 0.03, coarse: int | None = None, passes: int = 6, seed: int = 1) -> DataFrame:
    """``(id, pid)`` with few crossing edges and parts of at most (1 + imbalance) of the mean, as far as whole vertices allow."""
    coarse = coarse or max(20 * k, 1000)
    vertices = materialize(g.vertices.select("id", F.lit(1.0).alias("w")), "level-v")
    edges = materialize(g.once().withColumn("ew", F.lit(1.0)), "level-e")
    n = vertices.count()
    most = (1 + imbalance) * n / k
    heaviest = max(1.5 * n / coarse, most / 20) + 2
    levels = []
    while n > coarse:
        match = _match(vertices, edges, heaviest, seed + len(levels), max(1 / STEP, coarse / n / 2))
        levels.append((vertices, edges, match))
        smaller = materialize(vertices.join(match, "id").groupBy(F.col("coarse_id").alias("id")).agg(F.sum("w").alias("w")), "level-v")
        a, b = match.select(F.col("id").alias("src"), F.col("coarse_id").alias("s")), match.select(F.col("id").alias("dst"), F.col("coarse_id").alias("d"))
        folded = edges.join(a, "src").join(b, "dst").where("s <> d").groupBy(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst")).agg(F.sum("ew").alias("ew"))
        edges, vertices, last, n = materialize(folded, "level-e"), smaller, n, smaller.count()
        if n > 0.97 * last:
            break
    spark = g.vertices.sparkSession
    if n <= max(coarse, 50_000):
        part = _grow([(r["id"], r["w"]) for r in vertices.orderBy("id").collect()], [tuple(r) for r in both_ways(edges).orderBy("src", "dst").collect()], k, most) if n else {}
        owner = spark.createDataFrame(sorted(part.items()), "id long, pid int")
    else:
        owner = vertices.select("id", F.pmod(F.xxhash64("id"), F.lit(k)).cast("int").alias("pid"))
    owner = _refine(vertices, edges, materialize(owner, "owner"), k, most, passes)
    for vertices, edges, match in reversed(levels):
        last, owner = owner, materialize(match.join(owner.select(F.col("id").alias("coarse_id"), "pid"), "coarse_id").select("id", "pid"), "owner")
        discard(last)
        owner = _refine(vertices, edges, owner, k, most, passes)
    return owner
