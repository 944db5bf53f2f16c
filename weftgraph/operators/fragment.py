"""Fragments of a graph by an owner of each vertex, and how good they are.

Owners are a table ``(id, pid)``.  An edge whose ends have two owners crosses,
and belongs to both fragments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..runtime import dealt, materialize
from .components import connected_components
from .order import numbered

_SHARE = 2000  # elements of a node that one task pairs with all of the node's


def hash_owner(g: Graph, k: int) -> DataFrame:
    return g.vertices.select("id", F.pmod("id", F.lit(k)).cast("int").alias("pid"))


def range_owner(g: Graph, k: int) -> DataFrame:
    """Contiguous ids in k parts of even size, the larger ones first."""
    n = g.vertices.count()
    small, more = divmod(n, k)
    i = F.col("index")
    late = more + F.floor((i - more * (small + 1)) / max(small, 1))
    return numbered(g.vertices.select("id"), [F.col("id")]).select("id", F.when(i < more * (small + 1), F.floor(i / (small + 1))).otherwise(late).cast("int").alias("pid"))


STRATEGIES = ("range", "multilevel", "hash")


def owner(g: Graph, k: int, strategy: str = "hash", **how) -> DataFrame:
    """``(id, pid)`` by the named strategy; how: options of the multilevel one."""
    if strategy == "multilevel":
        from .partition import multilevel

        return multilevel(g, k, **how)
    if strategy not in STRATEGIES:
        raise ValueError(f"{strategy} is none of {STRATEGIES}")
    return hash_owner(g, k) if strategy == "hash" else range_owner(g, k)


def owned_edges(g: Graph, owner: DataFrame) -> DataFrame:
    """``(src, dst, src_pid, dst_pid)``."""
    a, b = owner.select(F.col("id").alias("src"), F.col("pid").alias("src_pid")), owner.select(F.col("id").alias("dst"), F.col("pid").alias("dst_pid"))
    return g.edges.join(a, "src").join(b, "dst").select("src", "dst", "src_pid", "dst_pid")


def fragment_edges(g: Graph, owner: DataFrame) -> DataFrame:
    """``(pid, src, dst, tag)``: 0 inner, 1 leaves the fragment, 2 enters it."""
    e = owned_edges(g, owner)
    cross = F.col("src_pid") != F.col("dst_pid")
    out = e.select(F.col("src_pid").alias("pid"), "src", "dst", F.when(cross, 1).otherwise(0).alias("tag"))
    return out.unionByName(e.where(cross).select(F.col("dst_pid").alias("pid"), "src", "dst", F.lit(2).alias("tag")))


def border(g: Graph, owner: DataFrame) -> DataFrame:
    """``(pid, id, kind)``: remote targets ('out') and remote sources ('in') of a fragment's crossing edges."""
    e = owned_edges(g, owner).where("src_pid <> dst_pid")
    out = e.select(F.col("src_pid").alias("pid"), F.col("dst").alias("id"), F.lit("out").alias("kind"))
    return out.unionByName(e.select(F.col("dst_pid").alias("pid"), F.col("src").alias("id"), F.lit("in").alias("kind"))).distinct()


def virtual_vertices(g: Graph, owner: DataFrame) -> DataFrame:
    """``(id, pid)``: the owner of each end of a crossing edge."""
    e = owned_edges(g, owner).where("src_pid <> dst_pid")
    return e.select(F.col("src").alias("id"), F.col("src_pid").alias("pid")).unionByName(e.select(F.col("dst").alias("id"), F.col("dst_pid").alias("pid"))).distinct()


def summary(g: Graph, owner: DataFrame) -> DataFrame:
    """``(pid, n_vertices, n_edges, n_out, n_in)``; border vertices count as the fragment's vertices."""
    inner = owner.select("pid", "id")
    b = border(g, owner)
    vertices = inner.unionByName(b.select("pid", "id")).distinct().groupBy("pid").agg(F.count("*").alias("n_vertices"))
    edges = fragment_edges(g, owner).groupBy("pid").agg(F.count("*").alias("n_edges"))
    kinds = b.groupBy("pid").agg(F.count_if(F.col("kind") == "out").alias("n_out"), F.count_if(F.col("kind") == "in").alias("n_in"))
    out = vertices.join(edges, "pid", "left").join(kinds, "pid", "left")
    return out.select("pid", "n_vertices", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_edges", "n_out", "n_in")])


# ---- quality, on the undirected view ----------------------------------------


def _undirected(g: Graph, owner: DataFrame) -> DataFrame:
    return owned_edges(Graph(g.vertices, g.undirected(), g.most_edges and 2 * g.most_edges), owner)


def edge_cut(g: Graph, owner: DataFrame) -> DataFrame:
    return _undirected(g, owner).where("src < dst and src_pid <> dst_pid").agg(F.count("*").alias("edge_cut"))


def comm_volume(g: Graph, owner: DataFrame) -> DataFrame:
    """Foreign parts next to each vertex, summed."""
    return _undirected(g, owner).where("src_pid <> dst_pid").select("src", "dst_pid").distinct().agg(F.count("*").alias("comm_volume"))


def max_cut(g: Graph, owner: DataFrame) -> DataFrame:
    """The most crossing edges at one part."""
    return _undirected(g, owner).where("src_pid <> dst_pid").groupBy("src_pid").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("max_cut"))


def border_ratio(g: Graph, owner: DataFrame) -> DataFrame:
    """``(pid, border_ratio)``: vertices at a crossing edge, of all that the fragment owns."""
    ends = virtual_vertices(g, owner).groupBy("pid").agg(F.count("*").alias("b"))
    return owner.groupBy("pid").agg(F.count("*").alias("n")).join(ends, "pid", "left").select("pid", (F.coalesce("b", F.lit(0)) / F.col("n")).alias("border_ratio"))


def target_balance(owner: DataFrame, targets: list[float], weight: Column | None = None) -> DataFrame:
    """``(pid, load)``: a part's share of the weight over its target share; parts without vertices have 0."""
    spark = owner.sparkSession
    w = F.lit(1.0) if weight is None else weight
    want = spark.createDataFrame(list(enumerate(targets)), "pid int, target double")
    total = owner.agg(F.sum(w).alias("all"))
    # One row, and as many as there are parts.
    parts = F.broadcast(want).join(owner.groupBy("pid").agg(F.sum(w).alias("w")), "pid", "left").crossJoin(F.broadcast(total))
    return parts.select("pid", (F.coalesce("w", F.lit(0.0)) / (F.col("target") * F.col("all"))).alias("load"))


def sized_volume(g: Graph, owner: DataFrame, sizes: DataFrame) -> DataFrame:
    """The communication volume with sizes(id, vsize) of what a vertex sends."""
    sent = _undirected(g, owner).where("src_pid <> dst_pid").select(F.col("src").alias("id"), "dst_pid").distinct()
    return sent.join(sizes, "id").agg(F.coalesce(F.sum("vsize"), F.lit(0)).alias("sized_volume"))


def graph_fix(g: Graph) -> DataFrame:
    """``(src, dst, w)`` in both directions: self loops out, parallel edges merged to the sum of their weights (1 each without ``w``), the larger weight of two directions."""
    w = F.col("w") if "w" in g.edges.columns else F.lit(1.0)
    ways = g.edges.where("src <> dst").select("src", "dst", w.alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    once = ways.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("w").alias("w"))
    return once.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))).alias("e")).select("e.*")


def mesh_owner(mesh: DataFrame, elements: DataFrame) -> DataFrame:
    """``(id, pid)`` of nodes: the part of most of a node's elements(id, pid), the least of several."""
    votes = mesh.distinct().join(elements.select(F.col("id").alias("element"), "pid"), "element").groupBy("node", "pid").agg(F.count("*").alias("n"))
    return votes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("less"), "pid")).alias("b")).select(F.col("node").alias("id"), "b.pid")


def element_balance(mesh: DataFrame, elements: DataFrame, k: int) -> DataFrame:
    """The largest part's elements over the mean, and the same of the nodes that a part's elements touch."""
    touched = mesh.distinct().join(elements.select(F.col("id").alias("element"), "pid"), "element").select("pid", "node").distinct()
    of = lambda rows, name: rows.groupBy("pid").count().agg((F.max("count") * k / F.sum("count")).alias(name))
    return of(elements, "element_balance").crossJoin(of(touched, "node_balance"))  # a row each


def balance(owner: DataFrame, k: int, weight: Column | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    parts = owner.groupBy("pid").agg(F.sum(w).alias("w"))
    return parts.agg((F.max("w") * k / F.sum("w")).alias("balance"))


def subdomain_degree(g: Graph, owner: DataFrame) -> DataFrame:
    """``(pid, n_adjacent)``: other parts that share an edge with it."""
    near = _undirected(g, owner).where("src_pid <> dst_pid").groupBy(F.col("src_pid").alias("pid")).agg(F.countDistinct("dst_pid").alias("n"))
    return owner.select("pid").distinct().join(near, "pid", "left").select("pid", F.coalesce("n", F.lit(0)).cast("long").alias("n_adjacent"))


def partition_components(g: Graph, owner: DataFrame) -> DataFrame:
    """``(pid, n_components)`` of each part's own subgraph."""
    inner = owned_edges(g, owner).where("src_pid = dst_pid")
    parts = connected_components(inner)
    named = owner.join(parts, "id", "left").select("pid", F.coalesce("component", "id").alias("component"))
    return named.groupBy("pid").agg(F.countDistinct("component").alias("n_components"))


def graph_check(g: Graph) -> DataFrame:
    """Counts of self loops, of edges without their reverse, and of surplus parallel edges."""
    e = g.edges.distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    zero = F.lit(0).cast("long")
    parts = [
        g.edges.select((F.col("src") == F.col("dst")).cast("long").alias("self_loops"), zero.alias("asymmetric"), F.lit(1).cast("long").alias("duplicates")),
        e.join(back, ["src", "dst"], "left_anti").select(zero.alias("self_loops"), F.lit(1).cast("long").alias("asymmetric"), zero.alias("duplicates")),
        e.select(zero.alias("self_loops"), zero.alias("asymmetric"), F.lit(-1).cast("long").alias("duplicates")),
    ]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("self_loops", "asymmetric", "duplicates")])


def graph_compress(g: Graph) -> DataFrame:
    """``(representative, size)``: vertices with the same closed neighbourhood in the undirected view."""
    closed = g.undirected().unionByName(g.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    # Two independent sums of hashes stand for a neighbourhood of any size.
    sig = closed.groupBy("src").agg(F.sum(F.xxhash64("dst").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64("dst", F.lit(1)).cast("decimal(38,0)")).alias("b"), F.count("*").alias("n"))
    return sig.groupBy("a", "b", "n").agg(F.min("src").alias("representative"), F.count("*").alias("size")).select("representative", "size")


def mesh_dual(mesh: DataFrame, common: int = 1) -> DataFrame:
    """``(src, dst)``, src < dst: elements of mesh(element, node) that share so many nodes."""
    m = materialize(dealt(mesh, mesh.count(), "element", "node").distinct(), "mesh")
    sizes = m.groupBy("node").agg(F.count("*").alias("n"))
    seen = sizes.agg(F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"), F.max("n").alias("most")).first()
    left, right, keys = m.select(F.col("element").alias("src"), "node"), m.select(F.col("element").alias("dst"), "node"), ["node"]
    if (seen["most"] or 0) > _SHARE:  # elements of a node in many of them are dealt to shares that each meet all of them
        shares = F.broadcast(sizes.where(F.col("n") > _SHARE).select("node", F.ceil(F.col("n") / _SHARE).cast("int").alias("shares")))
        many, keys = F.coalesce("shares", F.lit(1)), ["node", "share"]
        left = left.join(shares, "node", "left").select("src", "node", F.pmod(F.xxhash64("src"), many).cast("int").alias("share"))
        right = right.join(shares, "node", "left").select("dst", "node", F.explode(F.sequence(F.lit(0), many - 1)).alias("share"))
    pairs = dealt(left, seen["pairs"], *keys, each=4_000_000).join(dealt(right, seen["pairs"], *keys, each=4_000_000), keys).where("src < dst")
    return dealt(pairs.select("src", "dst"), seen["pairs"], "src", "dst", each=1_000_000).groupBy("src", "dst").count().where(F.col("count") >= common).select("src", "dst")


def mesh_nodal(mesh: DataFrame) -> DataFrame:
    """``(src, dst)``, src < dst: nodes that share an element."""
    return mesh_dual(mesh.select(F.col("node").alias("element"), F.col("element").alias("node")), 1)
