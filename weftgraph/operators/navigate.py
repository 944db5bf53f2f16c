"""Neighbourhoods, membership, degrees, and graphs with parts added or removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


def children(g: Graph, ids: DataFrame) -> DataFrame:
    """``(id, child)`` for the given ids, each once."""
    return g.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("child")).distinct()


def parents(g: Graph, ids: DataFrame) -> DataFrame:
    return children(g.reversed(), ids).withColumnRenamed("child", "parent")


def neighbours(g: Graph, ids: DataFrame) -> DataFrame:
    both = children(g, ids).withColumnRenamed("child", "neighbour").unionByName(parents(g, ids).withColumnRenamed("parent", "neighbour"))
    return both.distinct()


def degree(g: Graph) -> DataFrame:
    """``(id, out_degree, in_degree, degree)`` of every vertex; parallel edges count."""
    ends = g.edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(g.edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    out = g.vertices.join(sums, "id", "left").select("id", F.coalesce("o", F.lit(0)).cast("long").alias("out_degree"), F.coalesce("i", F.lit(0)).cast("long").alias("in_degree"))
    return out.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def contains_vertex(g: Graph, id: int) -> bool:
    return not g.vertices.where(F.col("id") == id).isEmpty()


def contains_vertices(g: Graph, ids: DataFrame) -> DataFrame:
    """ids(id) with ``present``."""
    there = g.vertices.select("id").distinct().withColumn("present", F.lit(True))
    return ids.join(there, "id", "left").select("id", F.coalesce("present", F.lit(False)).alias("present"))


def vertex(g: Graph, id: int) -> DataFrame:
    return g.vertices.where(F.col("id") == id)


def contains_edge(g: Graph, pairs: DataFrame) -> DataFrame:
    """pairs(src, dst) with ``present``."""
    there = g.edges.distinct().withColumn("present", F.lit(True))
    return pairs.join(there, ["src", "dst"], "left").select("src", "dst", F.coalesce("present", F.lit(False)).alias("present"))


def edges_between(g: Graph, a: int, b: int) -> DataFrame:
    return g.edges.where((F.col("src") == a) & (F.col("dst") == b))


def add_vertices(g: Graph, new: DataFrame) -> Graph:
    """Upsert by id: a new label takes the place of the old one."""
    return Graph(g.vertices.join(new, "id", "left_anti").unionByName(new), g.edges)


def add_edges(g: Graph, new: DataFrame) -> Graph:
    return Graph(g.vertices, g.edges.unionByName(new))


def remove_edges(g: Graph, gone: DataFrame) -> Graph:
    """Without every edge that has the ends of one in gone."""
    return Graph(g.vertices, g.edges.join(gone.select("src", "dst").distinct(), ["src", "dst"], "left_anti"))


def remove_vertices(g: Graph, gone: DataFrame) -> Graph:
    """With them go the edges at them."""
    ids = gone.select("id").distinct()
    edges = g.edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
    return Graph(g.vertices.join(ids, "id", "left_anti"), edges.select("src", "dst"))


def cleared(g: Graph, vertices_too: bool = True) -> Graph:
    return Graph(g.vertices.limit(0) if vertices_too else g.vertices, g.edges.limit(0))


def subgraph(g: Graph, ids: DataFrame) -> Graph:
    """Induced by ids."""
    keep = ids.select("id").distinct()
    edges = g.edges.join(keep.select(F.col("id").alias("src")), "src", "left_semi").join(keep.select(F.col("id").alias("dst")), "dst", "left_semi")
    return Graph(g.vertices.join(keep, "id", "left_semi"), edges.select("src", "dst"))


def extract_part(g: Graph, owner: DataFrame, pid: int) -> Graph:
    """The subgraph that one part's vertices induce."""
    return subgraph(g, owner.where(F.col("pid") == pid))


def split(g: Graph, owner: DataFrame) -> DataFrame:
    """``(pid, src, dst)``: every part's induced subgraph at once."""
    from .fragment import owned_edges

    return owned_edges(g, owner).where("src_pid = dst_pid").select(F.col("src_pid").alias("pid"), "src", "dst")


def members(owner: DataFrame) -> DataFrame:
    """``(pid, first, id)``: ids in order of their parts, and where each part begins in that order."""
    from .order import numbered

    placed = numbered(owner.select("id", "pid"), [F.col("pid"), F.col("id")], "place")
    return placed.join(placed.groupBy("pid").agg(F.min("place").alias("first")), "pid").select("pid", "first", "place", "id")


def permuted(df: DataFrame, seed: int = 0, key: str = "id") -> DataFrame:
    """Adds ``place``: a random order, the same for the same seed."""
    from .order import numbered

    return numbered(df, [F.xxhash64(key, F.lit(seed)), F.col(key)], "place")


def reorder(g: Graph, places: DataFrame) -> Graph:
    """Rename every vertex by places(id, place)."""
    p = places.select("id", "place")
    edges = g.edges.join(p.select(F.col("id").alias("src"), F.col("place").alias("s")), "src").join(p.select(F.col("id").alias("dst"), F.col("place").alias("d")), "dst")
    return Graph(g.vertices.join(p, "id").select(F.col("place").alias("id"), "label"), edges.select(F.col("s").alias("src"), F.col("d").alias("dst")))


def random_vertex(g: Graph, seed: int = 0) -> DataFrame:
    """One vertex, the same for the same seed."""
    return g.vertices.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1)


def display(g: Graph, limit: int = 20) -> DataFrame:
    """Vertices with their sorted children."""
    out = g.edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("children"))
    return g.vertices.orderBy("id").limit(limit).join(out, F.col("id") == F.col("src"), "left").select("id", "label", "children").orderBy("id")


def compactness(edges: DataFrame) -> DataFrame:
    return edges.agg(F.avg(F.abs(F.col("src") - F.col("dst"))).alias("compactness"))


def centroid_reorder(g: Graph, weight: float = 0.5) -> DataFrame:
    """``(id, place)`` by id + weight * mean offset of the neighbours; ties by id."""
    from .order import numbered

    both = g.edges.unionByName(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    mean = both.groupBy(F.col("src").alias("id")).agg((F.sum(F.col("dst") - F.col("src")) / F.count("*")).alias("m"))
    keys = g.vertices.join(mean, "id", "left").select("id", (F.col("id") + weight * F.coalesce("m", F.lit(0.0))).alias("key"))
    return numbered(keys, [F.col("key"), F.col("id")], "place").select("id", "place")
