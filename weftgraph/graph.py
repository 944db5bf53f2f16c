"""Graphs as two DataFrames: ``vertices(id, label)`` and ``edges(src, dst)``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import dealt


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    most_edges: int | None = None  # the edges are no more than that, where it is known

    @staticmethod
    def from_tables(vertices: DataFrame, edges: DataFrame, id: str = "id", label: str = "label", src: str = "src", dst: str = "dst") -> Graph:
        """Map columns of any two tables; labels are trimmed strings, ids are 64-bit."""
        return Graph(
            vertices.select(F.col(id).cast("long").alias("id"), F.trim(F.col(label).cast("string")).alias("label")),
            edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")),
        )

    def check(self) -> Graph:
        """Raise if an id occurs twice or an edge has an unknown end."""
        if not self.vertices.groupBy("id").count().where("count > 1").isEmpty():
            raise ValueError("a vertex id occurs twice")
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id"))
        if not ends.join(self.vertices, "id", "left_anti").isEmpty():
            raise ValueError("an edge has an end that isn't a vertex")
        return self

    def simple(self) -> Graph:
        """Without self loops and parallel edges."""
        return Graph(self.vertices, self.edges.where("src <> dst").distinct())

    def reversed(self) -> Graph:
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def once(self) -> DataFrame:
        """``(src, dst)``, src < dst: every edge once whatever its direction, without self loops."""
        ends = self.edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        return dealt(ends, self.most_edges, "src", "dst").distinct()

    def undirected(self) -> DataFrame:
        """Both directions of every edge, once each, without self loops."""
        return both_ways(self.once())


def both_ways(once: DataFrame) -> DataFrame:
    """Edges that are held in one direction, in both; other columns go with them."""
    more = [c for c in once.columns if c not in ("src", "dst")]
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), *more)
    return once.select(F.explode(F.array(way("src", "dst"), way("dst", "src"))).alias("e")).select("e.*")
