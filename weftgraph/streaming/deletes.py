"""Incremental simulation: edge deletions from a stream shrink a kept relation.

The relation only ever shrinks under deletions, so each batch starts from the
last one's result instead of from all label matches.  Relation and edges are
kept in a folder, one version for each batch; a version counts once its last
table is committed, so a restarted stream goes on from the last whole batch,
and a batch that comes again is not applied twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import Graph
from ..operators.navigate import remove_edges
from ..operators.simulation import Pattern, simulation
from ..runtime import materialize


class LiveSimulation:
    """``apply`` to each batch of deleted edges(src, dst); ``attach`` does so for a stream.

    folder: where the versions live, on a file system that all executors see.
    """

    def __init__(self, graph: Graph, pattern: Pattern, folder: str):
        self.pattern, self.folder, self.vertices = pattern, folder.rstrip("/"), graph.vertices
        self.spark = graph.vertices.sparkSession
        self.version = self._last()
        if self.version is None:
            self.version = -1
            self._store(graph.edges.select("src", "dst"), simulation(graph, pattern))

    def _last(self) -> int | None:
        """The newest version whose relation is committed."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v=*/relation/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return max((int(f.getPath().getParent().getParent().getName()[2:]) for f in found or ()), default=None)

    def _store(self, edges: DataFrame, relation: DataFrame) -> None:
        at = f"{self.folder}/v={self.version}"
        edges.write.mode("overwrite").parquet(f"{at}/edges")
        relation.write.mode("overwrite").parquet(f"{at}/relation")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(T._parse_datatype_string(schema)).parquet(f"{self.folder}/v={self.version}/{name}")

    @property
    def result(self) -> DataFrame:
        return self._read("relation", "u long, v long")

    def apply(self, gone: DataFrame, version: int | None = None) -> DataFrame:
        """The relation without these edges; a version that isn't newer than the last leaves it as it is."""
        version = self.version + 1 if version is None else version
        if version <= self.version:
            return self.result
        edges = materialize(remove_edges(Graph(self.vertices, self._read("edges", "src long, dst long")), gone).edges, "live-edges")
        # A vertex that matched nothing before can't match now.
        alive = materialize(self.vertices.join(self.result.select(F.col("v").alias("id")).distinct(), "id", "left_semi"), "live-vertices")
        found = simulation(Graph(alive, edges), self.pattern)
        self.version = version
        self._store(edges, found)
        return self.result

    def attach(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: self.apply(batch, n) and None).start()
