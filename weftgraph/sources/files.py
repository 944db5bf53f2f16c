"""Graph and matrix files, read strictly: what can't be parsed raises.

Lines with a place in the file (METIS formats number them) get it from one
global order of file, offset and line; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import fragment
from ..operators.order import numbered
from ..operators.simulation import Pattern
from ..runtime import materialize


def read_ve(spark: SparkSession, path: str) -> Graph:
    """``path.v`` with ``id <tab> label`` and ``path.e`` with ``src <tab> dst`` lines."""
    read = spark.read.option("sep", "\t").option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    vertices = read.schema("id long, label string").csv(f"{path}.v")
    return Graph(vertices, read.schema("src long, dst long").csv(f"{path}.e"))


@dataclass(frozen=True)
class Fragments:
    """graph: all fragments together; edges(pid, src, dst) and vertices(pid, id, label) of each, border rows included;
    borders(pid, id, kind) with kind in or out; owner(id, pid): the owners of border vertices."""

    graph: Graph
    vertices: DataFrame
    edges: DataFrame
    borders: DataFrame
    owner: DataFrame


def _numbered_files(spark: SparkSession, path: str, ending: str, schema: str) -> DataFrame:
    """``path.p<k>.<ending>``, files or folders, with ``pid``."""
    pid = F.regexp_extract(F.input_file_name(), rf"\.p(\d+)\.{ending}(?:/[^/]*)?$", 1).cast("int")
    read = spark.read.option("sep", "\t").option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    return read.schema(schema).csv(f"{path}.p*.{ending}").withColumn("pid", pid)


def read_fragments(spark: SparkSession, path: str) -> Fragments:
    """All ``path.p<k>.v``, ``.e``, ``.i`` and ``.o`` with ``path.vvp``; a vertex with two labels raises."""
    edges = _numbered_files(spark, path, "e", "src long, dst long").select("pid", "src", "dst")
    vertices = _numbered_files(spark, path, "v", "id long, label string").select("pid", "id", "label")
    named = vertices.select("id", "label").distinct()
    if not named.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("a vertex has two labels")
    kinds = [_numbered_files(spark, path, end, "id long").select("pid", "id", F.lit(kind).alias("kind")) for end, kind in (("i", "in"), ("o", "out"))]
    owner = read_map(spark, f"{path}.vvp").select(F.col("key").alias("id"), F.col("value").cast("int").alias("pid"))
    return Fragments(Graph(named, edges.select("src", "dst").distinct()), vertices, edges, kinds[0].unionByName(kinds[1]), owner)


def write_fragments(g: Graph, owner: DataFrame, path: str, parts: int) -> None:
    """What ``read_fragments`` reads: a folder for each file, of ``parts`` fragments."""
    edges = materialize(fragment.fragment_edges(g, owner).select("pid", "src", "dst"), "fragments-edges")
    borders = materialize(fragment.border(g, owner), "fragments-borders")
    inside = owner.select("pid", "id").unionByName(borders.select("pid", "id")).distinct().join(g.vertices, "id").select("pid", "id", "label")
    inside = materialize(inside, "fragments-vertices")
    tables = {"v": inside, "e": edges, "i": borders.where("kind = 'in'").select("pid", "id"), "o": borders.where("kind = 'out'").select("pid", "id")}
    for k in range(parts):
        for ending, rows in tables.items():
            write_tsv(rows.where(F.col("pid") == k).drop("pid"), f"{path}.p{k}.{ending}")
    write_tsv(fragment.virtual_vertices(g, owner), f"{path}.vvp")


def read_pattern(spark: SparkSession, path: str) -> Pattern:
    """``path.v`` and ``path.e``; a pattern is written by hand and small."""
    g = read_ve(spark, path).check()
    return Pattern(tuple((r["id"], r["label"]) for r in g.vertices.orderBy("id").collect()), tuple((r["src"], r["dst"]) for r in g.edges.distinct().orderBy("src", "dst").collect()))


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    """``(id, pid)``: a line for each vertex in order, ids from 1."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("at"), F.trim("value").cast("int").alias("pid"))
    return numbered(materialize(lines, "lines"), [F.col("at")], "place").select((F.col("place") + 1).alias("id"), "pid")


def write_partition(owner: DataFrame, path: str) -> None:
    """The parts alone, in order of the ids, in one file (the format has no other)."""
    owner.repartition(1).sortWithinPartitions("id").select(F.col("pid").cast("string")).write.text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Whole numbers between blanks, each once."""
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("x")).where("x <> ''").select(F.col("x").cast("long").alias("id")).distinct()


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """``key <tab> value`` lines; a key with two values raises."""
    out = spark.read.option("sep", "\t").option("mode", "FAILFAST").schema("key long, value long").csv(path).distinct()
    if not out.groupBy("key").count().where("count > 1").isEmpty():
        raise ValueError("a key has two values")
    return out


def read_adjacency(spark: SparkSession, path: str) -> Graph:
    """``id label t1 t2 ...`` lines; targets may have no line of their own and then no label."""
    words = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("w"))
    listed = words.select(F.col("w")[0].cast("long").alias("id"), F.col("w")[1].alias("label"))
    edges = words.select(F.col("w")[0].cast("long").alias("src"), F.explode(F.slice("w", 3, F.greatest(F.size("w") - 2, F.lit(0)))).alias("t")).select("src", F.col("t").cast("long").alias("dst"))
    others = edges.select(F.col("dst").alias("id")).distinct().join(listed, "id", "left_anti").select("id", F.lit(None).cast("string").alias("label"))
    return Graph(listed.unionByName(others), edges)


def _lines(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """The header's words, and ``(place, words)`` of all other lines, from 1; comments are left out."""
    # The id of a row follows the order of a file's lines in each of its splits.
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.trim("value").alias("value")).where(~F.col("value").startswith("%"))
    lines = numbered(materialize(lines, "lines"), [F.col("at")], "place").select("place", F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("words"))
    lines = materialize(lines, "lines")
    header = lines.where("place = 0").first()
    if header is None:
        raise ValueError("no header")
    return header["words"], lines.where("place > 0")


def read_metis(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``vertices(id, vsize, vwgt)`` and ``edges(src, dst, w)`` in both directions, ids from 1.

    Header ``n m [fmt [ncon]]``; the digits of fmt say whether there are vertex
    sizes, vertex weights and edge weights.
    """
    header, lines = _lines(spark, path)
    n, m = int(header[0]), int(header[1])
    fmt = header[2].zfill(3) if len(header) > 2 else "000"
    sizes, weights, edge_weights = (c == "1" for c in fmt)
    ncon = int(header[3]) if len(header) > 3 else 1
    if not weights:
        ncon = 0
    skip = int(sizes) + ncon
    step = 2 if edge_weights else 1
    lines = lines.where(F.col("place") <= n)
    number = lambda c: c.cast("long")
    vertices = lines.select(
        F.col("place").alias("id"),
        (number(F.col("words")[0]) if sizes else F.lit(1).cast("long")).alias("vsize"),
        (F.transform(F.slice("words", 1 + int(sizes), ncon), number) if ncon else F.array(F.lit(1).cast("long"))).alias("vwgt"),
    )
    rest = F.slice("words", skip + 1, F.greatest(F.size("words") - skip, F.lit(0)))
    pairs = lines.select(F.col("place").alias("src"), F.posexplode(rest).alias("i", "x"), rest.alias("r")).where(F.col("i") % step == 0)
    edges = pairs.select("src", number(F.col("x")).alias("dst"), (F.element_at("r", F.col("i") + 2).cast("double") if edge_weights else F.lit(1.0)).alias("w"))
    if edges.count() != 2 * m:
        raise ValueError(f"the header promises {m} edges")
    return vertices, edges


def read_mesh(spark: SparkSession, path: str) -> DataFrame:
    """``(element, node)``, elements from 1."""
    _, lines = _lines(spark, path)
    return lines.select(F.col("place").alias("element"), F.explode("words").alias("x")).select("element", F.col("x").cast("long").alias("node"))


def read_matrix(spark: SparkSession, path: str, header: bool = True, values: bool = True, first: int = 1) -> DataFrame:
    """Rows of ``col val`` pairs (or columns alone): CLUTO text with a header, CSR text without. Numbers come from 0."""
    if header:
        _, lines = _lines(spark, path)
        lines = lines.withColumn("row", F.col("place") - 1)
    else:
        text = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), "value")
        lines = numbered(materialize(text, "lines"), [F.col("at")], "row").select("row", F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("words"))
    step = 2 if values else 1
    cells = lines.select("row", F.posexplode("words").alias("i", "x"), "words").where(F.col("i") % step == 0)
    return cells.select("row", (F.col("x").cast("long") - first).alias("col"), (F.element_at("words", F.col("i") + 2).cast("double") if values else F.lit(1.0)).alias("val"))


def parse_target_weights(text: str, parts: int, constraints: int = 1) -> list[list[float]]:
    """``from[-to][:constraint] = weight`` lines; what isn't named shares the rest evenly."""
    found: list[list[float | None]] = [[None] * constraints for _ in range(parts)]
    for line in filter(str.strip, text.splitlines()):
        left, _, weight = line.partition("=")
        span, _, con = left.partition(":")
        low, _, high = span.partition("-")
        for p in range(int(low), int(high or low) + 1):
            for c in [int(con)] if con.strip() else range(constraints):
                found[p][c] = float(weight)
    for c in range(constraints):
        rest = 1 - sum(f[c] or 0 for f in found)
        free = [f for f in found if f[c] is None]
        if rest < -1e-9 or free and rest <= 0:
            raise ValueError("target weights sum to over 1")
        for f in free:
            f[c] = rest / len(free)
    return [[float(x or 0) for x in f] for f in found]


# ---- sinks -------------------------------------------------------------------


def write_tsv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.option("sep", "\t").csv(path)


def write_parts(df: DataFrame, path: str) -> None:
    """One folder for each pid."""
    df.write.partitionBy("pid").option("sep", "\t").csv(path)


def write_metis(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Adjacency of ids 1..n with edge weights, as text in one file (the format has no other)."""
    near = edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", F.col("w").cast("long").alias("w")))).alias("a"))
    lines = vertices.select("id").join(near, F.col("id") == F.col("src"), "left").select("id", F.array_join(F.transform(F.coalesce("a", F.array().cast("array<struct<dst:bigint,w:bigint>>")), lambda x: F.concat_ws(" ", x["dst"], x["w"])), " ").alias("line"))
    head = f"{vertices.count()} {edges.count() // 2} 001"
    first = vertices.sparkSession.createDataFrame([(0, head)], "id long, line string")
    first.unionByName(lines).repartition(1).sortWithinPartitions("id").select("line").write.text(path)


def write_matrix(cells: DataFrame, path: str) -> None:
    """``row`` order lines of ``col val`` pairs, numbers from 1."""
    rows = cells.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "val"))).alias("a"))
    rows.orderBy("row").select(F.array_join(F.transform("a", lambda x: F.concat_ws(" ", x["col"] + 1, x["val"])), " ").alias("line")).write.text(path)
