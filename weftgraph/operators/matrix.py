"""Sparse matrices as ``cells(row, col, val)``; zero cells aren't stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import materialize
from .order import numbered


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def submatrix(m: DataFrame, first_row: int, rows: int) -> DataFrame:
    return m.where(F.col("row").between(first_row, first_row + rows - 1))


def prune(m: DataFrame, least: int, most: int, what: str = "col") -> DataFrame:
    """Keep columns (rows) that have between least and most cells."""
    keep = m.groupBy(what).count().where(F.col("count").between(least, most)).select(what)
    return m.join(keep, what, "left_semi").select("row", "col", "val")


def low_filter(m: DataFrame, fraction: float, norm: int = 2, what: str = "row") -> DataFrame:
    """Of each row the largest cells, as long as those before them hold at most a fraction of the row's norm."""
    other = "col" if what == "row" else "row"
    size = F.abs("val") if norm == 1 else F.col("val") * F.col("val")
    order = Window.partitionBy(what).orderBy(F.desc("val"), other).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(order), F.lit(0.0))
    total = F.sum(size).over(Window.partitionBy(what))
    root = (lambda x: x) if norm == 1 else F.sqrt
    return m.withColumn("_keep", root(before) <= fraction * root(total)).where("_keep").select("row", "col", "val")


def topk_plus(m: DataFrame, k: int, keep: float, what: str = "row") -> DataFrame:
    """Of each row the k largest cells, and all others of at least keep."""
    other = "col" if what == "row" else "row"
    place = F.row_number().over(Window.partitionBy(what).orderBy(F.desc("val"), other))
    return m.withColumn("_r", place).where((F.col("_r") <= k) | (F.col("val") >= keep)).select("row", "col", "val")


def zscore_filter(m: DataFrame, z: float) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("row"))
    return m.withColumn("_n", n).where(F.col("val") > z / F.col("_n")).select("row", "col", "val")


def compact_columns(m: DataFrame) -> DataFrame:
    """Columns numbered from 0, the fullest first."""
    places = numbered(m.groupBy("col").count(), [F.desc("count"), F.col("col")], "place").select("col", "place")
    return m.join(places, "col").select("row", F.col("place").alias("col"), "val")


def normalize(m: DataFrame, norm: int = 2, what: str = "row") -> DataFrame:
    over = Window.partitionBy(what)
    size = F.sum(F.abs("val")).over(over) if norm == 1 else F.sqrt(F.sum(F.col("val") * F.col("val")).over(over))
    return m.withColumn("_s", size).select("row", "col", F.when(F.col("_s") > 0, F.col("val") / F.col("_s")).otherwise(F.col("val")).alias("val"))


def scale(m: DataFrame, how: str, n_rows: int | None = None) -> DataFrame:
    """how: maxtf, maxtf2, sqrt, pow25, pow65, pow75, pow85, log, idf, idf2."""
    v = F.col("val")
    sign = F.when(v < 0, -1.0).otherwise(1.0)
    if how in ("maxtf", "maxtf2"):
        top = F.max(F.abs("val")).over(Window.partitionBy("row"))
        low = 0.5 if how == "maxtf" else 0.1
        return m.withColumn("_m", top).select("row", "col", (low + (1 - low) * v / F.col("_m")).alias("val"))
    if how in ("idf", "idf2"):
        m = materialize(m, "scale")  # read three times
        n = m.select("row").distinct().count() if n_rows is None else n_rows
        df = m.groupBy("col").agg(F.count("*").alias("df"))
        if how == "idf":
            weight = F.log(F.lit(float(n)) / F.col("df"))
        else:
            sizes = df.agg(F.sum("df").alias("nnz"), F.count("*").alias("used")).first()
            b = max(10, int(0.5 * (sizes["nnz"] or 0) / max(sizes["used"], 1)))
            weight = F.log((n + 2.0 * b) / (b + F.col("df")))
        return m.join(df, "col").select("row", "col", (v * weight).alias("val"))
    if how == "log":
        new = F.when(v == 0, v).otherwise(sign * (1 + F.log2(F.abs(v))))
    elif how == "sqrt":
        new = F.when(v == 0, v).otherwise(0.1 + sign * F.sqrt(F.abs(v)))
    else:
        new = F.when(v == 0, v).otherwise(0.1 + sign * F.pow(F.abs(v), F.lit(int(how[3:]) / 100)))
    return m.select("row", "col", new.alias("val"))


def sums(m: DataFrame, what: str = "row") -> DataFrame:
    """Sums and squared norms of rows or columns."""
    return m.groupBy(what).agg(F.sum("val").alias("total"), F.sum(F.col("val") * F.col("val")).alias("squared_norm"))


MEASURES = ("cos", "jac", "min", "amin")


def similar_rows(m: DataFrame, query: DataFrame, measure: str = "cos", least: float = 0.0, k: int | None = None) -> DataFrame:
    """``(row, sim)`` of all rows against one query(col, val), best first; norms are of whole rows."""
    q = query.select("col", F.col("val").alias("q"))
    size = {"cos": lambda x: x * x, "jac": lambda x: x * x, "min": F.abs, "amin": F.abs}[measure]
    total = q.agg(F.sum(size(F.col("q")))).first()[0] or 0.0
    norms = m.groupBy("row").agg(F.sum(size(F.col("val"))).alias("n"))
    part = F.col("val") * F.col("q") if measure in ("cos", "jac") else F.least(F.col("val"), F.col("q"))
    met = m.join(q, "col").groupBy("row").agg(F.sum(part).alias("s")).join(norms, "row")
    s, n = F.col("s"), F.col("n")
    sim = {"cos": s / F.sqrt(n * total), "jac": s / (n + total - s), "min": s / (n + total - s), "amin": s / total if total else s * 0}[measure]
    out = met.where("n > 0").select("row", sim.alias("sim")).where(F.col("sim") >= least)
    return out if k is None else out.orderBy(F.desc("sim"), "row").limit(k)


def row_similarity(m: DataFrame, pairs: DataFrame, measure: str = "cos") -> DataFrame:
    """``(row, row2, sim)`` for pairs of rows."""
    size = (lambda x: x * x) if measure in ("cos", "jac") else F.abs
    norms = m.groupBy("row").agg(F.sum(size(F.col("val"))).alias("n"))
    left = pairs.join(m, "row").select("row", "row2", "col", "val")
    met = left.join(m.select(F.col("row").alias("row2"), "col", F.col("val").alias("q")), ["row2", "col"])
    part = F.col("val") * F.col("q") if measure in ("cos", "jac") else F.least(F.col("val"), F.col("q"))
    s = met.groupBy("row", "row2").agg(F.sum(part).alias("s"))
    both = pairs.join(s, ["row", "row2"], "left").join(norms, "row").join(norms.select(F.col("row").alias("row2"), F.col("n").alias("n2")), "row2")
    s, n, t = F.coalesce("s", F.lit(0.0)), F.col("n"), F.col("n2")
    sim = {"cos": s / F.sqrt(n * t), "jac": s / (n + t - s), "min": s / (n + t - s), "amin": s / t}[measure]
    return both.select("row", "row2", sim.alias("sim"))


def itemsets(baskets: DataFrame, least: int, size: int) -> DataFrame:
    """``(items, support)`` of baskets(basket, item): sets of ``size`` items that at least so many baskets have.

    Level by level; a set is tried only if all its parts are frequent.
    """
    b = baskets.distinct()
    frequent = b.groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= least)
    b = b.join(frequent.select("item"), "item", "left_semi")
    level = b.select("basket", F.array("item").alias("items"), F.col("item").alias("last"))
    found = frequent.select(F.array("item").alias("items"), F.col("support"))
    for _ in range(size - 1):
        longer = level.join(b, "basket").where(F.col("item") > F.col("last")).select("basket", F.array_append("items", F.col("item")).alias("items"), F.col("item").alias("last"))
        found = longer.groupBy("items").agg(F.count("*").alias("support")).where(F.col("support") >= least)
        level = longer.join(found.select("items"), "items", "left_semi")
    return found


def itemsets_between(baskets: DataFrame, least: int, most: int, shortest: int, longest: int, with_baskets: bool = False) -> DataFrame:
    """``(items, support)``, with their baskets on demand: sets of ``shortest`` to ``longest`` items that ``least`` to ``most`` baskets have.

    A single item of more than ``most`` baskets is left out of all sets; longer
    sets have no more baskets than their items.
    """
    b = baskets.distinct()
    frequent = b.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n").between(least, most))
    b = b.join(frequent.select("item"), "item", "left_semi")
    level, out = b.select("basket", F.array("item").alias("items"), F.col("item").alias("last")), None
    for size in range(1, longest + 1):
        if size > 1:
            level = level.join(b, "basket").where(F.col("item") > F.col("last")).select("basket", F.array_append("items", F.col("item")).alias("items"), F.col("item").alias("last"))
        counts = [F.count("*").alias("support"), *([F.sort_array(F.collect_list("basket")).alias("baskets")] if with_baskets else [])]
        found = level.groupBy("items").agg(*counts).where(F.col("support") >= least)
        level = level.join(found.select("items"), "items", "left_semi")
        if size >= shortest:
            out = found if out is None else out.unionByName(found)
    return out


def top_columns(m: DataFrame, k: int) -> DataFrame:
    """The k largest cells of each column; ties by row."""
    return topk_plus(m, k, float("inf"), "col")


def merged(m: DataFrame, rows: DataFrame) -> DataFrame:
    """``(color, row, col, val)``: a matrix split by rows(row, color)."""
    return m.join(rows, "row").select("color", "row", "col", "val")
