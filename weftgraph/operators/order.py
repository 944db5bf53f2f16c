"""Totals along a global order, without one task that sees all rows.

Rows are dealt by ranges of the order; each range sums its own rows, and what
stands before a range comes from one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import materialize


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds inclusive running totals of ``sums`` along ``order``."""
    df = df.withColumns({f"_{k}": v for k, v in sums.items()})
    df = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "running")
    local = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = df.groupBy("_part").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as shuffle partitions
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in sums])
    out = df.withColumns({k: F.sum(f"_{k}").over(local) for k in sums}).join(F.broadcast(offsets), "_part")
    out = out.withColumns({k: F.col(k) + F.col(f"_before_{k}") for k in sums})
    return out.drop("_part", *[f"_{k}" for k in sums], *[f"_before_{k}" for k in sums])


def numbered(df: DataFrame, order: list[Column], name: str = "index") -> DataFrame:
    """Adds a dense number from 0 along the order."""
    return running(df, order, {name: F.lit(1)}).withColumn(name, (F.col(name) - 1).cast("long"))
