"""Session helpers: table access, the shared folder and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see.

    The cluster names it in ``spark.checkpoint.dir``; only in a local test
    session without that setting a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='weftgraph-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it again.

    The copy cuts the lineage, survives the loss of executors and gives later
    joins a plain scan on that side, which adaptive execution may split when
    a key is skewed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized frame that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = shared_dir(spark)
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if name.startswith(root) or name.replace("file:///", "file:/").startswith(root.replace("file:///", "file:/")):
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dealt(df: DataFrame, rows: int | None, *keys: str, each: int = 400_000) -> DataFrame:
    """Deal up to so many rows by keys into parts of about ``each``, however many partitions a session has by default.

    What follows needs no more memory in a task on larger tables, and an aggregation by the keys doesn't fill a map with
    rows that hardly ever meet before they are dealt.  Few or unknown rows are left to adaptive execution.
    """
    parts = -(-(rows or 0) // each)
    return df.repartition(parts, *keys) if parts > df.sparkSession.sparkContext.defaultParallelism else df


_DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it has run; else they stay until the driver collects its garbage."""
    before = spark.conf.get(_DROPPED)
    spark.conf.set(_DROPPED, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROPPED, before)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Bound the Arrow batches that Python workers get: texts can be long.

    Results are computed later, so the bound stays with the session; it is
    never raised.
    """
    if not 0 < int(spark.conf.get(_BATCH)) <= rows:
        spark.conf.set(_BATCH, str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """A bound for what is computed inside alone."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)
