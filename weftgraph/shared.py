"""The folder that all executors share, and tables staged in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share. Where the session names none, a temporary one serves a
    local session; on a cluster that is an error, since executors could not see each other's files."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("weftgraph.shared.dir", "")
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='weftgraph-')}"
        spark.conf.set("weftgraph.shared.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a narrow intermediate table to the shared folder and read it back: it is made once, its lineage
    is cut, and it survives the loss of any executor."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*staged: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more; other frames are left alone."""
    for df in staged:
        path = getattr(df, "staged_at", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of frames that nothing reads any more: it learns of them when the
    driver's memory is tidied, which a driver with little to do may not do for half an hour."""
    spark._jvm.System.gc()


#: Rows that a task of a wide step takes.
TASK_ROWS = 500_000


def tasks(spark: SparkSession, rows: int, per_task: int = TASK_ROWS) -> int:
    """Partitions for so many rows, so that a task's share does not grow with the input; one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // per_task))


def looked_up(rows: DataFrame) -> DataFrame:
    """A table of nodes as the built side of a join with edges: a task holds its share of the nodes, and the edges, of
    which there are many times more, stream past it unsorted."""
    return rows.hint("shuffle_hash")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting while a table is staged."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def in_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """The rows dealt into ranges of an order, with `part`, the number of the range. Staged: whatever reads them sees
    the same ranges, also after an executor is lost."""
    return stage(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with `line` from 1, in order. Rows are numbered within ranges of the order and added to the
    sizes of the ranges before, so no task holds all rows."""
    ranged = in_ranges(rows, *order)
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # as many rows as partitions
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("line", F.col("before") + F.col("inside")).drop("part", "before", "inside")
