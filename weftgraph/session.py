"""Session settings the library is tuned for; on a cluster the submitter's settings win."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(name: str = "weftgraph", cpus: str | None = None, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.appName(name).master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers: once for each Spark application, as a
    zip that Spark's own file server hands out.

    Rows can hold long texts, and an Arrow batch is held several times over by the JVM and by Python; where
    the session keeps Spark's default of 64 MB a batch, it is lowered to 8 MB."""
    sc, size = spark.sparkContext, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size, "64m") in ("67108864b", "67108864", "64MB", "64m"):
        spark.conf.set(size, "8m")
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="weftgraph-"), "weftgraph.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("weftgraph", os.path.relpath(full, here)))
    sc.addPyFile(path)
    _shipped[sc.applicationId] = path
