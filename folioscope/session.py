"""Session helpers: a tuned builder for tests and benchmarks, and the lineage cut."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on at scale.  A cluster sets its own master, memory
# and shuffle partition count; AQE coalesces partitions and splits skewed joins.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(app: str = "folioscope", cpus: str | int = "*", partitions: int = 8,
                  memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(partitions))
               .config("spark.driver.memory", memory)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               # small local inputs still spread over all threads
               .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k"))
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL: dict[str, str] = {}   # folder of each local application without that setting


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master without that setting falls back to a temporary folder; a
    cluster must name a folder every executor can reach.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    # a local cluster has executors of their own, so only threads of this process may share such a folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="folioscope-")
    return _LOCAL[app]


def run_folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder; whoever runs it can drop it when it has ended."""
    return os.path.join(scratch_root(spark), f"run-{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, name: str = "cut", codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where one result feeds several branches of a plan, so that expensive
    upstream work (regular expressions, scoring) runs once and a lost executor
    costs one task and not the whole lineage.  ``codec`` "zstd" writes
    texts in two thirds of the bytes, for some hundred MB more of an executor's memory outside the heap.
    """
    spark = df.sparkSession
    path = os.path.join(run_folder(spark), f"{name}-{uuid.uuid4().hex}")
    writer = df.write.mode("errorifexists")
    (writer.option("compression", codec) if codec else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
