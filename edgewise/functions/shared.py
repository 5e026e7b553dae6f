"""The cluster's shared folder, written tables that cut lineage, and the size of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a local master where it is unset (tests), a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Rows in one Arrow batch. Texts can be long, so a batch is kept small.
ARROW_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch so that long texts fit a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs inside deletes its shuffle files when it ends, not when the driver collects garbage: for rounds that write their tables."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/edgewise-{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str = "table", path: str | None = None, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    A lost executor re-reads the table and never repeats the work before it.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``fresh_path`` that no later step reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
