"""Cutting lineage through tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether shuffle files are removed when the execution that wrote them ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in a local session without one, a temporary folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set")
        own = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read back.

    What follows reads the table and so needs neither the lineage nor the shuffle files of df, whichever
    executors are lost meanwhile. Files stay until the folder is emptied; shuffle files of the write go when it ends, since
    else all of a job's stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before) if before is not None else spark.conf.unset(SHUFFLE_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def spread(table: DataFrame) -> DataFrame:
    """A table that is read, dealt to all cores if one split could hold it: small files are often a single row group, which a single task reads.

    For work that is heavy by the row. Larger tables have splits enough and stay as they lie, without a shuffle.
    """
    spark = table.sparkSession
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return table.repartition(spark.sparkContext.defaultParallelism) if size <= split else table
