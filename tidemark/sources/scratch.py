"""Intermediate tables on shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``; without that setting the session's
    warehouse, unless executors on other machines would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        on_disk = "://" not in root or root.startswith("file:")
        if on_disk and not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Delete everything that this application has parked. Frames that read it are void then."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def park(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` once as Parquet and hand back a scan of it.

    This cuts lineage on storage that outlives executors, and later readers
    still prune columns and push filters down.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
