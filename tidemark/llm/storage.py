"""Files of the operators' own formats, written and read by tasks on shared storage.

Files go below the folder that the session names in ``spark.checkpoint.dir``. A task
writes under a name of its own, and only the rows that a finished task returns name its
file, so a lost executor or a second attempt leaves no wrong file in use.
"""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.scratch import scratch_path

__all__ = ["park", "release", "scratch_path", "output_file", "input_file", "crc_words", "tasks_import", "slices"]


def park(frame: DataFrame, label: str) -> DataFrame:
    """``frame`` written once as a table of the shared folder, and a scan of it that :func:`release` can void."""
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    parked = spark.read.schema(frame.schema).parquet(path)
    parked._folder = path
    return parked


def release(spark: SparkSession, *parked: DataFrame) -> None:
    """Delete parked tables whose successors are written, and let Spark drop the shuffle files of jobs that
    nothing refers to any more; it does so when the driver collects its garbage. Frames that read
    these tables are void then."""
    for frame in parked:
        path = spark._jvm.org.apache.hadoop.fs.Path(frame._folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def tasks_import(spark: SparkSession) -> None:
    """Let Python workers of this session import the package from the folder the driver has it in."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if here not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([here, *filter(None, paths)])


def output_file(folder: str, label: str) -> tuple[str, pa.NativeFile]:
    """A new file below ``folder``, and its path."""
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    system, inner = fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    return path, system.open_output_stream(inner, compression=None)


def input_file(path: str) -> pa.NativeFile:
    """``path`` for reading at any offset."""
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def crc_words(ids: np.ndarray, before: int = 0) -> int:
    """crc32 of the ids as little-endian unsigned 32-bit words."""
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes(), before)


def slices(batches: Iterator[pa.RecordBatch], rows: int, nbytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most ``rows`` rows and about ``nbytes`` bytes (one row at least)."""
    for batch in batches:
        per_row = max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, min(rows, nbytes // per_row))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def count_rows(frame: DataFrame) -> int:
    return frame.count()
