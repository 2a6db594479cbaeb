"""Tables partitioned by the week of a time, so that one week is read without the others."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from tidemark.functions.calendar import week_start

WEEK = "order_week"


def write_by_week(
    frame: DataFrame, path: str, ts: str = "order_ts", name: str = WEEK, only_touched: bool = False
) -> None:
    """Write ``frame`` with one folder per Monday, in a column ``name`` made from ``ts``. Rows are
    rebalanced by week first: a week of few rows is one file, and one of very many is split.
    ``only_touched`` replaces the weeks that occur in ``frame`` and leaves the others. Rows without a time go to
    a folder of their own."""
    if name in frame.columns:
        raise ValueError(f"{name} is a column already")
    mode = "dynamic" if only_touched else "static"
    (
        frame.withColumn(name, week_start(ts))
        .hint("rebalance", F.col(name))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", mode)
        .partitionBy(name)
        .parquet(path)
    )


def read_by_week(
    spark: SparkSession,
    path: str,
    schema: StructType,
    name: str = WEEK,
    weeks: Iterable[dt.date] | None = None,
) -> DataFrame:
    """The table with its week column; with ``weeks`` only these Mondays' folders are listed in the plan."""
    table = spark.read.schema(StructType([*schema.fields, StructField(name, DateType())])).parquet(path)
    if weeks is None:
        return table
    return table.filter(F.col(name).isin([F.lit(str(week)).cast("date") for week in weeks]))
