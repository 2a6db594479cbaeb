"""Per-user operators over a table of user days, bucketed and sorted by user.

One row per user and day of delivered orders: however many orders a user has, there are no more rows than days, and
partial sums make them in the map tasks. Stored in buckets by user, such a table serves all
per-user steps without another shuffle: what is grouped or windowed by user lies together already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import day_of, month_number
from tidemark.operators import retention, segments
from tidemark.operators.first_orders import delivered, flags_of_slots, slots_of, with_user

USER = "user_id"


def user_days(orders: DataFrame) -> DataFrame:
    """user_id, day, earliest, latest, n, gmv of each user's delivered orders by day. Orders without a user_id
    have no history and are left out, as the per-user operators do."""
    return (
        with_user(delivered(orders))
        .groupBy(USER, day_of("order_ts").alias("day"))
        .agg(
            F.min("order_ts").alias("earliest"),
            F.max("order_ts").alias("latest"),
            F.count("*").alias("n"),
            F.sum("gmv").alias("gmv"),
        )
    )


def merged_days(days: DataFrame, more: DataFrame) -> DataFrame:
    """The user days of two sets of orders that have none in common, as of one."""
    kinds = dict(days.dtypes)
    return (
        days.unionByName(more)
        .groupBy(USER, "day")
        .agg(
            F.min("earliest").alias("earliest"),
            F.max("latest").alias("latest"),
            F.sum("n").alias("n"),
            F.sum("gmv").cast(kinds["gmv"]).alias("gmv"),
        )
    )


def write_by_user(frame: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Save ``frame`` at ``path`` as the table ``table``, in ``buckets`` files by user, each sorted by user; the table."""
    (
        frame.repartition(buckets, USER)
        .write.mode("overwrite")
        .bucketBy(buckets, USER)
        .sortBy(USER)
        .option("path", path)
        .saveAsTable(table)
    )
    return frame.sparkSession.table(table)


def register_by_user(spark: SparkSession, table: str, path: str, schema: str, buckets: int) -> DataFrame:
    """Make a table that another session has saved known to this one, with its buckets."""
    spark.sql(
        f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({USER}) SORTED BY ({USER}) "
        f"INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)


def repeat_flags(days: DataFrame, as_of, window_days: int = 30) -> DataFrame:
    """As :func:`tidemark.operators.first_orders.repeat_flags` makes it from orders."""
    slots = slots_of(days, "earliest", "latest", F.sum("n"), window_days)
    return flags_of_slots(slots, as_of, window_days)


def cohort_matrix(days: DataFrame) -> DataFrame:
    """As :func:`tidemark.operators.retention.cohort_matrix` makes it from orders."""
    return retention.matrix_of_months(days.select(USER, month_number("day").alias("month")).distinct())


def rfm_scores(days: DataFrame, as_of) -> DataFrame:
    """As :func:`tidemark.operators.segments.rfm_scores` makes it from orders, for users with a user_id."""
    users = days.groupBy(USER).agg(
        F.max("latest").alias("last_ts"), F.sum("n").alias("frequency"), F.sum("gmv").alias("monetary")
    )
    return segments.scores_of_users(users, as_of)
