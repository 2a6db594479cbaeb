"""Monthly cohort retention.

Both curves count users per (cohort, months since the first order). Histories
are reduced to one row per user and month before anything is grouped by user
alone, so a per-user window holds at most as many rows as the data has months.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import month_number, month_number_label
from tidemark.functions.numeric import percent
from tidemark.operators.first_orders import by_user, delivered, with_user

LATE_SEGMENT = "First delivery LATE"
ON_TIME_SEGMENT = "First delivery ON TIME"


def _curve(active: DataFrame, cohort: str) -> DataFrame:
    """cohort, period, active_users, cohort_size from one row per user and month.

    All users of a cohort are active in period 0, so its size is read off that
    period instead of being counted again and joined.
    """
    counts = active.groupBy(cohort, "period_index").agg(F.count("*").alias("active_users"))
    at_start = F.when(F.col("period_index") == 0, F.col("active_users"))
    return counts.withColumn("cohort_size", F.max(at_start).over(Window.partitionBy(cohort)))


def cohort_matrix(orders: DataFrame) -> DataFrame:
    """Share of each first-order month's users who ordered k calendar months later.
    Orders without a user_id belong to no cohort."""
    months = (
        with_user(delivered(orders))
        .select("user_id", month_number("order_ts").alias("month"))
        .distinct()
    )
    return matrix_of_months(months)


def matrix_of_months(months: DataFrame) -> DataFrame:
    """The matrix from user_id and month, one row for each month in which a user ordered."""
    active = months.withColumn("cohort", F.min("month").over(by_user())).withColumn(
        "period_index", F.col("month") - F.col("cohort")
    )
    return _curve(active, "cohort").select(
        month_number_label("cohort").alias("cohort_month"),
        "cohort_size",
        "period_index",
        "active_users",
        F.round(percent("active_users", "cohort_size"), 1).alias("retention_pct"),
    )


def observed_periods(matrix: DataFrame) -> range:
    """All periods from the earliest cohort's month to the latest month in ``matrix``:
    one aggregate, one row, whatever the number of orders."""
    month = F.col("cohort_month")
    start = F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int")
    first, last = matrix.agg(F.min(start), F.max(start + F.col("period_index"))).first()
    return range(0 if first is None else last - first + 1)


def cohort_pivot(
    matrix: DataFrame, periods: Sequence[int] | None = None, fill: float | None = None
) -> DataFrame:
    """One row per cohort, one column m0, m1, ... per period: those given, or all that the
    months of ``matrix`` allow. A period that was not observed stays NULL unless ``fill``
    is given."""
    if periods is None:
        periods = observed_periods(matrix)
    wide = (
        matrix.groupBy("cohort_month", "cohort_size")
        .pivot("period_index", list(periods))
        .agg(F.first("retention_pct"))
    )
    named = wide.select(
        "cohort_month", "cohort_size", *[F.col(f"`{k}`").alias(f"m{k}") for k in periods]
    )
    return named if fill is None else named.na.fill(fill, [f"m{k}" for k in periods])


def cohort_by_late(orders: DataFrame) -> DataFrame:
    """Retention by whether the first delivery was late.

    The flag is the highest ``is_late`` among all orders, of any status, that
    share the user's first delivered timestamp; users without a known flag drop
    out. Grouping by user and timestamp settles those ties and spreads a busy
    user over many tasks; the month and user levels above it are small.
    """
    per_instant = (
        with_user(orders).groupBy("user_id", "order_ts")
        .agg(
            F.max(F.when(F.col("status") == "delivered", 1).otherwise(0)).alias("has_delivered"),
            F.max("is_late").alias("late"),
        )
        .filter(F.col("has_delivered") == 1)
    )
    per_month = per_instant.groupBy("user_id", month_number("order_ts").alias("month")).agg(
        F.min("order_ts").alias("first_in_month"),
        F.min_by("late", "order_ts").alias("late_in_month"),
    )
    active = (
        per_month.withColumn("first_late", F.min_by("late_in_month", "first_in_month").over(by_user()))
        .withColumn("period_index", F.col("month") - F.min("month").over(by_user()))
        .filter(F.col("first_late").isNotNull())
    )
    segment = F.when(F.col("first_late") == 1, LATE_SEGMENT).otherwise(ON_TIME_SEGMENT)
    return _curve(active, "first_late").select(
        segment.alias("segment"),
        "period_index",
        F.round(percent("active_users", "cohort_size"), 1).alias("retention_pct"),
        "cohort_size",
    )


def cohort_by_late_pivot(curve: DataFrame) -> DataFrame:
    """One row per period, one column per segment."""
    return (
        curve.groupBy("period_index")
        .pivot("segment", [LATE_SEGMENT, ON_TIME_SEGMENT])
        .agg(F.first("retention_pct"))
        .select(
            "period_index",
            F.col(f"`{LATE_SEGMENT}`").alias("first_delivery_late"),
            F.col(f"`{ON_TIME_SEGMENT}`").alias("first_delivery_on_time"),
        )
    )
