"""Cubes: counts and exact sums per combination of attributes, from which breakdowns roll up.

A cube has as many rows as attribute values combine, not as there are orders or users. It is built in one
pass, parked, and then read by every breakdown; sums are decimals and longs, so a rolled-up
mean equals the mean over the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import daypart_of, month_label, month_start
from tidemark.functions.numeric import percent, ratio, rounded_if, scaled
from tidemark.operators import drivers
from tidemark.operators.impact import worst_first
from tidemark.operators.retention import LATE_SEGMENT, ON_TIME_SEGMENT

UNITS = 10**4  # that a measured double is summed in


def _measured(*names: str) -> list[Column]:
    return [
        part
        for name in names
        for part in (F.sum(scaled(name)).alias(name), F.count(name).alias(f"{name}_n"))
    ]


def _counted(*names: str) -> list[Column]:
    """Sums of money or flags, and how many values they are of."""
    return [
        part for name in names for part in (F.sum(name).alias(name), F.count(name).alias(f"{name}_n"))
    ]


def _mean(name: str) -> Column:
    return ratio(F.sum(name), F.sum(f"{name}_n"))


def _measured_mean(name: str) -> Column:
    return ratio(F.sum(name), F.sum(f"{name}_n") * F.lit(UNITS))


def _share(name: str) -> Column:
    return F.lit(100.0) * _mean(name)


# orders


def order_cells(orders: DataFrame) -> DataFrame:
    """Orders by month, hour, city, platform and status."""
    return orders.withColumn("net", F.col("gmv") - F.col("discount")).groupBy(
        month_start("order_ts").alias("month"),
        F.hour("order_ts").alias("hour"),
        "city",
        "platform",
        "status",
    ).agg(
        F.count("*").alias("n"),
        *_counted("gmv", "discount", "net", "is_late"),
        *_measured("delivery_minutes", "rating"),
    )


def _delivered(cells: DataFrame) -> DataFrame:
    return cells.filter(F.col("status") == "delivered")


def late_by_city_hour(cells: DataFrame) -> DataFrame:
    return (
        _delivered(cells)
        .groupBy("city", daypart_of(F.col("hour")).alias("daypart"))
        .agg(
            F.sum("n").alias("orders"),
            F.round(_share("is_late"), 1).alias("late_rate_pct"),
            F.round(_measured_mean("delivery_minutes"), 1).alias("avg_minutes"),
        )
    )


def hour_of_day(cells: DataFrame) -> DataFrame:
    return _delivered(cells).groupBy("hour").agg(F.sum("n").alias("orders"))


def guardrails(cells: DataFrame) -> DataFrame:
    cancelled = F.sum(F.when(F.col("status") == "cancelled", F.col("n")).otherwise(0))
    return (
        cells.groupBy("month")
        .agg(
            (F.lit(100.0) * ratio(cancelled, F.sum("n"))).alias("cancel_pct"),
            _measured_mean("delivery_minutes").alias("minutes"),
            _measured_mean("rating").alias("rating_mean"),
            percent(F.sum("discount"), F.sum("gmv")).alias("discount_pct"),
            _mean("net").alias("net_mean"),
        )
        .select(
            month_label("month").alias("month"),
            F.round("cancel_pct", 2).alias("cancel_rate_pct"),
            F.round("minutes", 1).alias("avg_delivery_min"),
            F.round("rating_mean", 2).alias("avg_rating"),
            F.round("discount_pct", 1).alias("discount_pct_of_gmv"),
            F.round("net_mean", 0).alias("net_revenue_per_order"),
        )
    )


def value_and_worst_cells(cells: DataFrame, k: int = 2) -> DataFrame:
    """One row: ``aov`` of delivered orders, and the ``k`` city and daypart cells with the highest late rate.
    There are three cells per city."""
    by_cell = (
        _delivered(cells)
        .groupBy("city", daypart_of(F.col("hour")).alias("daypart"))
        .agg(
            F.sum("gmv").alias("gmv"),
            F.sum("gmv_n").alias("gmv_n"),
            F.round(_share("is_late"), 1).alias("late_rate_pct"),
        )
    )
    return by_cell.agg(
        _mean("gmv").alias("aov"), F.slice(worst_first(), 1, k).alias("lateness_worst_cells")
    )


# first orders


def first_order_cells(features: DataFrame, days: int = 30) -> DataFrame:
    """First-order features by city, channel, membership, platform, lateness, lateness bucket and rating band."""
    return features.groupBy(
        *drivers.STRATA,
        "is_late",
        drivers.lateness_bucket().alias("lateness_bucket"),
        drivers.rating_band().alias("rating_band"),
    ).agg(
        F.count("*").alias("n"), F.sum(f"repeated_{days}d").alias("x"), *_measured("rating")
    )


def _repeat_pct(days: int) -> Column:
    return F.round(F.lit(100.0) * ratio(F.sum("x"), F.sum("n")), 2).alias(f"repeat_{days}d_pct")


def _late_and_on_time(**conditions: Column) -> list[Column]:
    return [
        F.sum(F.when(condition, F.col(value)).otherwise(0)).alias(f"{value}_{side}")
        for side, condition in conditions.items()
        for value in ("n", "x")
    ]


def repeat_by_late(cells: DataFrame, days: int = 30) -> DataFrame:
    label = F.when(F.col("is_late") == 1, "Late").otherwise("On time")
    return cells.groupBy(label.alias("first_delivery")).agg(
        F.sum("n").alias("users"), _repeat_pct(days)
    )


def late_gap_test(cells: DataFrame) -> DataFrame:
    late = F.coalesce(F.col("is_late") == 1, F.lit(False))
    counts = cells.agg(*_late_and_on_time(late=late, on_time=~late))
    return drivers.gap_test(counts.select(*[F.col(c).cast("double") for c in counts.columns]))


def repeat_by_late_stratified(
    cells: DataFrame, min_cell: int = 20, rounded: bool = True
) -> DataFrame:
    sides = _late_and_on_time(late=F.col("is_late") == 1, on_time=F.col("is_late") == 0)
    return drivers.weighted_gap(cells.groupBy(*drivers.STRATA).agg(*sides), min_cell, rounded)


def dose_response(cells: DataFrame, days: int = 30) -> DataFrame:
    return cells.groupBy("lateness_bucket").agg(
        F.sum("n").alias("users"),
        F.round(_measured_mean("rating"), 2).alias("avg_first_rating"),
        _repeat_pct(days),
    )


def repeat_by_segment(cells: DataFrame) -> DataFrame:
    dimensions = {
        "city": F.col("city"),
        "channel": F.col("acquisition_channel"),
        "platform": F.col("platform"),
        "member": drivers.membership(),
        "first_rating": F.col("rating_band"),
    }
    named = cells.select("n", "x", *[value.alias(name) for name, value in dimensions.items()])
    return drivers.one_way(named, list(dimensions))


# experiments


def experiment_cells(assignments: DataFrame, orders: DataFrame, days: int = 14) -> DataFrame:
    """Experiment users by arm and lateness of the first delivery, with traits of the first order and
    outcomes of the second. ``found`` is false for users whose first order is not among ``orders``."""
    firsts = orders.select(
        F.col("order_id").alias("first_order_id"), "gmv", "is_late", "rating", F.lit(True).alias("found")
    )
    return (
        assignments.join(firsts, "first_order_id", "left")
        .groupBy("variant", F.coalesce("found", F.lit(False)).alias("found"), "is_late")
        .agg(
            F.count("*").alias("n"),
            F.sum(f"repeat_within_{days}d").alias("conversions"),
            F.sum("coupon_cost").alias("coupon_cost"),
            *_counted("gmv", "second_order_cancelled"),
            *_measured("rating", "second_order_aov"),
        )
    )


def srm_check(cells: DataFrame) -> DataFrame:
    arms = cells.groupBy("variant").agg(F.sum("n").alias("users"))
    return arms.withColumn("pct", F.round(percent("users", F.sum("users").over(Window.partitionBy())), 2))


def ab_primary(cells: DataFrame, days: int = 14) -> DataFrame:
    return cells.groupBy("variant").agg(*_rate(days, 3))


def _rate(days: int, places: int) -> list[Column]:
    rate = F.lit(100.0) * ratio(F.sum("conversions"), F.sum("n"))
    return [
        F.sum("n").alias("n"),
        F.sum("conversions").alias("conversions"),
        F.round(rate, places).alias(f"repeat_{days}d_pct"),
    ]


def ab_by_segment(cells: DataFrame, days: int = 14) -> DataFrame:
    segment = F.when(F.col("is_late") == 1, LATE_SEGMENT).otherwise(ON_TIME_SEGMENT)
    return cells.filter("found").groupBy(segment.alias("segment"), "variant").agg(*_rate(days, 2))


def ab_balance(cells: DataFrame) -> DataFrame:
    late = F.sum(F.when(F.col("is_late").isNotNull(), F.col("is_late") * F.col("n")))
    known = F.sum(F.when(F.col("is_late").isNotNull(), F.col("n")).otherwise(0))
    return cells.filter("found").groupBy("variant").agg(
        F.sum("n").alias("users"),
        F.round(_mean("gmv"), 1).alias("first_order_aov"),
        F.round(F.lit(100.0) * ratio(late, known), 2).alias("first_late_pct"),
        F.round(_measured_mean("rating"), 3).alias("first_rating"),
    )


def ab_guardrails(cells: DataFrame, rounded: bool = True) -> DataFrame:
    return cells.groupBy("variant").agg(
        F.sum("n").alias("n"),
        rounded_if(rounded, _measured_mean("second_order_aov"), 1).alias("second_order_aov"),
        rounded_if(rounded, _share("second_order_cancelled"), 2).alias("second_cancel_pct"),
        rounded_if(rounded, F.sum("coupon_cost"), 0).alias("total_coupon_cost"),
    )
