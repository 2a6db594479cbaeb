"""What drives the second order: features of the first order, raw and adjusted
comparisons, dose response, one-way breakdowns, and where lateness sits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import DAYPARTS, daypart
from tidemark.functions.numeric import (
    measured_mean,
    percent_of_flags,
    ratio,
    rounded_if,
)
from tidemark.functions.statistics import pooled_z, two_sided_p
from tidemark.operators.first_orders import delivered, repeat_flags

# Labels of the lateness buckets and rating bands, in order.
LATENESS_LABELS = (
    "1. Early / on time",
    "2. 0-10 min late",
    "3. 10-20 min late",
    "4. 20-30 min late",
    "5. 30+ min late",
)
RATING_BANDS = ((4.5, "4.5-5.0"), (3.5, "3.5-4.0"))
LOWEST_BAND = "<3.5"
STRATA = ("city", "acquisition_channel", "is_member", "platform")


def first_order_features(
    users: DataFrame,
    orders: DataFrame,
    as_of,
    days: int = 30,
    ties: str = "all",
    firsts: DataFrame | None = None,
) -> DataFrame:
    """One row per matured user: attributes of the first delivered order, of the
    user, and whether the user came back within ``days``. ``firsts`` hands in the
    result of ``repeat_flags`` where it is already at hand.

    The first order is found again by its timestamp, whatever its status, so
    orders that share it all appear; ``ties="first"`` keeps the one with the
    lowest order_id. The join on user and time spreads even a user with a huge
    history, and only that user's orders at one instant can match.
    """
    if firsts is None:
        firsts = repeat_flags(orders, as_of, days)
    firsts = firsts.withColumnRenamed("repeated", f"repeated_{days}d")
    attributes = orders.select(
        "user_id",
        F.col("order_ts").alias("first_ts"),
        "order_id",
        "city",
        "platform",
        "is_late",
        "rating",
        "delivery_minutes",
        "promised_minutes",
    )
    matched = attributes.join(firsts, ["user_id", "first_ts"])
    if ties == "first":
        by_id = Window.partitionBy("user_id").orderBy("order_id")
        matched = matched.withColumn("tie", F.row_number().over(by_id)).filter(F.col("tie") == 1)
    elif ties != "all":
        raise ValueError("ties must be 'all' or 'first'")
    overrun = F.col("delivery_minutes") - F.col("promised_minutes")
    return matched.join(
        users.select("user_id", "acquisition_channel", "is_member"), "user_id"
    ).select(
        "user_id",
        "first_ts",
        "city",
        "platform",
        "is_late",
        "rating",
        "delivery_minutes",
        "promised_minutes",
        "acquisition_channel",
        "is_member",
        f"repeated_{days}d",
        F.round(overrun, 1).alias("minutes_late"),
    )


def _repeated(days: int) -> str:
    return f"repeated_{days}d"


def repeat_by_late(features: DataFrame, days: int = 30) -> DataFrame:
    """Repeat rate by lateness of the first delivery; unknown counts as on time.
    ``days`` is the window that the features were built with, here and below."""
    label = F.when(F.col("is_late") == 1, "Late").otherwise("On time")
    return features.groupBy(label.alias("first_delivery")).agg(
        F.count("*").alias("users"),
        F.round(percent_of_flags(_repeated(days)), 2).alias(f"repeat_{days}d_pct"),
    )


def late_gap_test(features: DataFrame, days: int = 30) -> DataFrame:
    """Gap between on-time and late repeat rates, with a pooled z-test on exact counts."""
    late = F.coalesce(F.col("is_late") == 1, F.lit(False))

    def total(value, condition):
        return F.sum(F.when(condition, value)).cast("double")

    return gap_test(
        features.agg(
            total(F.lit(1), late).alias("n_late"),
            total(F.col(_repeated(days)), late).alias("x_late"),
            total(F.lit(1), ~late).alias("n_on_time"),
            total(F.col(_repeated(days)), ~late).alias("x_on_time"),
        )
    )


def gap_test(counts: DataFrame) -> DataFrame:
    """The test on one row of counts: users and returned users, late and on time."""
    gap = ratio("x_on_time", "n_on_time") - ratio("x_late", "n_late")
    z = pooled_z(F.col("x_late"), F.col("n_late"), F.col("x_on_time"), F.col("n_on_time"))
    return counts.select(
        F.round(F.lit(100.0) * gap, 2).alias("raw_gap_pp"), z.alias("z")
    ).withColumn("p_value", two_sided_p(F.col("z")))


def repeat_by_late_stratified(
    features: DataFrame, min_cell: int = 20, rounded: bool = True, days: int = 30
) -> DataFrame:
    """The late gap held constant within city, channel, membership and platform.

    Cells with fewer than ``min_cell`` users on either side are dropped; the rest
    are weighted by their size.
    """
    late, on_time = F.col("is_late") == 1, F.col("is_late") == 0
    strata = features.groupBy(*STRATA).agg(
        F.sum(F.when(late, 1).otherwise(0)).alias("n_late"),
        F.sum(F.when(on_time, 1).otherwise(0)).alias("n_on_time"),
        F.sum(F.when(late, F.col(_repeated(days)))).alias("x_late"),
        F.sum(F.when(on_time, F.col(_repeated(days)))).alias("x_on_time"),
    )
    return weighted_gap(strata, min_cell, rounded)


def weighted_gap(strata: DataFrame, min_cell: int = 20, rounded: bool = True) -> DataFrame:
    """The gap over strata of users and returned users, late and on time."""
    cells = strata.filter(
        (F.col("n_late") >= min_cell) & (F.col("n_on_time") >= min_cell)
    ).select(
        (F.col("n_late") + F.col("n_on_time")).alias("weight"),
        ratio("x_late", "n_late").alias("late_rate"),
        ratio("x_on_time", "n_on_time").alias("on_time_rate"),
    )

    def weighted(rate):
        value = F.try_divide(
            F.lit(100.0) * F.sum(rate * F.col("weight")), F.sum("weight").cast("double")
        )
        return rounded_if(rounded, value, 2)

    return cells.agg(
        F.count("*").alias("cells_used"),
        F.sum("weight").alias("users_covered"),
        weighted(F.col("on_time_rate") - F.col("late_rate")).alias("adjusted_gap_pp"),
        weighted(F.col("on_time_rate")).alias("wtd_ontime_pct"),
        weighted(F.col("late_rate")).alias("wtd_late_pct"),
    )


def lateness_bucket(
    edges: Sequence[float] = (0, 10, 20, 30), labels: Sequence[str] = LATENESS_LABELS
) -> Column:
    if len(labels) != len(edges) + 1:
        raise ValueError("there must be one label more than edges")
    bucket = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels))):
        bucket = F.when(F.col("minutes_late") <= edge, label).otherwise(bucket)
    return bucket


def rating_band() -> Column:
    band = F.lit(LOWEST_BAND)
    for floor, label in reversed(RATING_BANDS):
        band = F.when(F.col("rating") >= floor, label).otherwise(band)
    return band


def membership() -> Column:
    return F.when(F.col("is_member") == 1, "Member").otherwise("Non-member")


def dose_response(
    features: DataFrame,
    edges: Sequence[float] = (0, 10, 20, 30),
    labels: Sequence[str] = LATENESS_LABELS,
    days: int = 30,
) -> DataFrame:
    """Repeat rate by bucket of minutes late. Buckets include their upper edge;
    unknown minutes fall into the last one."""
    bucket = lateness_bucket(edges, labels)
    return features.groupBy(bucket.alias("lateness_bucket")).agg(
        F.count("*").alias("users"),
        F.round(measured_mean("rating"), 2).alias("avg_first_rating"),
        F.round(percent_of_flags(_repeated(days)), 2).alias(f"repeat_{days}d_pct"),
    )


def repeat_by_segment(features: DataFrame, days: int = 30) -> DataFrame:
    """Repeat rate by city, channel, platform, membership and first-rating band.

    Users are counted once, into cells over all five dimensions; the breakdowns
    then unpivot the cells, not the users.
    """
    dimensions = {
        "city": F.col("city"),
        "channel": F.col("acquisition_channel"),
        "platform": F.col("platform"),
        "member": membership(),
        "first_rating": rating_band(),
    }
    cells = features.groupBy(*[value.alias(name) for name, value in dimensions.items()]).agg(
        F.count("*").alias("n"), F.sum(_repeated(days)).alias("x")
    )
    return one_way(cells, list(dimensions))


def one_way(cells: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Each dimension's breakdown of cells with n users, x of whom came back."""
    return (
        cells.unpivot(["n", "x"], list(dimensions), "dimension", "value")
        .groupBy("dimension", "value")
        .agg(
            F.sum("n").alias("users"),
            F.round(F.lit(100.0) * ratio(F.sum("x"), F.sum("n")), 2).alias("repeat_pct"),
        )
    )


def segment_deviation(
    by_segment: DataFrame, overall: DataFrame, rate: str = "repeat_30d_rate_pct"
) -> DataFrame:
    """Each group's distance from the overall repeat rate, a one-row frame."""
    distance = F.round(F.col("repeat_pct") - overall.select(rate).scalar(), 2)
    return by_segment.withColumn("deviation_pp", distance).withColumn(
        "above", F.col("deviation_pp") > 0
    )


def late_by_city_hour(orders: DataFrame) -> DataFrame:
    """Late rate and mean delivery time of delivered orders by city and daypart."""
    return (
        delivered(orders)
        .groupBy("city", daypart("order_ts").alias("daypart"))
        .agg(
            F.count("*").alias("orders"),
            F.round(percent_of_flags("is_late"), 1).alias("late_rate_pct"),
            F.round(measured_mean("delivery_minutes"), 1).alias("avg_minutes"),
        )
    )


def late_heatmap(by_city_hour: DataFrame) -> DataFrame:
    """City by daypart, worst dinner peak first."""
    wide = by_city_hour.groupBy("city").pivot("daypart", list(DAYPARTS)).agg(
        F.first("late_rate_pct")
    )
    named = [F.col(f"`{part}`").alias(part.lower().replace(" ", "_")) for part in DAYPARTS]
    return wide.select("city", *named).orderBy(F.desc_nulls_last("dinner_peak"), "city")


def worst_cells(by_city_hour: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` cells with the highest late rate; ties go by city, then daypart."""
    return (
        by_city_hour.select("city", "daypart", "late_rate_pct")
        .orderBy(F.desc_nulls_last("late_rate_pct"), "city", "daypart")
        .limit(k)
    )
