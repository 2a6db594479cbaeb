"""Weekly metric monitor: values, trailing baseline, direction-aware status."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import days, week_start, within_week
from tidemark.functions.numeric import (
    measured_mean,
    money_mean,
    percent,
    percent_of_flags,
)
from tidemark.operators.first_orders import active_users, delivered
from tidemark.operators.funnel import funnel_weekly


@dataclass(frozen=True)
class Metric:
    """A weekly metric: an aggregate over delivered orders, or a named source of
    its own. ``good`` is the direction that is good; ``amber`` and ``red`` are
    relative moves the other way, against the trailing mean."""

    label: str
    value: Column | str
    good: str
    amber: float
    red: float


ACTIVE_USERS, FUNNEL = "active users", "funnel"


def default_metrics() -> list[Metric]:
    """The tracked metrics. Labels, directions and thresholds are fixed values."""
    return [
        Metric("Orders", F.count("*"), "up", 0.05, 0.10),
        Metric("Active users", ACTIVE_USERS, "up", 0.05, 0.10),
        Metric("GMV (₹)", F.sum("gmv"), "up", 0.05, 0.10),
        Metric("AOV (₹)", money_mean("gmv"), "up", 0.03, 0.06),
        Metric("Late-delivery rate (%)", percent_of_flags("is_late"), "down", 0.10, 0.20),
        Metric("Avg delivery (min)", measured_mean("delivery_minutes"), "down", 0.05, 0.10),
        Metric("Avg rating", measured_mean("rating"), "up", 0.02, 0.04),
        Metric("Discount % of GMV", percent(F.sum("discount"), F.sum("gmv")), "down", 0.10, 0.20),
        Metric("Session→order conv (%)", FUNNEL, "up", 0.05, 0.10),
    ]


# Status labels from best to worst.
NO_DATA, GREEN, AMBER, RED = "NO DATA", "GREEN", "AMBER", "RED"
SEVERITY = (NO_DATA, GREEN, AMBER, RED)


def weekly_metrics(
    orders: DataFrame,
    events: DataFrame | None = None,
    metrics: Sequence[Metric] | None = None,
    first_step: int = 1,
    last_step: int = 6,
    approximate: bool = False,
) -> DataFrame:
    """metric, week_start, value. ``approximate`` counts active users by sketches. All aggregates over orders come from one pass
    that keeps one row per week; active users are counted beside it. The funnel
    takes part if ``events`` are given; a registry of one's own that names it
    needs them."""
    registry = metrics or default_metrics()
    aggregates = [m for m in registry if isinstance(m.value, Column)]
    for metric in registry:
        if not isinstance(metric.value, Column) and metric.value not in (ACTIVE_USERS, FUNNEL):
            raise ValueError(f"{metric.label}: no source is named {metric.value!r}")
        if metrics and not isinstance(metric.value, Column) and metric.value == FUNNEL and events is None:
            raise ValueError(f"{metric.label} needs events")
    week = week_start("order_ts").alias("week_start")
    parts = []
    if aggregates:
        parts.append(
            delivered(orders)
            .groupBy(week)
            .agg(*[m.value.cast("double").alias(m.label) for m in aggregates])
            .unpivot("week_start", [f"`{m.label}`" for m in aggregates], "metric", "value")
        )
    for metric in registry:
        if isinstance(metric.value, Column):
            continue
        if metric.value == ACTIVE_USERS:
            users = active_users(
                delivered(orders), week_start("order_ts"), "week_start", approximate
            )
            one = users.withColumnRenamed("active_users", "value")
        elif events is not None:
            one = funnel_weekly(events, first_step, last_step)
        else:
            continue
        parts.append(
            one.select(
                F.lit(metric.label).alias("metric"), "week_start", F.col("value").cast("double")
            )
        )
    return reduce(DataFrame.unionByName, [p.select("metric", "week_start", "value") for p in parts])


def trailing_baseline(weekly: DataFrame, n: int = 4) -> DataFrame:
    """Add ``base``, the mean of up to ``n`` earlier weeks that are present."""
    earlier = Window.partitionBy("metric").orderBy("week_start").rowsBetween(-n, -1)
    return weekly.withColumn("base", F.avg("value").over(earlier))


def _lookup(metrics: Sequence[Metric], field: str) -> Column:
    pairs = [F.lit(part) for m in metrics for part in (m.label, getattr(m, field))]
    return F.element_at(F.create_map(*pairs), F.col("metric"))


def classify(baselined: DataFrame, metrics: Sequence[Metric] | None = None) -> DataFrame:
    """Add ``direction``, ``move`` (relative to the baseline) and ``status``."""
    registry = metrics or default_metrics()
    usable = F.col("base").isNotNull() & (F.col("base") != 0)
    move = F.try_divide(F.col("value") - F.col("base"), F.abs(F.col("base")))
    wrong_way = F.when(F.col("direction") == "up", -F.col("move")).otherwise(F.col("move"))
    return (
        baselined.withColumn("direction", _lookup(registry, "good"))
        .withColumn("move", F.when(usable, move).otherwise(0.0))
        .withColumn(
            "status",
            F.when(~usable, NO_DATA)
            .when(wrong_way >= _lookup(registry, "red"), RED)
            .when(wrong_way >= _lookup(registry, "amber"), AMBER)
            .otherwise(GREEN),
        )
    )


def weekly_report(classified: DataFrame, week=None) -> DataFrame:
    """The status table of one week, with the worst status as ``overall``.

    Without ``week`` it is the second-latest week of all metrics together, since
    the latest one is still running. A metric without that week is left out.
    """
    if week is None:
        newest_first = Window.orderBy(F.desc("week_start"))
        rows = (
            classified.withColumn("age", F.dense_rank().over(newest_first))
            .filter(F.col("age") == 2)
            .drop("age")
        )
    else:
        rows = classified.filter(F.col("week_start") == F.lit(str(week)).cast("date"))
    severity = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("status"))
    worst = F.max(severity).over(Window.partitionBy()).cast("int")
    return rows.select(
        "week_start",
        "metric",
        F.round("value", 2).alias("this_week"),
        F.round("base", 2).alias("base_4wk"),
        F.round(F.lit(100.0) * F.col("move"), 1).alias("delta_pct"),
        "direction",
        "status",
        F.element_at(F.array(*map(F.lit, SEVERITY)), worst).alias("overall"),
    )


def late_drilldown(
    orders: DataFrame,
    week=None,
    report: DataFrame | None = None,
    week_column: str | None = None,
) -> DataFrame:
    """Late deliveries by city in one week.

    With ``report``, the week is the reported one, and the result is empty unless
    some metric breached there. The week is a range of order times, which goes to
    the source as a filter: as literals if it is given, else once the report is
    known. ``week_column`` names the column of Mondays by which the table is
    partitioned; then no other week's files are read.
    """
    rows = delivered(orders)
    if week is not None:
        rows = rows.filter(within_week("order_ts", week))
        if week_column:
            rows = rows.filter(F.col(week_column) == F.lit(str(week)).cast("date"))
    if report is not None:
        breached = report.filter(F.col("status").isin(AMBER, RED))
        monday = breached.agg(F.max("week_start").cast("timestamp_ntz")).scalar()
        # The subquery stands alone on one side: only then is its result pushed down.
        rows = rows.filter(
            (F.col("order_ts") >= monday) & (F.col("order_ts") - days(7) < monday)
        )
        if week_column:
            rows = rows.filter(F.col(week_column) == breached.agg(F.max("week_start")).scalar())
    elif week is None:
        raise ValueError("give a week, a report, or both")
    return rows.groupBy("city").agg(
        F.round(percent_of_flags("is_late"), 1).alias("late_rate_pct"),
        F.round(measured_mean("delivery_minutes"), 1).alias("avg_min"),
        F.count("*").alias("orders"),
    )
