"""Every operator as a query over a directory of star-schema tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.calendar import instant
from tidemark.operators import (
    cells,
    distinct,
    drivers,
    experiment,
    first_orders,
    funnel,
    impact,
    metrics,
    monitor,
    retention,
    segments,
    user_days,
    weekly_state,
)
from tidemark.plans.report import weekly_run
from tidemark.sources.by_week import WEEK, read_by_week, write_by_week
from tidemark.sources.quarantine import load_table
from tidemark.sources.results import write_results
from tidemark.sources.scratch import park, scratch_path
from tidemark.sources.star import (
    events_of,
    first_two_orders_of,
    orders_of,
    users_of,
    variants_of,
)
from tidemark.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = "2001-08-01"
OUTCOME_DAYS = 90
OUTCOME = f"repeat_within_{OUTCOME_DAYS}d"
SHORT_DAYS = 14
REPORT_WEEK = "2001-06-18"
MIN_CELL = 5

QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def features_of(
    spark: SparkSession, directory: str, ties: str = "all", days: int = 30
) -> DataFrame:
    firsts = first_orders.repeat_flags(orders_of(spark, directory), AS_OF, days)
    keys = firsts.select("user_id", F.col("first_ts").alias("order_ts"))
    orders = orders_of(spark, directory, city=True, delivery=True, only=keys)
    return drivers.first_order_features(
        users_of(spark, directory), orders, AS_OF, days, ties=ties, firsts=firsts
    )


def outcomes_of(spark: SparkSession, directory: str) -> DataFrame:
    return experiment.experiment_outcomes(
        first_two_orders_of(spark, directory), variants_of(spark, directory), OUTCOME_DAYS
    )


def primary_of(spark: SparkSession, directory: str) -> DataFrame:
    return experiment.ab_primary(outcomes_of(spark, directory), OUTCOME_DAYS)


def first_deliveries_of(spark: SparkSession, directory: str, outcomes: DataFrame) -> DataFrame:
    """The orders that experiment users were assigned with."""
    firsts = outcomes.select("user_id", F.col("assigned_ts").alias("order_ts"))
    return orders_of(spark, directory, delivery=True, only=firsts)


def split_of(spark: SparkSession, directory: str) -> DataFrame:
    outcomes = outcomes_of(spark, directory)
    return experiment.ab_by_segment(
        outcomes, first_deliveries_of(spark, directory, outcomes), OUTCOME_DAYS
    )


def weekly_of(spark: SparkSession, directory: str) -> DataFrame:
    """All nine metrics; the funnel of the binding has four steps."""
    return monitor.weekly_metrics(
        orders_of(spark, directory, delivery=True), events_of(spark, directory), last_step=4
    )


def classified_of(spark: SparkSession, directory: str) -> DataFrame:
    return monitor.classify(monitor.trailing_baseline(weekly_of(spark, directory)))


def city_hour_of(spark: SparkSession, directory: str) -> DataFrame:
    return drivers.late_by_city_hour(orders_of(spark, directory, city=True, delivery=True))


# Headline and time metrics


@query
def headline(spark, directory):
    return metrics.headline(
        users_of(spark, directory), orders_of(spark, directory, delivery=True)
    )


@query
def repeat_rate(spark, directory):
    return metrics.repeat_rate(orders_of(spark, directory), AS_OF)


@query
def monthly_trend(spark, directory):
    return metrics.monthly_trend(orders_of(spark, directory, delivery=True))


@query
def guardrails(spark, directory):
    return metrics.guardrails(orders_of(spark, directory, delivery=True))


@query
def extra_orders_per_retained_user(spark, directory):
    return metrics.extra_orders_per_retained_user(orders_of(spark, directory))


@query
def hour_of_day(spark, directory):
    return metrics.hour_of_day(orders_of(spark, directory))


# Cohort retention


@query
def cohort_matrix(spark, directory):
    return retention.cohort_matrix(orders_of(spark, directory))


@query
def cohort_pivot(spark, directory):
    matrix = park(retention.cohort_matrix(orders_of(spark, directory)), "cohorts")
    return retention.cohort_pivot(matrix)


@query
def cohort_by_late(spark, directory):
    return retention.cohort_by_late(orders_of(spark, directory, delivery=True))


@query
def cohort_by_late_pivot(spark, directory):
    return retention.cohort_by_late_pivot(
        retention.cohort_by_late(orders_of(spark, directory, delivery=True))
    )


# Funnel


@query
def funnel_overall(spark, directory):
    return funnel.funnel(events_of(spark, directory))


@query
def funnel_by_platform(spark, directory):
    return funnel.funnel_by(events_of(spark, directory), "platform")


@query
def leak_size(spark, directory):
    return funnel.leak_size(events_of(spark, directory), 3, 4)


@query
def funnel_weekly(spark, directory):
    return funnel.funnel_weekly(events_of(spark, directory), 1, 4)


@query
def funnel_pivot(spark, directory):
    by_platform = funnel.funnel_by(events_of(spark, directory), "platform")
    return funnel.funnel_pivot(by_platform)


# Segmentation


@query
def rfm_scores(spark, directory):
    return segments.rfm_scores(orders_of(spark, directory), AS_OF)


@query
def rfm_summary(spark, directory):
    return segments.rfm_summary(segments.rfm_scores(orders_of(spark, directory), AS_OF))


@query
def behaviour_by_channel(spark, directory):
    return segments.behaviour_by_channel(
        users_of(spark, directory), orders_of(spark, directory, delivery=True)
    )


# Drivers of the second order


@query
def first_order_features(spark, directory):
    return features_of(spark, directory)


@query
def first_order_features_one_per_user(spark, directory):
    return features_of(spark, directory, ties="first")


@query
def repeat_by_late(spark, directory):
    return drivers.repeat_by_late(features_of(spark, directory))


@query
def late_gap_test(spark, directory):
    test = drivers.late_gap_test(features_of(spark, directory))
    return test.select("raw_gap_pp", F.round("z", 6).alias("z"), _six_digits("p_value"))


@query
def repeat_by_late_stratified(spark, directory):
    return drivers.repeat_by_late_stratified(features_of(spark, directory), MIN_CELL)


@query
def dose_response(spark, directory):
    return drivers.dose_response(features_of(spark, directory))


@query
def repeat_by_segment(spark, directory):
    return drivers.repeat_by_segment(features_of(spark, directory))


@query
def repeat_by_late_14d(spark, directory):
    features = features_of(spark, directory, days=SHORT_DAYS)
    return drivers.repeat_by_late(features, SHORT_DAYS)


@query
def late_gap_test_14d(spark, directory):
    test = drivers.late_gap_test(features_of(spark, directory, days=SHORT_DAYS), SHORT_DAYS)
    return test.select("raw_gap_pp", F.round("z", 6).alias("z"), _six_digits("p_value"))


@query
def repeat_by_late_stratified_14d(spark, directory):
    features = features_of(spark, directory, days=SHORT_DAYS)
    return drivers.repeat_by_late_stratified(features, MIN_CELL, days=SHORT_DAYS)


@query
def dose_response_14d(spark, directory):
    return drivers.dose_response(features_of(spark, directory, days=SHORT_DAYS), days=SHORT_DAYS)


@query
def repeat_by_segment_14d(spark, directory):
    features = features_of(spark, directory, days=SHORT_DAYS)
    return drivers.repeat_by_segment(features, SHORT_DAYS)


@query
def segment_deviation(spark, directory):
    return drivers.segment_deviation(
        drivers.repeat_by_segment(features_of(spark, directory)),
        metrics.repeat_rate(orders_of(spark, directory), AS_OF),
    )


@query
def late_by_city_hour(spark, directory):
    return city_hour_of(spark, directory)


@query
def late_heatmap(spark, directory):
    return drivers.late_heatmap(city_hour_of(spark, directory))


@query
def worst_cells(spark, directory):
    return drivers.worst_cells(city_hour_of(spark, directory))


# Experiment readout


def _six_digits(name: str):
    """Engines round exp() differently in the last bit, and a p-value may be very small: six
    significant digits are the same everywhere."""
    return F.format_string("%.5e", name).cast("double").alias(name)


@query
def experiment_outcomes(spark, directory):
    return outcomes_of(spark, directory)


@query
def srm_check(spark, directory):
    return experiment.srm_check(outcomes_of(spark, directory))


@query
def srm_test(spark, directory):
    test = experiment.srm_test(experiment.srm_check(outcomes_of(spark, directory)))
    return test.select(F.round("chi2", 6).alias("chi2"), "df", _six_digits("p_value"), "passed")


@query
def ab_balance(spark, directory):
    outcomes = outcomes_of(spark, directory)
    return experiment.ab_balance(outcomes, first_deliveries_of(spark, directory, outcomes))


@query
def ab_primary(spark, directory):
    return primary_of(spark, directory)


@query
def ab_readout(spark, directory):
    return experiment.ab_readout(primary_of(spark, directory)).withColumn(
        "p_value", _six_digits("p_value")
    )


@query
def ab_readout_by_segment(spark, directory):
    return experiment.ab_readout(split_of(spark, directory), by=["segment"]).withColumn(
        "p_value", _six_digits("p_value")
    )


@query
def ab_power(spark, directory):
    return experiment.ab_power(primary_of(spark, directory))


@query
def ab_guardrails(spark, directory):
    return experiment.ab_guardrails(outcomes_of(spark, directory))


@query
def ab_by_segment(spark, directory):
    return split_of(spark, directory)


@query
def ab_segment_lift(spark, directory):
    return experiment.ab_segment_lift(split_of(spark, directory), OUTCOME_DAYS)


@query
def ab_lift(spark, directory):
    return experiment.ab_lift(primary_of(spark, directory), days=OUTCOME_DAYS)


# Weekly monitor


@query
def weekly_metrics(spark, directory):
    return weekly_of(spark, directory).withColumn("value", F.round("value", 6))


@query
def trailing_baseline(spark, directory):
    baselined = monitor.trailing_baseline(weekly_of(spark, directory))
    return baselined.select(
        "metric", "week_start", F.round("value", 6).alias("value"), F.round("base", 6).alias("base")
    )


@query
def classify(spark, directory):
    return classified_of(spark, directory).select(
        "metric", "week_start", "direction", F.round("move", 6).alias("move"), "status"
    )


@query
def weekly_report(spark, directory):
    return monitor.weekly_report(classified_of(spark, directory))


@query
def weekly_report_of_a_week(spark, directory):
    return monitor.weekly_report(classified_of(spark, directory), REPORT_WEEK)


@query
def late_drilldown(spark, directory):
    return monitor.late_drilldown(
        orders_of(spark, directory, city=True, delivery=True),
        week=REPORT_WEEK,
        report=monitor.weekly_report(classified_of(spark, directory), REPORT_WEEK),
    )


def _state_of_two_batches(spark, directory):
    """A state fed twice: most rows first, then the latest quarter and some late rows of two earlier months."""
    orders = orders_of(spark, directory, delivery=True)
    events = events_of(spark, directory)
    earlier = F.col("order_ts").between(instant("2000-03-01"), instant("2000-05-01"))
    late = (F.col("order_ts") >= instant("2001-05-01")) | earlier & (F.col("order_id") % 7 == 0)
    late_event = (F.col("user_id") % 5 == 0) & (F.col("step_no") > 1)
    state = scratch_path(spark, "weekly-state")
    for batch, keep in (("first", F.lit(False)), ("second", F.lit(True))):
        weekly_state.advance(
            spark, state, batch, orders.filter(late == keep), events.filter(late_event == keep), last_step=4
        )
    return state


@query
def weekly_metrics_incremental(spark, directory):
    kept = weekly_state.weekly_metrics(spark, _state_of_two_batches(spark, directory))
    return kept.withColumn("value", F.round("value", 6))


@query
def late_drilldown_by_week(spark, directory):
    """Over a copy of the orders partitioned by week, of which it reads the reported one."""
    path = scratch_path(spark, "orders-by-week")
    orders = orders_of(spark, directory, city=True, delivery=True)
    write_by_week(orders, path)
    by_week = read_by_week(spark, path, orders.schema)
    weekly = monitor.weekly_metrics(by_week, events_of(spark, directory), last_step=4)
    return weekly_run(by_week, week=REPORT_WEEK, weekly=weekly, week_column=WEEK)["drilldown"]


# Impact sizing


def _impact(spark, directory, rounded: bool):
    """From three cubes and a summary per user, all of one parked copy of the bound orders."""
    users = park(users_of(spark, directory), "users")
    orders = park(orders_of(spark, directory, city=True, delivery=True, users=users), "orders")
    summary = park(first_orders.user_summary(orders, AS_OF), "user-summary")
    firsts = summary.filter("matured").select("user_id", "first_ts", "repeated")
    features = drivers.first_order_features(users, orders, AS_OF, firsts=firsts)
    outcomes = experiment.experiment_outcomes(
        first_orders.first_n_orders(orders, 2), variants_of(spark, directory), OUTCOME_DAYS
    )
    first_cells = park(cells.first_order_cells(features), "first-order-cells")
    arms = park(cells.experiment_cells(outcomes, orders, OUTCOME_DAYS), "experiment-cells")
    readout = experiment.ab_readout(cells.ab_primary(arms, OUTCOME_DAYS), rounded=False)
    return impact.yearly_effects(
        cells.value_and_worst_cells(cells.order_cells(orders)),
        metrics.returning_users(summary).select("matured_new_users", "extra_orders"),
        funnel.leak_size(events_of(spark, directory), 3, 4, rounded=False).select("recoverable_orders_6mo"),
        cells.repeat_by_late_stratified(first_cells, MIN_CELL, rounded=False).select("adjusted_gap_pp"),
        readout.filter(F.col("variant") == experiment.TREATMENT).select("abs_lift_pp", "treatment_rate_pct"),
        impact.second_order_values(cells.ab_guardrails(arms, rounded=False)),
        rounded_inputs=rounded,
    ).withColumns(
        {
            "orders_per_retained_user_measured": F.round("orders_per_retained_user_measured", 6),
            "lateness_worst_cells": F.array_join(
                F.transform(
                    "lateness_worst_cells",
                    lambda c: F.format_string("%s, %s: %.1f", c["city"], c["daypart"], c["late_rate_pct"]),
                ),
                "; ",
            ),
        }
    )


@query
def impact_model(spark, directory):
    return _impact(spark, directory, rounded=False)


@query
def impact_model_rounded_inputs(spark, directory):
    return _impact(spark, directory, rounded=True)


# Distinct counts that merge


GRAINS = ("week", "month", "quarter", "all")


@query
def active_users_by_bitmaps(spark, directory):
    """Users with a delivered order by week, month, quarter and in all, from bitmaps kept per day. Numbers are given in
    two goes, as by two runs."""
    orders = first_orders.delivered(orders_of(spark, directory))
    early = orders.filter(F.col("order_ts") < instant("1996-01-01"))
    numbers = distinct.number_members(orders, "user_id", distinct.number_members(early, "user_id"))
    days = park(distinct.daily_bitmaps(orders, "user_id", "order_ts", numbers), "user-bitmaps")
    counts = [
        distinct.bitmap_counts(days, grain).select(F.lit(grain).alias("grain"), "period", F.col("members").alias("active_users"))
        for grain in GRAINS
    ]
    return reduce(DataFrame.unionAll, counts)


@query
def funnel_by_bitmaps(spark, directory):
    """Sessions per step and month, from bitmaps per day and step."""
    events = events_of(spark, directory)
    numbers = distinct.number_members(events, "session_id")
    days = distinct.daily_bitmaps(events, "session_id", "event_ts", numbers, "step_no", "event_name")
    return distinct.bitmap_counts(days, "month", "step_no", "event_name").select(
        "step_no", "event_name", F.col("period").alias("month"), F.col("members").alias("sessions")
    )


@query
def active_users_by_sketches(spark, directory):
    """Exact active users, and whether the estimate from daily sketches is within its error, by grain. Estimates
    of a handful of users are off by less than one."""
    orders = first_orders.delivered(orders_of(spark, directory))
    days = park(distinct.daily_sketches(orders, "user_id", "order_ts"), "user-sketches")
    exact = park(distinct.daily_bitmaps(orders, "user_id", "order_ts", distinct.number_members(orders, "user_id")), "user-bitmaps")
    bound = F.greatest(F.lit(1.0), F.lit(distinct.relative_error()) * F.col("active_users"))
    parts = []
    for grain in GRAINS:
        true = distinct.bitmap_counts(exact, grain).select("period", F.col("members").alias("active_users"), F.lit(None).cast("long").alias("estimate"))
        sketched = distinct.sketched_counts(days, grain).select("period", F.lit(None).cast("long").alias("active_users"), F.col("members").alias("estimate"))
        beside = true.unionAll(sketched).groupBy("period").agg(F.max("active_users").alias("active_users"), F.max("estimate").alias("estimate"))
        near = F.abs(F.col("estimate") - F.col("active_users")) <= bound
        parts.append(beside.select(F.lit(grain).alias("grain"), "period", "active_users", near.alias("within")))
    return reduce(DataFrame.unionAll, parts)


# Per-user operators over a bucketed table

BUCKETS = 8


def user_days_of(spark, directory):
    """Saved in two goes: the days of most orders, merged with those of the others."""
    orders = orders_of(spark, directory)
    late = F.col("order_id") % 5 == 0
    days = user_days.merged_days(user_days.user_days(orders.filter(~late)), user_days.user_days(orders.filter(late)))
    name = f"user_days_{uuid.uuid4().hex}"
    return user_days.write_by_user(days, name, scratch_path(spark, "user-days"), BUCKETS)


@query
def repeat_rate_by_user_days(spark, directory):
    return metrics.repeat_rate(None, AS_OF, firsts=user_days.repeat_flags(user_days_of(spark, directory), AS_OF))


@query
def cohort_matrix_by_user_days(spark, directory):
    return user_days.cohort_matrix(user_days_of(spark, directory))


@query
def rfm_scores_by_user_days(spark, directory):
    return user_days.rfm_scores(user_days_of(spark, directory), AS_OF)


# Cubes


def _in_doubles(cube: DataFrame) -> DataFrame:
    """Sums of money as doubles, for comparison."""
    kinds = dict(cube.dtypes)
    return cube.select(*[F.col(c).cast("double") if kinds[c].startswith("decimal") else F.col(c) for c in cube.columns])


@query
def order_cells(spark, directory):
    return _in_doubles(cells.order_cells(orders_of(spark, directory, city=True, delivery=True)))


@query
def first_order_cells(spark, directory):
    return cells.first_order_cells(features_of(spark, directory))


@query
def experiment_cells(spark, directory):
    outcomes = outcomes_of(spark, directory)
    firsts = first_deliveries_of(spark, directory, outcomes)
    return _in_doubles(cells.experiment_cells(outcomes, firsts, OUTCOME_DAYS))


# Tables in and out


@query
def enrich_orders(spark, directory):
    bare = orders_of(spark, directory, delivery=True).drop("is_late", "discount")
    return first_orders.enrich_orders(bare).select(
        "order_id", "user_id", "order_ts", "order_seq", "is_late"
    )


def _column_checks(name: str, table: DataFrame) -> DataFrame:
    """One row per column: how many values, their sum in ten-thousandths (of texts and times: their
    total length), and the lowest and highest text or time. All columns in one pass."""
    checks = []
    for field in table.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.NumericType):
            total, low, high = F.sum(F.rint(column * 10000).cast("long")), F.lit(None), F.lit(None)
        else:
            text = column.cast("string")
            total, low, high = F.sum(F.length(text)), F.min(column), F.max(column)
        checks.append(
            F.struct(
                F.lit(field.name).alias("column_name"),
                F.count(column).alias("n_values"),
                total.cast("double").alias("total"),
                low.cast("string").alias("lowest"),
                high.cast("string").alias("highest"),
            )
        )
    return table.agg(F.array(*checks).alias("checks")).select(
        F.lit(name).alias("table_name"), F.explode("checks").alias("check")
    ).select("table_name", "check.*")


def _round_trip(spark: SparkSession, directory: str, fmt: str) -> DataFrame:
    """Write all four tables, read them back typed, and sum up every column."""
    path = scratch_path(spark, fmt)
    orders = orders_of(spark, directory, city=True, delivery=True)
    sources = {
        "users": users_of(spark, directory).withColumnRenamed("is_member", "is_gold"),
        "orders": orders.withColumn("discount", F.round("discount", 2).cast("decimal(18,2)")),
        "app_events": events_of(spark, directory).withColumn(
            "event_ts", F.date_trunc("second", "event_ts").cast("timestamp_ntz")
        ),
        "ab_test_assignments": outcomes_of(spark, directory).withColumnRenamed(
            OUTCOME, "repeat_within_14d"
        ),
    }
    paths = write_results(sources, path, fmt)
    checks = [
        _column_checks(name, read_table(spark, name, paths[name], fmt, view=False))
        for name in sources
    ]
    return reduce(DataFrame.unionByName, checks)


@query
def read_tables(spark, directory):
    return _round_trip(spark, directory, "csv")


@query
def read_tables_parquet(spark, directory):
    return _round_trip(spark, directory, "parquet")


@query
def quarantine_on_load(spark, directory):
    """Orders written as text with faults in some lines, loaded with these set aside: how many good ones, how many
    with each reason, and the sum of the good ones' ids."""
    orders = orders_of(spark, directory, delivery=True).withColumn("discount", F.round("discount", 2))
    fault = F.col("order_id") % 50
    faults = {
        "delivery_minutes": (fault == 3, F.lit("soon")),
        "gmv": ((fault == 4) | (fault == 7), F.lit("-5.00")),
        "order_ts": (fault == 5, F.lit(None)),
        "rating": (fault == 6, F.lit("9")),
        "status": (fault == 7, F.lit("lost")),
    }
    texts = {
        name: F.date_format("order_ts", "yyyy-MM-dd HH:mm:ss") if name == "order_ts" else F.col(name).cast("string")
        for name in orders.columns
    }
    broken = orders.select(
        *[
            (F.when(~faults[name][0], text).otherwise(faults[name][1]) if name in faults else text).alias(name)
            for name, text in texts.items()
        ]
    )
    path = scratch_path(spark, "orders-with-faults")
    broken.write.option("header", True).csv(path)
    found = load_table(spark, "orders", path, "csv")
    good = found.good.agg(F.lit("good").alias("reason"), F.count("*").alias("n"), F.sum("order_id").alias("ids"))
    why = found.rejected.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(
        F.count("*").alias("n"), F.lit(None).cast("long").alias("ids")
    )
    return good.unionAll(why)


@query
def write_results_json(spark, directory):
    """Persist a result as JSON and read it back with its own schema."""
    monthly = metrics.guardrails(orders_of(spark, directory, delivery=True))
    paths = write_results({"guardrails": monthly}, scratch_path(spark, "json"), "json")
    return spark.read.schema(monthly.schema).json(paths["guardrails"])
