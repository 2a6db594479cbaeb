"""Whole reports: every operator wired to the four source tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import (
    cells,
    drivers,
    experiment,
    funnel,
    impact,
    metrics,
    monitor,
    retention,
    segments,
)
from tidemark.operators.first_orders import user_summary
from tidemark.sources.scratch import park


def full_report(
    tables: Mapping[str, DataFrame],
    as_of,
    *,
    min_cell: int = 20,
    months: float = 6.0,
) -> dict[str, DataFrame]:
    """All tables of the analysis by name, ready for ``write_results``.

    What several tables are made from is parked once: a row per user, cubes of orders, of first orders
    and of the experiment, and every small result that another table reads again. The impact
    model multiplies exact inputs.
    """
    users, orders = tables["users"], tables["orders"]
    events, assignments = tables["app_events"], tables["ab_test_assignments"]

    summary = park(user_summary(orders, as_of), "user-summary")
    firsts = summary.filter("matured").select("user_id", "first_ts", "repeated")
    features = drivers.first_order_features(users, orders, as_of, firsts=firsts)
    first_cells = park(cells.first_order_cells(features), "first-order-cells")
    order_cells = park(cells.order_cells(orders), "order-cells")
    arm_cells = park(cells.experiment_cells(assignments, orders), "experiment-cells")
    headline = metrics.headline(users, orders)
    north_star = park(metrics.repeat_rate(orders, as_of, firsts=firsts), "north-star")
    matrix = park(retention.cohort_matrix(orders), "cohorts")
    late_curve = park(retention.cohort_by_late(orders), "late-curve")
    by_platform = park(funnel.funnel_by(events, "platform"), "platforms")
    scores = segments.rfm_scores(orders, as_of)
    by_segment = park(cells.repeat_by_segment(first_cells), "by-segment")
    city_hour = park(cells.late_by_city_hour(order_cells), "city-hour")
    arms = park(cells.srm_check(arm_cells), "arms")
    primary = park(cells.ab_primary(arm_cells), "primary")
    split = park(cells.ab_by_segment(arm_cells), "split")
    exact_readout = experiment.ab_readout(primary, rounded=False)
    return {
        "headline": headline,
        "north_star": north_star,
        "monthly_trend": metrics.monthly_trend(orders),
        "guardrails": cells.guardrails(order_cells),
        "hour_of_day": cells.hour_of_day(order_cells),
        "cohort_matrix": matrix,
        "cohort_pivot": retention.cohort_pivot(matrix),
        "cohort_by_late": late_curve,
        "cohort_by_late_pivot": retention.cohort_by_late_pivot(late_curve),
        "funnel": funnel.funnel(events),
        "funnel_by_platform": by_platform,
        "funnel_pivot": funnel.funnel_pivot(by_platform),
        "payment_leak": funnel.leak_size(events),
        "rfm_summary": segments.rfm_summary(scores),
        "behaviour_by_channel": segments.behaviour_by_channel(users, orders),
        "repeat_by_late": cells.repeat_by_late(first_cells),
        "late_gap_test": cells.late_gap_test(first_cells),
        "stratified": cells.repeat_by_late_stratified(first_cells, min_cell),
        "dose_response": cells.dose_response(first_cells),
        "repeat_by_segment": by_segment,
        "segment_deviation": drivers.segment_deviation(by_segment, north_star),
        "late_by_city_hour": city_hour,
        "late_heatmap": drivers.late_heatmap(city_hour),
        "ab_srm": arms,
        "ab_srm_test": experiment.srm_test(arms),
        "ab_balance": cells.ab_balance(arm_cells),
        "ab_primary": primary,
        "ab_readout": experiment.ab_readout(primary),
        "ab_power": experiment.ab_power(primary),
        "ab_guardrails": cells.ab_guardrails(arm_cells),
        "ab_by_segment": split,
        "ab_segment_lift": experiment.ab_segment_lift(split),
        "ab_lift": experiment.ab_lift(primary),
        "impact": impact.yearly_effects(
            cells.value_and_worst_cells(order_cells),
            metrics.returning_users(summary).select("matured_new_users", "extra_orders"),
            funnel.leak_size(events, rounded=False).select("recoverable_orders_6mo"),
            cells.repeat_by_late_stratified(first_cells, min_cell, rounded=False).select("adjusted_gap_pp"),
            exact_readout.filter(F.col("variant") == experiment.TREATMENT).select("abs_lift_pp", "treatment_rate_pct"),
            impact.second_order_values(cells.ab_guardrails(arm_cells, rounded=False)),
            months=months,
        ),
    }


def weekly_run(
    orders: DataFrame,
    events: DataFrame | None = None,
    week=None,
    *,
    weekly: DataFrame | None = None,
    week_column: str | None = None,
) -> dict[str, DataFrame]:
    """The monitor for one week: status table, and the drill-down that fills only
    if something breached. The status table is parked, since both read it.

    ``weekly`` hands in the metrics where they are kept, see
    :mod:`tidemark.operators.weekly_state`; with ``week_column`` the drill-down reads only the reported week of
    a table partitioned by it."""
    if weekly is None:
        weekly = monitor.weekly_metrics(orders, events)
    classified = monitor.classify(monitor.trailing_baseline(weekly))
    report = park(monitor.weekly_report(classified, week), "weekly-report")
    return {"report": report, "drilldown": monitor.late_drilldown(orders, week, report, week_column)}
