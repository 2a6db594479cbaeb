"""Experiment readout: outcomes, sample-ratio check, balance, primary metric,
significance, power, guardrails and effects by segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import days as day_span
from tidemark.functions.calendar import instant
from tidemark.functions.numeric import (
    measured_mean,
    money_mean,
    percent,
    percent_of_flags,
    rounded_if,
)
from tidemark.functions.statistics import (
    chi_square_tail,
    critical_z,
    pooled_z,
    required_per_arm,
    standard_error,
    two_sided_p,
)
from tidemark.operators.retention import LATE_SEGMENT, ON_TIME_SEGMENT

CONTROL = "control"
TREATMENT = "treatment"


def experiment_outcomes(
    orders: DataFrame,
    variants: DataFrame,
    days: int = 14,
    start=None,
    end=None,
    coupon: float = 75,
) -> DataFrame:
    """One row per experiment user: the first order, and what came of the second.

    ``orders`` needs ``order_seq``; ``variants`` holds user_id and variant. The
    population is users whose first placed order lies between ``start`` and
    ``end``. First and second order are folded into one row by a conditional
    aggregate, so orders are read once and not joined to themselves.
    """

    def nth(n: int, value):
        return F.max(F.when(F.col("order_seq") == n, value))

    cancelled = F.when(F.col("status") == "cancelled", 1).otherwise(0)
    pairs = (
        orders.filter(F.col("order_seq").isin(1, 2))
        .groupBy("user_id")
        .agg(
            nth(1, F.col("order_id")).alias("first_order_id"),
            nth(1, F.col("order_ts")).alias("assigned_ts"),
            nth(2, F.col("order_ts")).alias("second_ts"),
            nth(2, F.col("gmv")).alias("second_gmv"),
            nth(2, cancelled).alias("second_cancelled"),
        )
        .filter(F.col("first_order_id").isNotNull())
    )
    if start is not None:
        pairs = pairs.filter(F.col("assigned_ts") >= instant(start))
    if end is not None:
        pairs = pairs.filter(F.col("assigned_ts") <= instant(end))
    in_time = F.coalesce(
        F.col("second_ts") <= F.col("assigned_ts") + day_span(days), F.lit(False)
    )
    paid = in_time & (F.col("variant") == TREATMENT)
    return pairs.join(variants.select("user_id", "variant"), "user_id").select(
        "user_id",
        "first_order_id",
        "assigned_ts",
        "variant",
        in_time.cast("int").alias(f"repeat_within_{days}d"),
        F.when(in_time, F.col("second_gmv")).cast("double").alias("second_order_aov"),
        F.when(in_time, F.col("second_cancelled")).cast("double").alias("second_order_cancelled"),
        F.when(paid, F.lit(float(coupon))).otherwise(0.0).alias("coupon_cost"),
    )


def srm_check(assignments: DataFrame) -> DataFrame:
    """Size and share of every arm."""
    arms = assignments.groupBy("variant").agg(F.count("*").alias("users"))
    everyone = F.sum("users").over(Window.partitionBy())
    return arms.withColumn("pct", F.round(percent("users", everyone), 2))


def srm_test(arms: DataFrame, min_p: float = 0.01) -> DataFrame:
    """Chi-square fit of the arm sizes to an equal split, of two arms or more."""
    all_arms = Window.partitionBy()
    expected = F.sum("users").over(all_arms) / F.count("*").over(all_arms)
    distance = F.pow(F.col("users") - F.col("expected"), 2) / F.col("expected")
    totals = (
        arms.withColumn("expected", expected)
        .agg(F.sum(distance).alias("chi2"), F.count("*").alias("arms"))
        .select("chi2", (F.col("arms") - 1).cast("int").alias("df"))
    )
    p = F.when(F.col("df") >= 1, chi_square_tail(F.col("chi2"), F.col("df")))
    return totals.withColumn("p_value", p).withColumn("passed", F.col("p_value") > min_p)


def ab_balance(assignments: DataFrame, orders: DataFrame) -> DataFrame:
    """Traits of the first order per arm, settled before assignment; cancelled
    first orders count."""
    return (
        assignments.select("variant", F.col("first_order_id").alias("order_id"))
        .join(orders.select("order_id", "gmv", "is_late", "rating"), "order_id")
        .groupBy("variant")
        .agg(
            F.count("*").alias("users"),
            F.round(money_mean("gmv"), 1).alias("first_order_aov"),
            F.round(percent_of_flags("is_late"), 2).alias("first_late_pct"),
            F.round(measured_mean("rating"), 3).alias("first_rating"),
        )
    )


def _outcome(days: int) -> str:
    return f"repeat_within_{days}d"


def ab_primary(assignments: DataFrame, days: int = 14, by: Sequence[str] = ()) -> DataFrame:
    """Users, conversions and conversion rate per arm, and per ``by`` group if given.
    ``days`` is the window of the outcome, and names the rate."""
    outcome = _outcome(days)
    return assignments.groupBy(*by, "variant").agg(
        F.count("*").alias("n"),
        F.sum(outcome).alias("conversions"),
        F.round(percent_of_flags(outcome), 3).alias(f"repeat_{days}d_pct"),
    )


def _beside_control(rates: DataFrame, by: Sequence[str], **values: str) -> DataFrame:
    """Every arm, with the control arm's ``values`` of its ``by`` group beside it. The control's own
    row stays only where it has no other arm to be compared with."""
    group = Window.partitionBy(*by)
    is_control = F.col("variant").eqNullSafe(CONTROL)
    beside = rates.withColumns(
        {name: F.max(F.when(is_control, F.col(value))).over(group) for name, value in values.items()}
    ).withColumn("others", F.count(F.when(~is_control, 1)).over(group))
    return beside.filter(~is_control | (F.col("others") == 0))


def _against_control(rates: DataFrame, by: Sequence[str]) -> DataFrame:
    other = ~F.col("variant").eqNullSafe(CONTROL)
    return _beside_control(rates, by, control_n="n", x_c="conversions").select(
        *by,
        F.when(other, F.col("variant")).alias("variant"),
        "control_n",
        F.when(other, F.col("n")).alias("treatment_n"),
        F.col("x_c").cast("double").alias("x_c"),
        F.when(other, F.col("conversions")).cast("double").alias("x_t"),
    )


def ab_readout(
    rates: DataFrame, by: Sequence[str] = (), alpha: float = 0.05, rounded: bool = True
) -> DataFrame:
    """Lift, confidence interval and significance of each arm against the control, one row per
    ``by`` group and arm.

    ``rates`` has the columns of :func:`ab_primary`. The test pools the arms; the
    interval does not.
    """
    n_c, n_t = F.col("control_n").cast("double"), F.col("treatment_n").cast("double")
    arms = (
        _against_control(rates, by)
        .withColumn("p_c", F.try_divide(F.col("x_c"), n_c))
        .withColumn("p_t", F.try_divide(F.col("x_t"), n_t))
        .withColumn("se_c", standard_error(F.col("p_c"), n_c))
        .withColumn("se_t", standard_error(F.col("p_t"), n_t))
        .withColumn("lift", F.col("p_t") - F.col("p_c"))
        .withColumn(
            "margin",
            F.lit(critical_z(alpha))
            * F.sqrt(F.col("se_t") * F.col("se_t") + F.col("se_c") * F.col("se_c")),
        )
        .withColumn("z", pooled_z(F.col("x_t"), n_t, F.col("x_c"), n_c))
        .withColumn("p_value", two_sided_p(F.col("z")))
    )

    def shown(value, places):
        return rounded_if(rounded, F.lit(100.0) * value, places)

    return arms.select(
        *by,
        "variant",
        "control_n",
        "treatment_n",
        shown(F.col("p_c"), 3).alias("control_rate_pct"),
        shown(F.col("p_t"), 3).alias("treatment_rate_pct"),
        shown(F.col("se_c"), 3).alias("se_control_pct"),
        shown(F.col("se_t"), 3).alias("se_treatment_pct"),
        shown(F.col("lift"), 3).alias("abs_lift_pp"),
        rounded_if(
            rounded, F.try_divide(F.lit(100.0) * F.col("lift"), F.col("p_c")), 2
        ).alias("rel_lift_pct"),
        shown(F.col("lift") - F.col("margin"), 3).alias("ci_low_pp"),
        shown(F.col("lift") + F.col("margin"), 3).alias("ci_high_pp"),
        rounded_if(rounded, F.col("z"), 3).alias("z_stat"),
        "p_value",
        F.when(F.col("p_value") < 1e-4, "< 0.0001")
        .otherwise(F.format_string("%.4f", "p_value"))
        .alias("p_value_str"),
        (F.col("p_value") < alpha).alias("significant_at_5pct"),
    )


def ab_power(
    rates: DataFrame,
    mde: float = 0.02,
    alpha: float = 0.05,
    power: float = 0.80,
    by: Sequence[str] = (),
) -> DataFrame:
    """Whether the smaller of the control and each other arm is large enough to see an absolute
    lift of ``mde`` over the control rate."""
    arms = _against_control(rates, by)
    base_rate = F.try_divide(F.col("x_c"), F.col("control_n").cast("double"))
    return arms.select(
        *by,
        "variant",
        F.lit(100.0 * mde).alias("planned_mde_pp"),
        required_per_arm(base_rate, mde, alpha, power).alias("required_n_per_arm"),
        F.least("control_n", "treatment_n").alias("actual_min_n_per_arm"),
    ).withColumn("powered", F.col("actual_min_n_per_arm") >= F.col("required_n_per_arm"))


def ab_guardrails(assignments: DataFrame, rounded: bool = True) -> DataFrame:
    """Second-order value, cancellations and coupon cost per arm. Users without a
    second order do not enter the means."""
    return assignments.groupBy("variant").agg(
        F.count("*").alias("n"),
        rounded_if(rounded, measured_mean("second_order_aov"), 1).alias("second_order_aov"),
        rounded_if(rounded, percent_of_flags("second_order_cancelled"), 2).alias(
            "second_cancel_pct"
        ),
        rounded_if(rounded, F.sum("coupon_cost"), 0).alias("total_coupon_cost"),
    )


def ab_by_segment(assignments: DataFrame, orders: DataFrame, days: int = 14) -> DataFrame:
    """The primary metric split by whether the first delivery was late."""
    outcome = _outcome(days)
    segment = F.when(F.col("is_late") == 1, LATE_SEGMENT).otherwise(ON_TIME_SEGMENT)
    return (
        assignments.select("variant", outcome, F.col("first_order_id").alias("order_id"))
        .join(orders.select("order_id", "is_late"), "order_id")
        .groupBy(segment.alias("segment"), "variant")
        .agg(
            F.count("*").alias("n"),
            F.sum(outcome).alias("conversions"),
            F.round(percent_of_flags(outcome), 2).alias(f"repeat_{days}d_pct"),
        )
    )


def ab_lift(rates: DataFrame, by: Sequence[str] = (), days: int = 14) -> DataFrame:
    """Each arm's rate minus the control's, absolute and relative, as shown in reports:
    from the rates that :func:`ab_primary` or :func:`ab_by_segment` display."""
    rate = f"repeat_{days}d_pct"
    other = ~F.col("variant").eqNullSafe(CONTROL)
    lift = F.when(other, F.col(rate) - F.col("c"))
    return _beside_control(rates, by, c=rate).select(
        *by,
        F.when(other, F.col("variant")).alias("variant"),
        F.round(lift, 2).alias("lift_pp"),
        F.round(F.try_divide(F.lit(100.0) * lift, F.col("c")), 1).alias("rel_lift_pct"),
    )


def ab_segment_lift(by_segment: DataFrame, days: int = 14) -> DataFrame:
    """The lift within each segment."""
    return ab_lift(by_segment, by=["segment"], days=days)
