"""What each finding is worth in a year."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.experiment import CONTROL, TREATMENT
from tidemark.operators.metrics import LAKH


def one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row frames side by side: a union that an aggregate folds up."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])


def second_order_values(guardrails: DataFrame) -> DataFrame:
    def aov_of(arm: str):
        return F.max(F.when(F.col("variant") == arm, F.col("second_order_aov")))

    return guardrails.agg(aov_of(CONTROL).alias("aov_c"), aov_of(TREATMENT).alias("aov_t"))


def worst_first() -> Column:
    """All city and daypart cells of a group as an array, the highest late rate first."""
    cell = F.struct((-F.col("late_rate_pct")).alias("order"), "city", "daypart", "late_rate_pct")
    return F.array_sort(F.collect_list(cell))


def impact_model(
    headline: DataFrame,
    repeat: DataFrame,
    extra_orders: DataFrame,
    leak: DataFrame,
    stratified: DataFrame,
    readout: DataFrame,
    guardrails: DataFrame,
    worst: DataFrame | None = None,
    *,
    months: float = 6.0,
    share_recovered: float = 0.5,
    late_rate_cut: float = 0.06,
    coupon: float = 75.0,
    rounded_inputs: bool = False,
) -> DataFrame:
    """One row of yearly effects, in orders, users and lakhs of GMV.

    The inputs are the one-row results of the operators they are named after, and
    the guardrails per arm. Build those with ``rounded=False`` for exact figures,
    or set ``rounded_inputs`` to multiply them as a report displays them.
    ``worst`` adds the worst city and daypart cells as an array, the worst first.

    Every assumption is a parameter: half of the platform gap is recoverable, the
    late rate falls by six points, and every treated user who repeats takes the
    coupon and trades down on the second order.
    """

    inputs = [
        headline.select("aov"),
        repeat.select("matured_new_users"),
        extra_orders.select("extra_orders"),
        leak.select("recoverable_orders_6mo"),
        stratified.select("adjusted_gap_pp"),
        readout.filter(F.col("variant") == TREATMENT).select("abs_lift_pp", "treatment_rate_pct"),
        second_order_values(guardrails),
    ]
    if worst is not None:
        inputs.append(worst.agg(worst_first().alias("lateness_worst_cells")))
    return yearly_effects(
        *inputs,
        months=months,
        share_recovered=share_recovered,
        late_rate_cut=late_rate_cut,
        coupon=coupon,
        rounded_inputs=rounded_inputs,
    )


def yearly_effects(
    *frames: DataFrame,
    months: float = 6.0,
    share_recovered: float = 0.5,
    late_rate_cut: float = 0.06,
    coupon: float = 75.0,
    rounded_inputs: bool = False,
) -> DataFrame:
    """The model over one-row frames that hold its inputs between them: aov, matured_new_users, extra_orders,
    recoverable_orders_6mo, adjusted_gap_pp, abs_lift_pp, treatment_rate_pct, aov_c, aov_t, and
    lateness_worst_cells if wanted."""
    inputs = one_row(*frames)
    worst = "lateness_worst_cells" in inputs.columns
    if rounded_inputs:
        displayed = {
            "aov": 0,
            "extra_orders": 2,
            "recoverable_orders_6mo": 0,
            "adjusted_gap_pp": 2,
            "abs_lift_pp": 3,
            "treatment_rate_pct": 3,
            "aov_c": 1,
            "aov_t": 1,
        }
        inputs = inputs.withColumns({n: F.round(n, places) for n, places in displayed.items()})

    a_year = 12.0 / months
    new_users = F.col("matured_new_users").cast("double") * a_year
    per_retained = F.col("extra_orders") * F.col("aov")
    repeaters = new_users * (F.col("treatment_rate_pct") / 100.0)
    model = inputs.withColumns(
        {
            "android": F.col("recoverable_orders_6mo") * share_recovered * a_year * F.col("aov"),
            "saved": new_users * late_rate_cut * (F.col("adjusted_gap_pp") / 100.0),
            "won": new_users * (F.col("abs_lift_pp") / 100.0),
            "aov_delta": F.col("aov_c") - F.col("aov_t"),
            "coupons": repeaters * coupon,
        }
    ).withColumns(
        {
            "lateness": F.col("saved") * per_retained,
            "gross": F.col("won") * per_retained,
            "traded_down": repeaters * F.col("aov_delta"),
        }
    )
    model = model.withColumn("net", F.col("gross") - F.col("coupons") - F.col("traded_down"))

    def lakhs(value):
        return F.round(value / LAKH, 1)

    without_order = F.transform(
        "lateness_worst_cells",
        lambda c: F.struct(
            c["city"].alias("city"), c["daypart"].alias("daypart"), c["late_rate_pct"].alias("late_rate_pct")
        ),
    )
    return model.select(
        F.round("aov", 0).alias("aov_used"),
        F.col("extra_orders").alias("orders_per_retained_user_measured"),
        F.round("recoverable_orders_6mo", 0).alias("android_recoverable_orders_6mo"),
        lakhs(F.col("android")).alias("android_fix_gmv_lakh_yr"),
        F.round("adjusted_gap_pp", 2).alias("adjusted_lateness_gap_pp"),
        F.lit(100.0 * late_rate_cut).alias("lateness_late_rate_reduction_assumed_pp"),
        F.round("saved", 0).alias("lateness_fix_users_saved_yr"),
        lakhs(F.col("lateness")).alias("lateness_fix_gmv_lakh_yr"),
        F.round("won", 0).alias("nudge_incremental_users_yr"),
        lakhs(F.col("gross")).alias("nudge_gross_gmv_lakh_yr"),
        lakhs(F.col("coupons")).alias("nudge_coupon_cost_lakh_yr"),
        lakhs(F.col("traded_down")).alias("nudge_aov_guardrail_cost_lakh_yr"),
        F.round("aov_delta", 1).alias("nudge_aov_delta_rupees"),
        lakhs(F.col("net")).alias("nudge_net_gmv_lakh_yr"),
        lakhs(F.col("android") + F.col("lateness") + F.col("net")).alias("total_gmv_lakh_yr"),
        *([without_order.alias("lateness_worst_cells")] if worst else []),
    )
