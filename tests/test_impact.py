from conftest import one
from tidemark.operators.impact import impact_model


# Published figures, here and below.
def inputs(spark, aov=447.0, extra=2.72):
    def row(schema, *values):
        return spark.createDataFrame([values], schema)

    guardrails = spark.createDataFrame(
        [("control", 431.2), ("treatment", 404.9)], "variant string, second_order_aov double"
    )
    return [
        row("aov double", aov),
        row("matured_new_users long", 31727),
        row("extra_orders double", extra),
        row("recoverable_orders_6mo double", 15491.0),
        row("adjusted_gap_pp double", 11.78),
        row("variant string, abs_lift_pp double, treatment_rate_pct double", "treatment", 3.291, 22.277),
        guardrails,
    ]


PUBLISHED = {
    "aov_used": 447.0,
    "orders_per_retained_user_measured": 2.72,
    "android_recoverable_orders_6mo": 15491.0,
    "android_fix_gmv_lakh_yr": 69.2,
    "adjusted_lateness_gap_pp": 11.78,
    "lateness_late_rate_reduction_assumed_pp": 6.0,
    "lateness_fix_users_saved_yr": 448.0,
    "lateness_fix_gmv_lakh_yr": 5.5,
    "nudge_incremental_users_yr": 2088.0,
    "nudge_gross_gmv_lakh_yr": 25.4,
    "nudge_coupon_cost_lakh_yr": 10.6,
    "nudge_aov_guardrail_cost_lakh_yr": 3.7,
    "nudge_aov_delta_rupees": 26.3,
    "nudge_net_gmv_lakh_yr": 11.1,
    "total_gmv_lakh_yr": 85.8,
}


def test_published_figures(spark):
    assert one(impact_model(*inputs(spark))) == PUBLISHED


def test_rounded_inputs_multiply_what_a_report_shows(spark):
    exact = inputs(spark, aov=446.7, extra=2.7213)
    assert one(impact_model(*exact, rounded_inputs=True)) == PUBLISHED
    assert one(impact_model(*exact)) != PUBLISHED


def test_worst_cells_and_assumptions(spark):
    worst = spark.createDataFrame(
        [("Pune", "Dinner peak", 38.0)], "city string, daypart string, late_rate_pct double"
    )
    row = one(impact_model(*inputs(spark), worst, share_recovered=1.0, months=12.0))
    assert [tuple(cell) for cell in row["lateness_worst_cells"]] == [("Pune", "Dinner peak", 38.0)]
    assert row["android_fix_gmv_lakh_yr"] == 69.2
    assert row["lateness_fix_users_saved_yr"] == 224.0
