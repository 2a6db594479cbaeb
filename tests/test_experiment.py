import math

import pytest
from pyspark.sql import functions as F

from conftest import one, rows
from tidemark.functions.statistics import chi_square_tail, erfc
from tidemark.operators import experiment


# Published figures, here and below.
@pytest.fixture(scope="module")
def published(spark):
    return spark.createDataFrame(
        [("control", 9681, 1838, 18.986), ("treatment", 9620, 2143, 22.277)],
        "variant string, n long, conversions long, repeat_14d_pct double",
    )


def test_erfc_follows_the_exact_function(spark):
    points = spark.range(0, 700).select((F.col("id") / 100).alias("x"))
    for row in points.withColumn("y", erfc(F.col("x"))).collect():
        assert row["y"] == pytest.approx(math.erfc(row["x"]), rel=1e-11)


def test_readout_of_the_published_counts(published):
    got = one(experiment.ab_readout(published))
    assert got.pop("p_value") == pytest.approx(1.6076702857859e-08, rel=1e-6)
    assert got == {
        "variant": "treatment",
        "control_n": 9681,
        "treatment_n": 9620,
        "control_rate_pct": 18.986,
        "treatment_rate_pct": 22.277,
        "se_control_pct": 0.399,
        "se_treatment_pct": 0.424,
        "abs_lift_pp": 3.291,
        "rel_lift_pct": 17.33,
        "ci_low_pp": 2.15,
        "ci_high_pp": 4.432,
        "z_stat": 5.65,
        "p_value_str": "< 0.0001",
        "significant_at_5pct": True,
    }


def test_power_of_the_published_counts(published):
    assert one(experiment.ab_power(published)) == {
        "variant": "treatment",
        "planned_mde_pp": 2.0,
        "required_n_per_arm": 6275,
        "actual_min_n_per_arm": 9620,
        "powered": True,
    }


def test_many_experiments_in_one_job(published):
    twice = published.withColumn("segment", F.lit("a")).unionByName(
        published.withColumn("segment", F.lit("b")).withColumn("conversions", F.lit(1838))
    )
    found = rows(experiment.ab_readout(twice, by=["segment"]), "segment")
    assert found["a"]["z_stat"] == 5.65
    assert not found["b"]["significant_at_5pct"]
    assert found["b"]["p_value_str"] == f"{found['b']['p_value']:.4f}"
    assert set(rows(experiment.ab_power(twice, by=["segment"]), "segment")) == {"a", "b"}


def test_an_empty_arm_gives_null(spark):
    lone = spark.createDataFrame(
        [("control", 10, 1, 10.0)], "variant string, n long, conversions long, repeat_14d_pct double"
    )
    row = one(experiment.ab_readout(lone))
    assert row["treatment_n"] is None and row["z_stat"] is None


def test_sample_ratio(spark):
    arms = spark.createDataFrame([("control", 9681), ("treatment", 9620)], "variant string, users long")
    row = one(experiment.srm_test(arms))
    assert row["df"] == 1 and row["passed"]
    assert row["p_value"] == pytest.approx(0.660606, abs=1e-6)
    three = arms.union(spark.createDataFrame([("third", 9000)], arms.schema))
    row = one(experiment.srm_test(three))
    assert row["df"] == 2 and row["p_value"] == pytest.approx(math.exp(-row["chi2"] / 2), rel=1e-9)


# Fixed values of the chi-square tail, from published tables.
@pytest.mark.parametrize("x, df, p", [(7.814728, 3, 0.05), (13.276704, 4, 0.01), (11.070498, 5, 0.05), (3.841459, 1, 0.05)])
def test_chi_square_tail(spark, x, df, p):
    row = spark.range(1).select(chi_square_tail(F.lit(x), F.lit(df)).alias("p")).first()
    assert row["p"] == pytest.approx(p, rel=1e-5)


def test_every_arm_is_compared_with_the_control(published):
    third = published.sparkSession.createDataFrame([("coupon", 9000, 1900, 21.111)], published.schema)
    found = rows(experiment.ab_readout(published.union(third)), "variant")
    assert set(found) == {"treatment", "coupon"} and found["treatment"]["z_stat"] == 5.65
    assert found["coupon"]["treatment_n"] == 9000 and found["coupon"]["control_n"] == 9681
    assert set(rows(experiment.ab_lift(published.union(third)), "variant")) == {"treatment", "coupon"}
    assert set(rows(experiment.ab_power(published.union(third)), "variant")) == {"treatment", "coupon"}


def test_outcomes_from_orders(make):
    orders = make.orders(
        {"user_id": 1, "order_ts": "2026-04-01 10:00:00", "order_seq": 1, "status": "cancelled"},
        {"user_id": 1, "order_ts": "2026-04-15 10:00:00", "order_seq": 2, "gmv": 500},
        {"user_id": 2, "order_ts": "2026-04-01 10:00:00", "order_seq": 1},
        {"user_id": 2, "order_ts": "2026-04-15 10:01:00", "order_seq": 2},
        {"user_id": 3, "order_ts": "2026-04-02 10:00:00", "order_seq": 1},
        {"user_id": 4, "order_ts": "2026-03-31 10:00:00", "order_seq": 1},
        {"user_id": 5, "order_ts": "2026-04-03 10:00:00", "order_seq": 1},
    )
    arms = orders.sparkSession.createDataFrame(
        [(1, "treatment"), (2, "treatment"), (3, "control"), (4, "control")],
        "user_id long, variant string",
    )
    found = rows(
        experiment.experiment_outcomes(orders, arms, start="2026-04-01", end="2026-06-15"), "user_id"
    )
    assert set(found) == {1, 2, 3}
    assert found[1]["first_order_id"] == 1 and found[1]["repeat_within_14d"] == 1
    assert found[1]["second_order_aov"] == 500.0 and found[1]["second_order_cancelled"] == 0.0
    assert found[1]["coupon_cost"] == 75.0
    assert found[2]["repeat_within_14d"] == 0 and found[2]["second_order_aov"] is None
    assert found[2]["coupon_cost"] == 0.0 and found[3]["second_order_cancelled"] is None


def test_arm_tables(make):
    orders = make.orders(
        {"user_id": 1, "order_ts": "2026-04-01 10:00:00", "gmv": 100, "is_late": 1},
        {"user_id": 2, "order_ts": "2026-04-01 10:00:00", "gmv": 200, "is_late": None},
        {"user_id": 3, "order_ts": "2026-04-01 10:00:00", "gmv": 301},
        {"user_id": 4, "order_ts": "2026-04-01 10:00:00", "gmv": 100, "is_late": 1},
    )
    arms = make.assignments(
        {"user_id": 1, "first_order_id": 1, "variant": "control", "repeat_within_14d": 1,
         "second_order_aov": 431.2, "second_order_cancelled": 1.0},
        {"user_id": 2, "first_order_id": 2, "variant": "control"},
        {"user_id": 3, "first_order_id": 3, "variant": "treatment", "repeat_within_14d": 1,
         "second_order_aov": 404.9, "second_order_cancelled": 0.0, "coupon_cost": 75.0},
        {"user_id": 4, "first_order_id": 4, "variant": "treatment", "repeat_within_14d": 1,
         "second_order_aov": 404.9, "second_order_cancelled": 0.0, "coupon_cost": 75.0},
    )
    assert rows(experiment.srm_check(arms), "variant")["control"]["pct"] == 50.0
    balance = rows(experiment.ab_balance(arms, orders), "variant")
    assert balance["control"]["first_order_aov"] == 150.0
    assert balance["control"]["first_late_pct"] == 100.0
    assert balance["treatment"]["first_late_pct"] == 50.0
    primary = rows(experiment.ab_primary(arms), "variant")
    assert primary["control"]["conversions"] == 1 and primary["control"]["repeat_14d_pct"] == 50.0
    guard = rows(experiment.ab_guardrails(arms), "variant")
    assert guard["control"] == {
        "variant": "control", "n": 2, "second_order_aov": 431.2, "second_cancel_pct": 100.0,
        "total_coupon_cost": 0.0,
    }
    assert guard["treatment"]["total_coupon_cost"] == 150.0
    split = experiment.ab_by_segment(arms, orders)
    found = rows(split, "segment", "variant")
    assert found["First delivery ON TIME", "control"]["n"] == 1
    assert found["First delivery LATE", "treatment"]["repeat_14d_pct"] == 100.0
    lifts = rows(experiment.ab_segment_lift(split), "segment")
    assert lifts["First delivery LATE"]["lift_pp"] == 0.0
    assert lifts["First delivery ON TIME"] == {
        "segment": "First delivery ON TIME", "variant": "treatment", "lift_pp": 100.0, "rel_lift_pct": None,
    }


def test_lift_of_the_published_rates(published):
    assert one(experiment.ab_lift(published)) == {"variant": "treatment", "lift_pp": 3.29, "rel_lift_pct": 17.3}
