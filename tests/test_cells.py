"""Roll-ups of cubes give what the operators give on the rows."""

import os

import pytest
from conftest import one, plan_of, rows
from pyspark.sql import functions as F

from __spark_entry__ import SMOKE_DIR
from tidemark.operators import cells, drivers, experiment, first_orders, metrics
from tidemark.plans import catalog
from tidemark.sources.scratch import park

pytestmark = pytest.mark.skipif(not os.path.isdir(SMOKE_DIR), reason="no test tables")


def same(one, other):
    assert sorted(one.columns) == sorted(other.columns)
    key = lambda row: sorted((name, repr(value)) for name, value in row.items())
    assert sorted(map(key, rows(one))) == sorted(map(key, rows(other)))


@pytest.fixture(scope="module")
def orders(spark):
    """With unknown lateness, ratings, cities and prices among them."""
    frame = catalog.orders_of(spark, SMOKE_DIR, city=True, delivery=True)
    gaps = {"is_late": 5, "rating": 7, "city": 11, "gmv": 13, "delivery_minutes": 17}
    return park(
        frame.withColumns({c: F.when(F.col("order_id") % k != 0, F.col(c)) for c, k in gaps.items()}), "orders"
    )


@pytest.fixture(scope="module")
def features(spark, orders):
    return park(drivers.first_order_features(catalog.users_of(spark, SMOKE_DIR), orders, catalog.AS_OF), "features")


@pytest.fixture(scope="module")
def first_cells(features):
    return park(cells.first_order_cells(features), "first-cells")


@pytest.fixture(scope="module")
def order_cells(orders):
    return park(cells.order_cells(orders), "order-cells")


@pytest.fixture(scope="module")
def outcomes(spark, orders):
    found = experiment.experiment_outcomes(
        first_orders.first_n_orders(orders, 2), catalog.variants_of(spark, SMOKE_DIR), catalog.OUTCOME_DAYS
    )
    unknown = F.when(F.col("user_id") % 9 != 0, F.col("first_order_id"))  # first orders nobody has
    return park(found.withColumn("first_order_id", unknown), "outcomes")


@pytest.fixture(scope="module")
def arms(outcomes, orders):
    return park(cells.experiment_cells(outcomes, orders, catalog.OUTCOME_DAYS), "arms")


def test_first_order_roll_ups(features, first_cells):
    same(cells.repeat_by_late(first_cells), drivers.repeat_by_late(features))
    same(cells.late_gap_test(first_cells), drivers.late_gap_test(features))
    same(cells.dose_response(first_cells), drivers.dose_response(features))
    same(cells.repeat_by_segment(first_cells), drivers.repeat_by_segment(features))
    for least in (1, 2, 5, 20):
        same(cells.repeat_by_late_stratified(first_cells, least), drivers.repeat_by_late_stratified(features, least))


def test_order_roll_ups(orders, order_cells):
    same(cells.late_by_city_hour(order_cells), drivers.late_by_city_hour(orders))
    same(cells.hour_of_day(order_cells), metrics.hour_of_day(orders))
    same(cells.guardrails(order_cells), metrics.guardrails(orders))
    row = one(cells.value_and_worst_cells(order_cells, 3))
    worst = rows(drivers.worst_cells(drivers.late_by_city_hour(orders.filter("city is not null")), 30))
    known = [c for c in row["lateness_worst_cells"] if c["city"] is not None]
    assert [c["late_rate_pct"] for c in known] == [w["late_rate_pct"] for w in worst[: len(known)]]
    total = one(orders.filter("status = 'delivered'").agg(F.sum("gmv").alias("s"), F.count("gmv").alias("n")))
    assert row["aov"] == float(total["s"]) / total["n"]


def test_experiment_roll_ups(outcomes, orders, arms):
    days = catalog.OUTCOME_DAYS
    same(cells.srm_check(arms), experiment.srm_check(outcomes))
    same(cells.ab_primary(arms, days), experiment.ab_primary(outcomes, days))
    same(cells.ab_by_segment(arms, days), experiment.ab_by_segment(outcomes, orders, days))
    same(cells.ab_balance(arms), experiment.ab_balance(outcomes, orders))
    for rounded in (True, False):
        same(cells.ab_guardrails(arms, rounded), experiment.ab_guardrails(outcomes, rounded))


def test_a_cube_has_as_many_rows_as_attributes_combine(orders, order_cells):
    assert order_cells.count() == orders.select(
        F.trunc("order_ts", "month"), F.hour("order_ts"), "city", "platform", "status"
    ).distinct().count()


def test_user_summary_serves_repeat_rate_and_extra_orders(make):
    orders = make.orders(
        {"user_id": 1, "order_ts": "2026-01-01 10:00:00"},
        {"user_id": 1, "order_ts": "2026-01-20 10:00:00"},
        {"user_id": 1, "order_ts": "2026-05-20 10:00:00"},
        {"user_id": 2, "order_ts": "2026-01-02 10:00:00"},
        {"user_id": 2, "order_ts": "2026-03-02 10:00:00"},
        {"user_id": 2, "order_ts": "2026-03-03 10:00:00", "status": "cancelled"},
        {"user_id": 3, "order_ts": "2026-06-20 10:00:00"},
        {"user_id": 3, "order_ts": "2026-06-20 11:00:00"},
        {"user_id": None, "order_ts": "2026-01-02 10:00:00"},
        {"user_id": None, "order_ts": "2026-01-03 10:00:00"},
    )
    summary = first_orders.user_summary(orders, "2026-07-01")
    flags = summary.filter("matured").select("user_id", "first_ts", "repeated")
    same(flags, first_orders.repeat_flags(orders, "2026-07-01"))
    row = one(metrics.returning_users(summary))
    assert (row["matured_new_users"], row["repeated_users"]) == (2, 1)
    assert row["extra_orders"] == one(metrics.extra_orders_per_retained_user(orders, rounded=False))["extra_orders"]


def test_impact_model_reads_cubes(spark):
    plan = plan_of(catalog.QUERIES["impact_model"](spark, SMOKE_DIR))
    assert plan.count("FileScan parquet") <= 6


def test_empty_tables_have_empty_cubes(spark, make):
    orders = make.orders()
    assert cells.order_cells(orders).count() == 0
    assert one(cells.value_and_worst_cells(cells.order_cells(orders))) == {"aov": None, "lateness_worst_cells": []}
