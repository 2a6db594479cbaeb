import datetime as dt

import pytest
from pyspark.sql import functions as F

import brute
from conftest import plan_of, rows
from tidemark.operators.first_orders import enrich_orders, first_n_orders, repeat_flags


def flags(frame):
    return {row["user_id"]: row["repeated"] for row in frame.collect()}


def test_repeat_window_includes_its_last_instant(make):
    orders = make.orders(
        {"user_id": 1, "order_ts": "2026-01-05 12:00:00"},
        {"user_id": 1, "order_ts": "2026-02-04 12:00:00"},
        {"user_id": 2, "order_ts": "2026-01-05 12:00:00"},
        {"user_id": 2, "order_ts": "2026-02-04 12:01:00"},
        {"user_id": 3, "order_ts": "2026-01-05 12:00:00"},
        {"user_id": 3, "order_ts": "2026-01-05 12:00:00"},
        {"user_id": 4, "order_ts": "2026-01-05 12:00:00"},
        {"user_id": 4, "order_ts": "2026-01-05 12:01:00"},
    )
    assert flags(repeat_flags(orders, "2026-06-30")) == {1: 1, 2: 0, 3: 0, 4: 1}


def test_maturity_cut_is_inclusive(make):
    orders = make.orders(
        {"user_id": 1, "order_ts": "2026-05-31 00:00:00"},
        {"user_id": 2, "order_ts": "2026-05-31 00:01:00"},
    )
    assert flags(repeat_flags(orders, "2026-06-30")) == {1: 0}


def test_first_order_is_the_first_delivered_one(make):
    orders = make.orders(
        {"user_id": 1, "order_ts": "2026-01-01 10:00:00", "status": "cancelled"},
        {"user_id": 1, "order_ts": "2026-02-01 10:00:00"},
        {"user_id": 1, "order_ts": "2026-02-20 10:00:00", "status": "cancelled"},
    )
    (row,) = repeat_flags(orders, "2026-06-30").collect()
    assert row["first_ts"] == dt.datetime(2026, 2, 1, 10)
    assert row["repeated"] == 0


def test_slots_are_cut_alike_before_1970(make):
    orders = make.orders(
        {"user_id": 1, "order_ts": "1969-12-20 12:00:00"},
        {"user_id": 1, "order_ts": "1970-01-25 12:00:00"},
        {"user_id": 2, "order_ts": "1969-12-20 12:00:00"},
        {"user_id": 2, "order_ts": "1970-01-19 12:00:00"},
    )
    assert flags(repeat_flags(orders, "2026-06-30")) == {1: 0, 2: 1}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("days", [1, 7, 30])
def test_repeat_flags_match_brute_force(make, seed, days):
    history = brute.history(seed)
    as_of = dt.datetime(2026, 3, 20)
    got = flags(repeat_flags(make.orders(*history), as_of, days))
    assert got == brute.repeat_flags(history, as_of, days)


def test_repeat_window_takes_whole_days_only(make):
    orders = make.orders({"user_id": 1, "order_ts": "2026-01-01 10:00:00"})
    for bad in (0, 0.5):
        with pytest.raises(ValueError):
            repeat_flags(orders, "2026-06-30", bad)


def test_users_are_windowed_only_after_a_rollup(make):
    plan = plan_of(
        repeat_flags(make.orders({"user_id": 1, "order_ts": "2026-01-01 10:00:00"}), "2026-06-30")
    )
    window, _, below = plan.partition("Window [")[2].partition("HashAggregate")
    assert "Exchange hashpartitioning(user_id" in window
    assert "partial_min" in below


@pytest.mark.parametrize("unit", ["hour", "day"])
@pytest.mark.parametrize("seed", range(3))
def test_order_numbers_match_brute_force(make, seed, unit):
    history = brute.history(seed)
    bare = make.orders(*history).drop("order_seq")
    numbered = enrich_orders(bare, unit=unit).collect()
    assert len(numbered) == len(history)
    assert {row["order_id"]: row["order_seq"] for row in numbered} == brute.sequence(history)


def test_lateness_is_derived_with_a_grace_period(make):
    bare = make.orders(
        {"user_id": 1, "order_ts": "2026-01-01 10:00:00", "delivery_minutes": 42.0},
        {"user_id": 2, "order_ts": "2026-01-01 10:00:00", "delivery_minutes": 42.1},
        {"user_id": 3, "order_ts": "2026-01-01 10:00:00", "delivery_minutes": None},
    ).drop("order_seq", "is_late")
    found = rows(enrich_orders(bare), "user_id")
    assert [found[user]["is_late"] for user in (1, 2, 3)] == [0, 1, None]


def test_supplied_columns_are_kept(make):
    orders = make.orders({"user_id": 1, "order_ts": "2026-01-01 10:00:00", "order_seq": 7})
    assert rows(enrich_orders(orders))[0]["order_seq"] == 7


def test_first_n_orders_limits_rows_before_the_shuffle(make):
    history = brute.history(5)
    bare = make.orders(*history).drop("order_seq")
    first_two = first_n_orders(bare, 2)
    plan = plan_of(first_two)
    assert plan.count("WindowGroupLimit") == 2
    want = {k: v for k, v in brute.sequence(history).items() if v <= 2}
    assert {r["order_id"]: r["order_seq"] for r in first_two.collect()} == want


def test_other_columns_survive_enrichment(make):
    bare = make.orders({"user_id": 1, "order_ts": "2026-01-01 10:00:00"}).drop("order_seq")
    enriched = enrich_orders(bare)
    assert enriched.columns == [*bare.columns, "order_seq"]
    assert enriched.agg(F.sum("gmv")).first()[0] == 100


def test_orders_without_a_user_are_numbered_but_repeat_nothing(make):
    orders = make.orders(
        {"order_id": 1, "user_id": None, "order_ts": "2026-01-01 10:00:00"},
        {"order_id": 2, "user_id": None, "order_ts": "2026-01-09 10:00:00"},
        {"order_id": 3, "user_id": 5, "order_ts": "2026-01-09 10:00:00"},
    )
    numbered = enrich_orders(orders.drop("order_seq")).collect()
    assert {r["order_id"]: r["order_seq"] for r in numbered} == {1: 1, 2: 2, 3: 1}
    assert [r["user_id"] for r in repeat_flags(orders, "2026-06-01").collect()] == [5]
