import pytest

from conftest import one, plan_of, rows
from tidemark.operators import drivers

AS_OF = "2026-06-30"


def features(make, *orders, users=None, **options):
    made = make.orders(*orders)
    ids = sorted({order["user_id"] for order in orders})
    users = users or make.users(*[{"user_id": i} for i in ids])
    return drivers.first_order_features(users, made, AS_OF, **options)


def first(user, **extra):
    return {"user_id": user, "order_ts": "2026-01-05 12:00:00", **extra}


def second(user, **extra):
    return {"user_id": user, "order_ts": "2026-01-15 12:00:00", **extra}


def test_orders_that_share_the_first_instant_all_appear(make):
    orders = [
        first(1, order_id=11, rating=5.0),
        first(1, order_id=10, rating=1.0, status="cancelled"),
        second(1, order_id=12),
    ]
    found = rows(features(make, *orders))
    assert sorted(row["rating"] for row in found) == [1.0, 5.0]
    assert all(row["repeated_30d"] == 1 for row in found)
    assert [row["rating"] for row in rows(features(make, *orders, ties="first"))] == [1.0]
    with pytest.raises(ValueError):
        features(make, *orders, ties="some")


def test_minutes_late_is_rounded_to_a_tenth(make):
    row = one(features(make, first(1, delivery_minutes=42.06)))
    assert row["minutes_late"] == 10.1


def test_repeat_by_late_counts_unknown_as_on_time(make):
    frame = features(make, first(1, is_late=1), first(2, is_late=None), first(3), second(3))
    found = rows(drivers.repeat_by_late(frame), "first_delivery")
    assert found["Late"]["users"] == 1 and found["On time"]["users"] == 2
    assert found["On time"]["repeat_30d_pct"] == 50.0


def test_buckets_include_their_upper_edge_and_unknown_is_last(make):
    minutes = [31.0, 32.0, 32.1, 42.0, 42.1, 52.0, 62.0, 62.1, None]
    frame = features(
        make, *[first(i, delivery_minutes=m, is_late=0) for i, m in enumerate(minutes)]
    )
    found = rows(drivers.dose_response(frame), "lateness_bucket")
    assert [found[label]["users"] for label in drivers.LATENESS_LABELS] == [2, 2, 2, 1, 2]
    assert sum(row["users"] for row in found.values()) == len(minutes)


def test_cells_need_twenty_users_on_both_sides(make):
    def cell(city, start, late, on_time, late_repeat, on_repeat):
        made, user = [], start
        for count, flag, repeats in ((late, 1, late_repeat), (on_time, 0, on_repeat)):
            for k in range(count):
                made.append(first(user, city=city, is_late=flag))
                if k < repeats:
                    made.append(second(user, city=city))
                user += 1
        return made

    orders = cell("Pune", 0, 20, 20, 5, 10) + cell("Delhi", 100, 19, 30, 19, 0)
    orders += cell("Mumbai", 200, 20, 40, 2, 20)
    got = one(drivers.repeat_by_late_stratified(features(make, *orders)))
    # gaps .25 on 40 users and .40 on 60 users
    assert got == {
        "cells_used": 2,
        "users_covered": 100,
        "adjusted_gap_pp": 34.0,
        "wtd_ontime_pct": 50.0,
        "wtd_late_pct": 16.0,
    }


def test_no_cell_left_gives_null(make):
    got = one(drivers.repeat_by_late_stratified(features(make, first(1))))
    assert got["cells_used"] == 0 and got["adjusted_gap_pp"] is None


def test_breakdowns(make):
    users = make.users(
        {"user_id": 1, "is_member": 1, "acquisition_channel": "referral"},
        {"user_id": 2},
        {"user_id": 3},
    )
    frame = features(
        make, first(1, rating=4.5), second(1), first(2, rating=3.5), first(3, rating=None), users=users
    )
    result = drivers.repeat_by_segment(frame)
    found = rows(result, "dimension", "value")
    assert found["member", "Member"]["repeat_pct"] == 100.0
    assert found["member", "Non-member"]["users"] == 2
    assert found["city", "Pune"]["repeat_pct"] == 33.33
    assert found["first_rating", "4.5-5.0"]["users"] == 1
    assert found["first_rating", "3.5-4.0"]["users"] == 1
    assert found["first_rating", "<3.5"]["users"] == 1
    overall = frame.sparkSession.createDataFrame([(33.33,)], "repeat_30d_rate_pct double")
    compared = rows(drivers.segment_deviation(result, overall), "dimension", "value")
    assert compared["member", "Member"]["deviation_pp"] == 66.67
    assert compared["member", "Member"]["above"] and not compared["city", "Pune"]["above"]


def test_breakdowns_read_the_features_once(spark, make, tmp_path):
    path = str(tmp_path / "features")
    features(make, first(1), second(1)).write.parquet(path)
    plan = plan_of(drivers.repeat_by_segment(spark.read.parquet(path)))
    assert plan.count("FileScan") == 1


def test_late_gap_uses_exact_counts(spark):
    groups = [(1, 1, 1433), (1, 0, 6999 - 1433), (0, 1, 8071), (0, 0, 24728 - 8071)]
    counted = spark.createDataFrame(groups, "is_late int, repeated_30d int, n int")
    frame = counted.selectExpr("is_late", "repeated_30d", "explode(sequence(1, n))")
    got = one(drivers.late_gap_test(frame))
    assert got["raw_gap_pp"] == 12.16
    assert got["z"] == pytest.approx(-19.61, abs=0.01)
    assert 0 < got["p_value"] < 1e-80


def test_dayparts_include_both_end_hours(make):
    hours = [11, 12, 14, 15, 18, 19, 22, 23]
    orders = make.orders(
        *[{"user_id": 1, "order_ts": f"2026-01-05 {h}:59:00", "is_late": int(h == 19)} for h in hours]
    )
    by_hour = drivers.late_by_city_hour(orders)
    found = rows(by_hour, "daypart")
    assert {part: row["orders"] for part, row in found.items()} == {
        "Lunch peak": 2,
        "Dinner peak": 2,
        "Off peak": 4,
    }
    assert rows(drivers.late_heatmap(by_hour)) == [
        {"city": "Pune", "off_peak": 0.0, "lunch_peak": 0.0, "dinner_peak": 50.0}
    ]
    assert rows(drivers.worst_cells(by_hour, 1)) == [
        {"city": "Pune", "daypart": "Dinner peak", "late_rate_pct": 50.0}
    ]


def test_every_edge_needs_a_label(spark):
    with pytest.raises(ValueError, match="one label more"):
        drivers.dose_response(spark.range(1), edges=(0, 5), labels=("a", "b"))
