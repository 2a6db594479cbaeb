import pytest

import brute
from conftest import half_up, rows
from tidemark.operators import retention


def test_cohorts_count_calendar_months_across_years(make):
    orders = make.orders(
        {"user_id": 1, "order_ts": "2025-12-31 23:59:00"},
        {"user_id": 1, "order_ts": "2026-01-01 00:01:00"},
        {"user_id": 2, "order_ts": "2025-12-01 10:00:00"},
        {"user_id": 2, "order_ts": "2026-02-01 10:00:00"},
    )
    matrix = retention.cohort_matrix(orders)
    found = rows(matrix, "cohort_month", "period_index")
    assert {key: row["retention_pct"] for key, row in found.items()} == {
        ("2025-12", 0): 100.0,
        ("2025-12", 1): 50.0,
        ("2025-12", 2): 50.0,
    }
    wide = rows(retention.cohort_pivot(matrix, range(4)))
    assert wide == [
        {"cohort_month": "2025-12", "cohort_size": 2, "m0": 100.0, "m1": 50.0, "m2": 50.0, "m3": None}
    ]
    assert rows(retention.cohort_pivot(matrix, range(4), fill=0.0))[0]["m3"] == 0.0


@pytest.mark.parametrize("seed", range(3))
def test_matrix_matches_brute_force(make, seed):
    history = brute.history(seed)
    got = {
        (r["cohort_month"], r["period_index"]): (r["active_users"], r["cohort_size"])
        for r in retention.cohort_matrix(make.orders(*history)).collect()
    }
    assert got == brute.cohort_matrix(history)


def test_late_flag_takes_ties_of_any_status_and_drops_unknown(make):
    orders = make.orders(
        {"user_id": 1, "order_ts": "2026-01-05 12:00:00", "is_late": 0},
        {"user_id": 1, "order_ts": "2026-01-05 12:00:00", "is_late": 1, "status": "cancelled"},
        {"user_id": 2, "order_ts": "2026-01-05 12:00:00", "is_late": None},
        {"user_id": 3, "order_ts": "2026-01-04 12:00:00", "is_late": 1, "status": "cancelled"},
        {"user_id": 3, "order_ts": "2026-01-05 12:00:00", "is_late": 0},
        {"user_id": 3, "order_ts": "2026-02-05 12:00:00", "is_late": 1},
    )
    curve = retention.cohort_by_late(orders)
    found = {(r["segment"], r["period_index"]): r for r in curve.collect()}
    assert set(found) == {
        ("First delivery LATE", 0),
        ("First delivery ON TIME", 0),
        ("First delivery ON TIME", 1),
    }
    assert all(row["cohort_size"] == 1 for row in found.values())
    wide = rows(retention.cohort_by_late_pivot(curve), "period_index")
    assert wide[1] == {
        "period_index": 1,
        "first_delivery_late": None,
        "first_delivery_on_time": 100.0,
    }


@pytest.mark.parametrize("seed", range(3))
def test_late_curve_matches_brute_force(make, seed):
    history = brute.history(seed)
    segments = {1: retention.LATE_SEGMENT, 0: retention.ON_TIME_SEGMENT}
    want = {
        (segments[late], period): (size, half_up(100 * users / size, 1))
        for (late, period), (users, size) in brute.late_curve(history).items()
    }
    got = {
        (r["segment"], r["period_index"]): (r["cohort_size"], r["retention_pct"])
        for r in retention.cohort_by_late(make.orders(*history)).collect()
    }
    assert got == want


def test_the_pivot_holds_every_cell_of_the_matrix(make):
    orders = make.orders(
        {"user_id": 1, "order_ts": "2024-11-03 10:00:00"},
        {"user_id": 1, "order_ts": "2026-06-03 10:00:00"},
        {"user_id": 2, "order_ts": "2025-12-03 10:00:00"},
        {"user_id": None, "order_ts": "2024-01-03 10:00:00"},
    )
    matrix = retention.cohort_matrix(orders)
    cells = {(r["cohort_month"], r["period_index"]): r["retention_pct"] for r in matrix.collect()}
    wide = retention.cohort_pivot(matrix)
    assert wide.columns[2:] == [f"m{k}" for k in range(20)]
    found = {
        (r["cohort_month"], k): r[f"m{k}"] for r in wide.collect() for k in range(20) if r[f"m{k}"] is not None
    }
    assert found == cells and len(cells) == 3


def test_orders_without_a_user_are_in_no_cohort(make):
    orders = make.orders(
        {"user_id": 1, "order_ts": "2026-01-03 10:00:00", "is_late": 1},
        {"user_id": None, "order_ts": "2026-01-04 10:00:00", "is_late": 1},
        {"user_id": None, "order_ts": "2026-02-04 10:00:00", "is_late": 0},
    )
    assert [r["cohort_size"] for r in retention.cohort_matrix(orders).collect()] == [1]
    assert [r["cohort_size"] for r in retention.cohort_by_late(orders).collect()] == [1]
