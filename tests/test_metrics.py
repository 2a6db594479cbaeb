from conftest import one, rows
from tidemark.operators import metrics


def sample(make):
    users = make.users({"user_id": 1}, {"user_id": 2}, {"user_id": 3})
    orders = make.orders(
        {"user_id": 1, "order_ts": "2026-01-05 12:00:00", "gmv": 100, "is_late": 1, "rating": 3.0},
        {"user_id": 1, "order_ts": "2026-02-01 23:54:00", "gmv": 201, "is_late": None, "rating": None},
        {"user_id": 2, "order_ts": "2026-02-02 11:00:00", "gmv": 300},
        {"user_id": 2, "order_ts": "2026-02-03 11:00:00", "gmv": 999, "status": "cancelled"},
    )
    return users, orders


def test_headline(make):
    assert one(metrics.headline(*sample(make))) == {
        "registered_users": 3,
        "ordering_users": 2,
        "activation_rate_pct": 66.7,
        "orders": 3,
        "gmv": 601.0,
        "aov": 200.0,
        "orders_per_ordering_user": 1.5,
        "late_delivery_rate_pct": 50.0,
        "avg_rating": 3.5,
    }


def test_headline_of_nothing_is_null_not_an_error(make):
    row = one(metrics.headline(make.users(), make.orders()))
    assert row["registered_users"] == 0 and row["orders"] == 0
    assert row["activation_rate_pct"] is None and row["aov"] is None


def test_headline_unrounded(make):
    row = one(metrics.headline(*sample(make), rounded=False))
    assert row["aov"] == 601 / 3


def test_repeat_rate(make):
    orders = sample(make)[1]
    assert one(metrics.repeat_rate(orders, "2026-06-30")) == {
        "matured_new_users": 2,
        "repeated_users": 1,
        "repeat_30d_rate_pct": 50.0,
    }
    assert "repeat_7d_rate_pct" in metrics.repeat_rate(orders, "2026-06-30", 7).columns


def test_monthly_trend_skips_cancelled_orders(make):
    trend = rows(metrics.monthly_trend(sample(make)[1]), "month")
    assert set(trend) == {"2026-01", "2026-02"}
    assert trend["2026-02"] == {
        "month": "2026-02",
        "active_users": 2,
        "orders": 2,
        "gmv_lakh": 0.0,
        "aov": 251.0,
        "late_rate_pct": 0.0,
        "discount_pct_of_gmv": 4.0,
    }


def test_guardrails_count_cancelled_orders(make):
    found = rows(metrics.guardrails(sample(make)[1]), "month")["2026-02"]
    assert found["cancel_rate_pct"] == 33.33
    assert found["discount_pct_of_gmv"] == 2.0
    assert found["net_revenue_per_order"] == 490.0


def test_extra_orders_and_hours(make):
    orders = sample(make)[1]
    assert one(metrics.extra_orders_per_retained_user(orders)) == {"extra_orders": 1.0}
    hours = {row["hour"]: row["orders"] for row in metrics.hour_of_day(orders).collect()}
    assert hours == {12: 1, 23: 1, 11: 1}
