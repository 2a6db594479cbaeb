import random
import uuid

import pytest
from conftest import plan_of, rows

from tidemark.operators import first_orders, retention, segments, user_days


@pytest.fixture(scope="module")
def orders(make):
    """One user has a third of all orders; some orders have no user."""
    rng = random.Random(8)
    made = [
        {"user_id": rng.choice([1, rng.randrange(2, 60), rng.choice([None, 3])]), "gmv": rng.randrange(50, 900),
         "order_ts": f"2026-0{rng.randrange(1, 7)}-{rng.randrange(1, 28):02d} {rng.randrange(24):02d}:{rng.randrange(60):02d}:00",
         "status": rng.choice(["delivered"] * 5 + ["cancelled"])}
        for _ in range(700)
    ]
    return make.orders(*made)


@pytest.fixture(scope="module")
def saved(orders, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("days") / "table")
    return user_days.write_by_user(user_days.user_days(orders), f"days_{uuid.uuid4().hex}", path, 6), path


def same(one, other):
    assert sorted(map(str, rows(one))) == sorted(map(str, rows(other)))


def test_operators_give_what_they_give_on_orders(orders, saved):
    days, as_of = saved[0], "2026-06-20"
    for window in (14, 30):
        same(user_days.repeat_flags(days, as_of, window), first_orders.repeat_flags(orders, as_of, window))
    same(user_days.cohort_matrix(days), retention.cohort_matrix(orders))
    same(user_days.rfm_scores(days, as_of), segments.rfm_scores(orders.filter("user_id is not null"), as_of))


def test_per_user_steps_need_no_exchange(orders, saved):
    days = saved[0]
    assert "Exchange" not in plan_of(user_days.repeat_flags(days, "2026-06-20"))
    assert "Exchange" in plan_of(first_orders.repeat_flags(orders, "2026-06-20"))
    plan = plan_of(user_days.cohort_matrix(days))
    below = plan[plan.index("month#") :].split("Window")[-1]  # from the window by user down to the scan
    assert "Exchange" not in below and "Bucketed: true" in below


def test_a_user_with_very_many_orders_has_no_more_rows_than_days(orders):
    days = user_days.user_days(orders)
    hot = {r["user_id"]: r["count"] for r in rows(days.groupBy("user_id").count())}[1]
    assert hot <= 6 * 27 < orders.filter("user_id = 1").count()
    # orders are summed up in the map tasks before they are shuffled
    plan = plan_of(days)
    assert plan.index("Exchange") < plan.rindex("HashAggregate")


def test_days_merge(orders):
    one, other = orders.filter("order_id % 3 = 0"), orders.filter("order_id % 3 <> 0")
    merged = user_days.merged_days(user_days.user_days(one), user_days.user_days(other))
    same(merged, user_days.user_days(orders))


def test_a_saved_table_is_made_known_again(spark, saved):
    days, path = saved
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in days.schema.fields)
    again = user_days.register_by_user(spark, f"days_{uuid.uuid4().hex}", path, schema, 6)
    same(again, days)
    assert "Exchange" not in plan_of(user_days.repeat_flags(again, "2026-06-20"))
