import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import monitor, weekly_state
from tidemark.sources.publish import Outrun, latest

START = dt.datetime(2026, 4, 6, 9)


def made(make, seed, users, weeks, sessions=30):
    rng = random.Random(seed)
    when = lambda: str(START + dt.timedelta(days=rng.choice(weeks) * 7 + rng.randrange(7), minutes=rng.randrange(600)))
    orders = [
        {
            "order_id": seed * 1000 + k, "user_id": rng.choice([None, *range(users)]), "order_ts": when(), "is_late": rng.choice([0, 1, None]),
            "rating": rng.choice([None, 3.0, 4.5]), "status": rng.choice(["delivered", "delivered", "cancelled"]), "gmv": rng.randrange(100, 900),
            "delivery_minutes": rng.choice([None, 30.25, 41.5]),
        }
        for k in range(60)
    ]
    events = [(rng.randrange(sessions), rng.randrange(1, 7), "iOS", when()) for _ in range(80)]
    return make.orders(*orders), make.events(*events)


def same(one, other):
    key = lambda frame: sorted((r["metric"], str(r["week_start"]), r["value"] is None, round(r["value"] or 0, 9)) for r in rows(frame))
    assert key(one) == key(other)


@pytest.fixture(scope="module")
def batches(make):
    """The second holds late rows of early weeks, the third a week before all others."""
    return [made(make, 1, 20, range(1, 6)), made(make, 2, 25, [2, 6, 7]), made(make, 3, 10, [0, 7])]


def test_the_state_equals_a_full_recompute(spark, batches, tmp_path):
    state, orders, events = str(tmp_path), None, None
    for k, (new_orders, new_events) in enumerate(batches):
        orders = new_orders if orders is None else orders.unionAll(new_orders)
        events = new_events if events is None else events.unionAll(new_events)
        weekly_state.advance(spark, state, f"b{k}", new_orders, new_events)
        same(weekly_state.weekly_metrics(spark, state), monitor.weekly_metrics(orders, events))


def test_a_run_touches_the_weeks_of_its_batch_only(spark, batches, tmp_path):
    state = str(tmp_path)
    first = weekly_state.advance(spark, state, "a", *batches[0])
    _, before = latest(spark, state)
    second = weekly_state.advance(spark, state, "b", *batches[1])
    _, after = latest(spark, state)
    assert len(first) == 5 and second == ["2026-04-20", "2026-05-18", "2026-05-25"]
    moved = {week for week in after["weeks"] if after["weeks"][week] != before["weeks"].get(week)}
    assert moved == set(second)
    folder = tmp_path / after["weeks"]["2026-04-20"]
    assert sorted(p.name for p in folder.iterdir() if p.is_dir()) == [f"week_start={week}" for week in second]
    # of the members kept so far, a plan reads the touched weeks' folders
    read = weekly_state.touched_members(spark, state, before, second)
    assert {path.split("week_start=")[1][:10] for path in read.inputFiles()} == {"2026-04-20", "2026-05-18"} & set(before["weeks"])


def test_a_batch_that_comes_again_changes_nothing(spark, batches, tmp_path):
    state = str(tmp_path)
    weekly_state.advance(spark, state, "a", *batches[0])
    number, _ = latest(spark, state)
    assert weekly_state.advance(spark, state, "a", *batches[0]) == []
    assert latest(spark, state)[0] == number
    same(weekly_state.weekly_metrics(spark, state), monitor.weekly_metrics(*batches[0]))


def test_a_run_that_fails_leaves_the_state_and_may_come_again(spark, batches, tmp_path):
    state = str(tmp_path)
    weekly_state.advance(spark, state, "a", *batches[0])
    orders, events = batches[1]
    broken = orders.withColumn("user_id", F.when(F.col("order_id") % 10 == 3, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("user_id")))
    with pytest.raises(Exception, match="lost"):
        weekly_state.advance(spark, state, "b", broken, events)
    same(weekly_state.weekly_metrics(spark, state), monitor.weekly_metrics(*batches[0]))
    weekly_state.advance(spark, state, "b", orders, events)
    same(
        weekly_state.weekly_metrics(spark, state),
        monitor.weekly_metrics(batches[0][0].unionAll(orders), batches[0][1].unionAll(events)),
    )


def test_of_two_runs_at_a_time_one_wins(spark, batches, tmp_path, monkeypatch):
    state = str(tmp_path)
    weekly_state.advance(spark, state, "a", *batches[0])
    seen = latest(spark, state)
    weekly_state.advance(spark, state, "b", *batches[1])
    monkeypatch.setattr(weekly_state, "latest", lambda *_: seen)
    with pytest.raises(Outrun):
        weekly_state.advance(spark, state, "c", *batches[2])


def test_orders_without_events_and_without_times(spark, make, batches, tmp_path):
    state, (orders, _) = str(tmp_path), batches[0]
    weekly_state.advance(spark, state, "a", orders.unionAll(orders.limit(1).withColumn("order_ts", F.lit(None).cast("timestamp_ntz"))))
    same(weekly_state.weekly_metrics(spark, state), monitor.weekly_metrics(orders))
    assert weekly_state.advance(spark, state, "b", make.orders()) == []
    same(weekly_state.weekly_metrics(spark, state), monitor.weekly_metrics(orders))
    with pytest.raises(ValueError):
        weekly_state.advance(spark, state, "c", orders, last_step=4)
    with pytest.raises(ValueError):
        weekly_state.advance(spark, state, "a/b", orders)


def test_a_week_without_members_is_merged_later(spark, make, tmp_path):
    state = str(tmp_path)
    first = make.orders({"user_id": None, "order_ts": "2026-04-07 10:00:00"})
    second = make.orders({"user_id": 4, "order_ts": "2026-04-08 10:00:00"})
    assert weekly_state.advance(spark, state, "a", first) == weekly_state.advance(spark, state, "b", second) == ["2026-04-06"]
    assert weekly_state.advance(spark, state, "c", second) == ["2026-04-06"]
    same(weekly_state.weekly_metrics(spark, state), monitor.weekly_metrics(first.unionAll(second).unionAll(second)))


def test_nothing_merged_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        weekly_state.weekly_metrics(spark, str(tmp_path))
