import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import distinct, metrics, monitor

START = dt.datetime(2025, 11, 3)


@pytest.fixture(scope="module")
def visits(spark):
    """One user holds a third of the rows; some rows lack the user or the time."""
    rng = random.Random(4)
    made = []
    for _ in range(3000):
        user = rng.choice([7, rng.randrange(400) * 1_000_003, rng.randrange(400) * 1_000_003])
        made.append((rng.choice([user] * 30 + [None]), str(START + dt.timedelta(days=rng.randrange(120), hours=5)), rng.choice("AB")))
    made.append((99, None, "A"))
    frame = spark.createDataFrame(made, "user long, seen string, platform string")
    return frame.withColumn("seen", F.col("seen").cast("timestamp_ntz")).repartition(5)


def truth(visits, grain, *keys):
    day = F.to_date("seen")
    period = {"day": day, "all": F.lit(None).cast("date")}.get(grain)
    period = F.trunc(day, grain) if period is None else period
    return visits.filter("user is not null").groupBy(period.alias("period"), *keys).agg(F.count_distinct("user").alias("members"))


def same(one, other):
    assert sorted(map(str, rows(one.select(sorted(one.columns))))) == sorted(map(str, rows(other.select(sorted(other.columns)))))


@pytest.mark.parametrize("grain", list(distinct.PERIODS))
def test_bitmaps_count_exactly(visits, grain):
    numbers = distinct.number_members(visits, "user")
    days = distinct.daily_bitmaps(visits, "user", "seen", numbers)
    same(distinct.bitmap_counts(days, grain), truth(visits, grain))
    keyed = distinct.daily_bitmaps(visits, "user", "seen", numbers, "platform")
    same(distinct.bitmap_counts(keyed, grain, "platform"), truth(visits, grain, "platform"))


def test_numbers_are_dense_and_stay(visits):
    early = visits.filter("seen < timestamp_ntz'2025-12-01'")
    first = distinct.number_members(early, "user")
    both = distinct.number_members(visits, "user", first)
    before, after = ({r["member"]: r["number"] for r in rows(f)} for f in (first, both))
    assert sorted(before.values()) == list(range(1, len(before) + 1))
    assert sorted(after.values()) == list(range(1, len(after) + 1)) and len(after) > len(before)
    assert all(after[m] == n for m, n in before.items())
    same(distinct.number_members(visits, "user", both), both)


def test_a_member_without_a_number_is_an_error(visits):
    numbers = distinct.number_members(visits.filter("user <> 7"), "user")
    with pytest.raises(Exception, match="has no number"):
        distinct.daily_bitmaps(visits, "user", "seen", numbers).collect()


def test_bitmaps_over_several_buckets(spark):
    many = spark.range(100_000).select((F.col("id") * 17).alias("user"), F.lit("2026-01-05").cast("timestamp_ntz").alias("seen"))
    numbers = distinct.number_members(many, "user")
    days = distinct.daily_bitmaps(many.unionAll(many), "user", "seen", numbers)
    assert days.count() == 4
    assert rows(distinct.bitmap_counts(days, "month"))[0]["members"] == 100_000


@pytest.mark.parametrize("lg_k", [10, 12])
def test_estimates_keep_to_their_error(spark, lg_k):
    """60,000 users over 90 days, each on three of them; the days' sketches make up months and the whole."""
    user = F.col("id") % 60_000
    day = F.date_add(F.lit("2026-01-01").cast("date"), ((F.xxhash64("id") % 90 + 90) % 90).cast("int"))
    visits = spark.range(180_000).select(user.alias("user"), day.cast("timestamp_ntz").alias("seen"))
    days = distinct.daily_sketches(visits, "user", "seen", lg_k=lg_k)
    for grain in ("day", "month", "quarter", "all"):
        true = {r["period"]: r["members"] for r in rows(truth(visits, grain))}
        found = {r["period"]: r["members"] for r in rows(distinct.sketched_counts(days, grain))}
        assert found.keys() == true.keys()
        assert all(abs(found[p] - n) <= distinct.relative_error(lg_k) * n for p, n in true.items())


def test_approximate_counts_are_opt_in(make):
    orders = make.orders(*[{"user_id": k % 40, "order_ts": f"2026-0{1 + k % 3}-1{k % 9} 10:00:00"} for k in range(200)])
    exact, near = metrics.monthly_trend(orders), metrics.monthly_trend(orders, approximate=True)
    assert exact.columns == near.columns
    for one, other in zip(sorted(rows(exact), key=str), sorted(rows(near), key=str)):
        assert abs(one["active_users"] - other["active_users"]) <= 1
    weekly = {(r["metric"], r["week_start"]): r["value"] for r in rows(monitor.weekly_metrics(orders))}
    for r in rows(monitor.weekly_metrics(orders, approximate=True)):
        assert abs(weekly[r["metric"], r["week_start"]] - r["value"]) <= (1 if r["metric"] == "Active users" else 0)


def test_no_rows_have_no_members(visits):
    none = visits.limit(0)
    numbers = distinct.number_members(none, "user")
    assert numbers.count() == 0
    assert distinct.bitmap_counts(distinct.daily_bitmaps(none, "user", "seen", numbers), "all").collect() == []
    assert distinct.sketched_counts(distinct.daily_sketches(none, "user", "seen"), "week").collect() == []
    with pytest.raises(ValueError):
        distinct.sketched_counts(distinct.daily_sketches(none, "user", "seen"), "fortnight")
