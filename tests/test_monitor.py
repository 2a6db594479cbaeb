import datetime as dt

import pytest

from conftest import one, plan_of, rows
from tidemark.operators import monitor

MONDAY = dt.date(2026, 6, 22)


def weekly(spark, values, metric="Orders"):
    """Values by weeks before MONDAY."""
    return spark.createDataFrame(
        [(metric, MONDAY - dt.timedelta(weeks=ago), value) for ago, value in values.items()],
        "metric string, week_start date, value double",
    )


def test_aggregates_share_one_pass(spark, make, tmp_path):
    path = str(tmp_path / "orders")
    make.orders(
        {"user_id": 1, "order_ts": "2026-06-28 23:59:00", "gmv": 100, "is_late": 1},
        {"user_id": 1, "order_ts": "2026-06-28 10:00:00", "gmv": 301, "delivery_minutes": 40.5},
        {"user_id": 2, "order_ts": "2026-06-29 00:00:00"},
        {"user_id": 2, "order_ts": "2026-06-29 00:00:00", "status": "cancelled"},
    ).write.parquet(path)
    frame = monitor.weekly_metrics(spark.read.parquet(path))
    plan = plan_of(frame)
    # one scan for the aggregates, one narrow scan for the distinct users
    assert plan.count("FileScan") == 2
    assert "ReadSchema: struct<user_id:bigint,order_ts:timestamp_ntz,status:string>" in plan
    found = {(r["metric"], r["week_start"]): r["value"] for r in frame.collect()}
    assert found["Orders", MONDAY] == 2 and found["Orders", dt.date(2026, 6, 29)] == 1
    assert found["Active users", MONDAY] == 1
    assert found["GMV (₹)", MONDAY] == 401 and found["AOV (₹)", MONDAY] == 200.5
    assert found["Late-delivery rate (%)", MONDAY] == 50
    assert found["Avg delivery (min)", MONDAY] == 35.25
    assert found["Avg rating", MONDAY] == 4
    assert found["Discount % of GMV", MONDAY] == 100 * 20 / 401
    assert len(found) == 16


def test_the_funnel_is_one_more_metric(make):
    orders = make.orders({"user_id": 1, "order_ts": "2026-06-22 10:00:00"})
    events = make.events(
        (1, 1, "iOS", "2026-06-22 10:00:00"),
        (1, 6, "iOS", "2026-06-22 10:00:00"),
        (2, 1, "iOS", "2026-06-22 10:00:00"),
    )
    found = {r["metric"]: r["value"] for r in monitor.weekly_metrics(orders, events).collect()}
    assert len(found) == 9 and found["Session→order conv (%)"] == 50.0


@pytest.mark.parametrize(
    "values, base",
    [
        ({0: 9.0}, None),
        ({0: 9.0, 1: 4.0}, 4.0),
        ({0: 9.0, 1: 1.0, 2: 2.0, 3: 3.0, 4: 4.0}, 2.5),
        ({0: 9.0, 1: 1.0, 2: 2.0, 3: 3.0, 4: 4.0, 5: 90.0}, 2.5),
        ({0: 9.0, 1: 1.0, 3: 3.0, 7: 5.0, 9: 7.0, 10: 90.0}, 4.0),
    ],
)
def test_baseline_takes_up_to_four_present_weeks(spark, values, base):
    found = rows(monitor.trailing_baseline(weekly(spark, values)), "week_start")
    assert found[MONDAY]["base"] == base


@pytest.mark.parametrize(
    "metric, value, base, status",
    [
        ("Orders", 96.0, 100.0, "GREEN"),
        ("Orders", 95.0, 100.0, "AMBER"),
        ("Orders", 90.0, 100.0, "RED"),
        ("Orders", 190.0, 100.0, "GREEN"),
        ("Late-delivery rate (%)", 111.0, 100.0, "AMBER"),
        ("Late-delivery rate (%)", 120.0, 100.0, "RED"),
        ("Late-delivery rate (%)", 50.0, 100.0, "GREEN"),
        ("Orders", 5.0, 0.0, "NO DATA"),
        ("Orders", 5.0, None, "NO DATA"),
    ],
)
def test_status_follows_the_good_direction(spark, metric, value, base, status):
    frame = spark.createDataFrame(
        [(metric, MONDAY, value, base)], "metric string, week_start date, value double, base double"
    )
    row = one(monitor.classify(frame))
    assert row["status"] == status
    if status == "NO DATA":
        assert row["move"] == 0.0


def test_published_week(spark):
    # A published week.
    published = [
        ("Orders", 3212.0, 3291.5, -2.4),
        ("Active users", 3077.0, 3113.0, -1.2),
        ("GMV (₹)", 1417412.0, 1480678.75, -4.3),
        ("AOV (₹)", 441.29, 449.79, -1.9),
        ("Late-delivery rate (%)", 20.64, 21.17, -2.5),
        ("Discount % of GMV", 21.01, 20.15, 4.3),
        ("Session→order conv (%)", 23.55, 24.31, -3.1),
    ]
    frame = spark.createDataFrame(
        [(m, MONDAY, v, b) for m, v, b, _ in published],
        "metric string, week_start date, value double, base double",
    )
    report = rows(monitor.weekly_report(monitor.classify(frame), MONDAY), "metric")
    for metric, _, _, delta in published:
        assert report[metric]["status"] == report[metric]["overall"] == "GREEN"
        assert report[metric]["delta_pct"] == delta


def test_default_week_is_the_second_latest_of_all_metrics(spark):
    both = weekly(spark, {0: 1.0, 1: 10.0, 2: 11.0}).union(
        weekly(spark, {-1: 2.0, 0: 3.0}, "Avg rating")
    )
    report = rows(monitor.weekly_report(monitor.classify(monitor.trailing_baseline(both))))
    assert {row["week_start"] for row in report} == {MONDAY}
    found = {row["metric"]: row for row in report}
    assert found["Orders"]["status"] == "RED" and found["Avg rating"]["status"] == "NO DATA"
    assert found["Avg rating"]["overall"] == "RED"
    older = monitor.weekly_report(
        monitor.classify(monitor.trailing_baseline(both)), MONDAY - dt.timedelta(weeks=1)
    )
    assert [row["metric"] for row in rows(older)] == ["Orders"]


def test_drilldown_fires_only_on_a_breach(spark, make):
    orders = make.orders(
        {"user_id": 1, "order_ts": "2026-06-22 00:00:00", "is_late": 1},
        {"user_id": 1, "order_ts": "2026-06-28 23:59:00", "city": "Delhi"},
        {"user_id": 1, "order_ts": "2026-06-29 00:00:00"},
        {"user_id": 1, "order_ts": "2026-06-21 23:59:00"},
        {"user_id": 1, "order_ts": "2026-06-23 10:00:00", "status": "cancelled"},
    )

    def report(status):
        return spark.createDataFrame([(MONDAY, status)], "week_start date, status string")

    want = {("Pune", 100.0, 30.0, 1), ("Delhi", 0.0, 30.0, 1)}
    assert {tuple(r) for r in monitor.late_drilldown(orders, report=report("AMBER")).collect()} == want
    assert {tuple(r) for r in monitor.late_drilldown(orders, week=MONDAY).collect()} == want
    assert monitor.late_drilldown(orders, report=report("GREEN")).count() == 0
    with pytest.raises(ValueError):
        monitor.late_drilldown(orders)


def test_a_given_week_reaches_the_scan(spark, make, tmp_path):
    path = str(tmp_path / "orders")
    make.orders({"user_id": 1, "order_ts": "2026-06-22 00:00:00"}).write.parquet(path)
    plan = plan_of(monitor.late_drilldown(spark.read.parquet(path), week=MONDAY))
    assert "GreaterThanOrEqual(order_ts,2026-06-22T00:00)" in plan
    assert "LessThan(order_ts,2026-06-29T00:00)" in plan


def test_a_breached_week_is_pushed_down_too(spark, make, tmp_path):
    path = str(tmp_path / "orders")
    days = [{"user_id": 1, "order_ts": f"2026-0{month}-23 10:00:00"} for month in range(1, 7)]
    make.orders(*days).repartitionByRange(6, "order_ts").write.parquet(path)
    report = spark.createDataFrame([(MONDAY, "RED")], "week_start date, status string")
    drilldown = monitor.late_drilldown(spark.read.parquet(path), report=report)
    assert [row["orders"] for row in drilldown.collect()] == [1]
    pushed = plan_of(drilldown).partition("PushedFilters: ")[2].partition("\n")[0]
    assert "GreaterThanOrEqual(order_ts,ScalarSubquery" in pushed


def test_registry_entries_are_never_skipped(make):
    orders = make.orders({"user_id": 1, "order_ts": "2026-01-05 10:00:00"})
    unknown = [monitor.Metric("Odd", "no such source", "up", 0.1, 0.2)]
    with pytest.raises(ValueError, match="no such source"):
        monitor.weekly_metrics(orders, metrics=unknown)
    with pytest.raises(ValueError, match="needs events"):
        monitor.weekly_metrics(orders, metrics=[monitor.Metric("Funnel", monitor.FUNNEL, "up", 0.1, 0.2)])
    users = [monitor.Metric("Users", monitor.ACTIVE_USERS, "up", 0.1, 0.2)]
    assert [r["value"] for r in monitor.weekly_metrics(orders, metrics=users).collect()] == [1.0]
