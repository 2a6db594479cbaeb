import datetime as dt

from conftest import one, rows
from tidemark.operators import funnel

DAY = "2026-06-28 10:00:00"  # a Sunday


def sample(make):
    return make.events(
        (1, 1, "Android", DAY),
        (1, 1, "Android", DAY),
        (1, 3, "Android", DAY),
        (2, 1, "Android", DAY),
        (2, 2, "Android", "2026-06-29 00:00:00"),
        (3, 1, "iOS", DAY),
        (3, 2, "iOS", DAY),
        (3, 3, "iOS", DAY),
        (4, 2, "iOS", DAY),
    )


def test_steps_count_sessions_once_and_in_no_order(make):
    found = rows(funnel.funnel(sample(make)), "step_no")
    assert [found[k]["sessions"] for k in (1, 2, 3)] == [3, 3, 2]
    assert found[1]["step_conv_pct"] is None and found[1]["pct_of_top"] == 100.0
    assert found[3]["step_conv_pct"] == 66.7 and found[3]["step_dropoff_pct"] == 33.3


def test_by_platform_and_pivot(make):
    by_platform = funnel.funnel_by(sample(make))
    found = rows(by_platform, "platform", "step_no")
    assert found["Android", 2]["step_conv_pct"] == 50.0
    assert found["iOS", 2]["step_conv_pct"] == 200.0
    wide = rows(funnel.funnel_pivot(by_platform, ("Android", "iOS")), "event_name")
    assert wide["search"] == {"event_name": "search", "android": 50.0, "ios": 200.0}


def test_leak_size(make):
    assert one(funnel.leak_size(sample(make), 1, 3)) == {
        "android_pay_conv_pct": 50.0,
        "ios_pay_conv_pct": 100.0,
        "recoverable_orders_6mo": 1.0,
    }


def test_leak_without_sessions_at_the_step_is_null(make):
    row = one(funnel.leak_size(sample(make), 5, 6))
    assert row["android_pay_conv_pct"] is None and row["recoverable_orders_6mo"] is None


def test_weekly_funnel_splits_on_monday(make):
    found = rows(funnel.funnel_weekly(sample(make), 1, 3), "week_start")
    assert found[dt.date(2026, 6, 22)]["value"] == 100 * 2 / 3
    assert found[dt.date(2026, 6, 29)]["value"] is None


def test_the_pivot_holds_every_platform(spark):
    by_platform = spark.createDataFrame(
        [("web", "open", 50.0), ("iOS", "open", 60.0), ("Android", "open", 70.0)],
        "platform string, event_name string, step_conv_pct double",
    )
    assert rows(funnel.funnel_pivot(by_platform)) == [
        {"event_name": "open", "android": 70.0, "ios": 60.0, "web": 50.0}
    ]
