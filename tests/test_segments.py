from pyspark.sql import functions as F

import brute
from conftest import rows
from tidemark.operators import segments


def test_recency_can_be_negative_on_the_last_day(make):
    orders = make.orders(
        {"user_id": 1, "order_ts": "2026-06-30 12:00:00"},
        {"user_id": 2, "order_ts": "2026-06-28 12:00:00", "gmv": 50},
        {"user_id": 2, "order_ts": "2026-06-29 12:00:00", "gmv": 70},
        {"user_id": 3, "order_ts": "2026-06-29 12:00:00", "status": "cancelled"},
    )
    found = rows(segments.rfm_scores(orders, "2026-06-30"), "user_id")
    assert set(found) == {1, 2}
    assert found[1]["recency_days"] == -0.5 and found[2]["recency_days"] == 0.5
    assert found[2]["frequency"] == 2 and found[2]["monetary"] == 120
    assert (found[1]["r_score"], found[2]["r_score"]) == (2, 1)
    assert (found[1]["f_score"], found[2]["f_score"]) == (1, 2)


def test_every_score_pair_has_its_segment(spark):
    pairs = spark.range(25).select(
        (F.col("id") % 5 + 1).alias("r_score"), (F.floor(F.col("id") / 5) + 1).alias("f_score")
    )
    got = {
        (r["r_score"], r["f_score"]): r["segment"]
        for r in pairs.withColumn("segment", segments._segment()).collect()
    }
    assert got[5, 5] == got[4, 4] == "Champions"
    assert got[3, 5] == got[5, 3] == got[3, 3] == "Loyal"
    assert got[5, 1] == got[4, 2] == "New / Promising"
    assert got[1, 5] == got[2, 4] == "At Risk (was valuable)"
    assert got[1, 1] == got[2, 2] == "Hibernating / Churned"
    assert got[3, 1] == got[3, 2] == got[1, 3] == got[2, 3] == "Needs Attention"


def test_summary_adds_up(make):
    orders = make.orders(*brute.history(1))
    scores = segments.rfm_scores(orders, "2026-06-30")
    summary = rows(segments.rfm_summary(scores))
    assert sum(row["users"] for row in summary) == scores.count()
    assert abs(sum(row["pct_users"] for row in summary) - 100) <= 0.05 * len(summary)
    assert abs(sum(row["pct_gmv"] for row in summary) - 100) <= 0.05 * len(summary)


def test_behaviour_by_channel(make):
    users = make.users({"user_id": 1}, {"user_id": 2}, {"user_id": 3, "acquisition_channel": "referral"})
    orders = make.orders(
        {"user_id": 1, "order_ts": "2026-01-01 10:00:00"},
        {"user_id": 1, "order_ts": "2026-05-01 10:00:00"},
        {"user_id": 2, "order_ts": "2026-01-01 10:00:00"},
        {"user_id": 2, "order_ts": "2026-01-02 10:00:00", "status": "cancelled"},
    )
    assert rows(segments.behaviour_by_channel(users, orders)) == [
        {
            "acquisition_channel": "organic",
            "ordering_users": 2,
            "repeat_rate_pct": 50.0,
            "orders_per_user": 1.5,
            "gmv_per_user": 150.0,
            "discount_pct_of_gmv": 10.0,
        }
    ]
