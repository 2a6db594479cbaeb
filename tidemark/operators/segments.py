"""RFM segments and acquisition-channel quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import instant
from tidemark.functions.numeric import (
    measured_mean,
    money_mean,
    percent,
    percent_of_flags,
)
from tidemark.operators.first_orders import delivered
from tidemark.operators.metrics import LAKH
from tidemark.operators.ranking import with_ntile
from tidemark.sources.scratch import park

TILES = 5
SECONDS_PER_DAY = 86400

# A segment and the recency and frequency scores it covers, both
# ends included. The first match counts; scores that match none are OTHER_SEGMENT.
SEGMENTS = (
    ("Champions", (4, 5), (4, 5)),
    ("Loyal", (3, 5), (3, 5)),
    ("New / Promising", (4, 5), (1, 2)),
    ("At Risk (was valuable)", (1, 2), (4, 5)),
    ("Hibernating / Churned", (1, 2), (1, 2)),
)
OTHER_SEGMENT = "Needs Attention"


def _segment():
    matches = [
        (name, F.col("r_score").between(*recency) & F.col("f_score").between(*frequency))
        for name, recency, frequency in SEGMENTS
    ]
    return F.coalesce(*[F.when(match, name) for name, match in matches], F.lit(OTHER_SEGMENT))


def rfm_scores(orders: DataFrame, as_of) -> DataFrame:
    """Recency, frequency, monetary value, scores and segment of every user with
    a delivered order. Ties in a score's order are settled by user_id.

    The per-user table is parked once, since both scores and the result read it;
    this is the one operator that runs jobs while it is being built.
    """
    users = (
        delivered(orders)
        .groupBy("user_id")
        .agg(
            F.max("order_ts").alias("last_ts"),
            F.count("*").alias("frequency"),
            F.sum("gmv").alias("monetary"),
        )
    )
    return scores_of_users(users, as_of)


def scores_of_users(users: DataFrame, as_of) -> DataFrame:
    """Scores and segment from user_id, last_ts, frequency and monetary."""
    since_last = F.timestamp_diff("SECOND", F.col("last_ts"), instant(as_of))
    users = park(users, "rfm-users")
    # The longest gap since the last order comes first, so tile 1 is most lapsed.
    scored = with_ntile(users, ["last_ts", "user_id"], TILES, "r_score")
    scored = with_ntile(scored, ["frequency", "user_id"], TILES, "f_score")
    return scored.select(
        "user_id",
        (since_last / float(SECONDS_PER_DAY)).alias("recency_days"),
        "frequency",
        "monetary",
        "r_score",
        "f_score",
        _segment().alias("segment"),
    )


def rfm_summary(scores: DataFrame) -> DataFrame:
    """Size and value of each segment."""
    everyone = Window.partitionBy()
    by_segment = scores.groupBy("segment").agg(
        F.count("*").alias("users"),
        F.sum("monetary").alias("total"),
        F.avg("frequency").alias("orders"),
        money_mean("monetary").alias("lifetime"),
        _mean_days("recency_days").alias("recency"),
    )
    return by_segment.select(
        "segment",
        "users",
        F.round(percent("users", F.sum("users").over(everyone)), 1).alias("pct_users"),
        F.round(F.col("total").cast("double") / LAKH, 1).alias("gmv_lakh"),
        F.round(percent("total", F.sum("total").over(everyone)), 1).alias("pct_gmv"),
        F.round("orders", 2).alias("avg_orders"),
        F.round("lifetime", 0).alias("avg_lifetime_gmv"),
        F.round("recency", 0).alias("avg_recency_days"),
    )


def _mean_days(days: str):
    """Whole seconds under the fraction of a day, so that the mean is exact."""
    return measured_mean(F.col(days) * SECONDS_PER_DAY, places=0) / float(SECONDS_PER_DAY)


def behaviour_by_channel(users: DataFrame, orders: DataFrame) -> DataFrame:
    """Order behaviour per acquisition channel; repeat here means ever again.

    Orders are summed per user before users are joined on, so that the join meets
    one row per user on either side.
    """
    per_user = (
        delivered(orders)
        .groupBy("user_id")
        .agg(
            F.count("order_id").alias("orders"),
            F.sum("gmv").alias("gmv"),
            F.sum("discount").alias("discount"),
        )
    )
    came_back = F.when(F.col("orders") > 1, 1).otherwise(0)
    return (
        per_user.join(users.select("user_id", "acquisition_channel"), "user_id")
        .groupBy("acquisition_channel")
        .agg(
            F.count("*").alias("ordering_users"),
            F.round(percent_of_flags(came_back), 1).alias("repeat_rate_pct"),
            F.round(F.avg("orders"), 2).alias("orders_per_user"),
            F.round(money_mean("gmv"), 0).alias("gmv_per_user"),
            F.round(percent(F.sum("discount"), F.sum("gmv")), 1).alias("discount_pct_of_gmv"),
        )
    )
