"""Headline, monthly and hourly metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import month_label, month_start
from tidemark.functions.numeric import (
    measured_mean,
    money_mean,
    percent,
    percent_of_flags,
    ratio,
    rounded_if,
)
from tidemark.operators.first_orders import active_users, delivered, repeat_flags

LAKH = 100000.0


def headline(users: DataFrame, orders: DataFrame, rounded: bool = True) -> DataFrame:
    """One row of key figures over delivered orders."""
    registered = users.agg(F.count("*")).scalar()
    ordering = delivered(orders).select("user_id").distinct().agg(F.count("user_id")).scalar()
    totals = (
        delivered(orders)
        .agg(
            F.count("*").alias("orders"),
            F.sum("gmv").cast("double").alias("gmv"),
            money_mean("gmv").alias("aov"),
            percent_of_flags("is_late").alias("late_pct"),
            measured_mean("rating").alias("rating"),
        )
        .withColumns({"registered_users": registered, "ordering_users": ordering})
    )
    return totals.select(
        "registered_users",
        "ordering_users",
        rounded_if(rounded, percent("ordering_users", "registered_users"), 1).alias(
            "activation_rate_pct"
        ),
        "orders",
        rounded_if(rounded, F.col("gmv"), 0).alias("gmv"),
        rounded_if(rounded, F.col("aov"), 0).alias("aov"),
        rounded_if(rounded, ratio("orders", "ordering_users"), 2).alias(
            "orders_per_ordering_user"
        ),
        rounded_if(rounded, F.col("late_pct"), 1).alias("late_delivery_rate_pct"),
        rounded_if(rounded, F.col("rating"), 2).alias("avg_rating"),
    )


def repeat_rate(
    orders: DataFrame,
    as_of,
    days: int = 30,
    rounded: bool = True,
    firsts: DataFrame | None = None,
) -> DataFrame:
    """Share of matured new users with a second delivered order within ``days``. ``firsts``
    hands in the result of ``repeat_flags`` where it is already at hand."""
    if firsts is None:
        firsts = repeat_flags(orders, as_of, days)
    return firsts.agg(
        F.count("*").alias("matured_new_users"),
        F.sum("repeated").alias("repeated_users"),
        rounded_if(rounded, percent_of_flags("repeated"), 2).alias(f"repeat_{days}d_rate_pct"),
    )


def monthly_trend(orders: DataFrame, approximate: bool = False) -> DataFrame:
    """Delivered orders by calendar month; ``approximate`` counts active users by sketches."""
    users = active_users(delivered(orders), month_start("order_ts"), "month", approximate)
    return (
        delivered(orders)
        .groupBy(month_start("order_ts").alias("month"))
        .agg(
            F.count("*").alias("orders"),
            F.sum("gmv").cast("double").alias("gmv"),
            money_mean("gmv").alias("aov"),
            percent_of_flags("is_late").alias("late_pct"),
            percent(F.sum("discount"), F.sum("gmv")).alias("discount_pct"),
        )
        .join(users, "month")
        .select(
            month_label("month").alias("month"),
            "active_users",
            "orders",
            F.round(F.col("gmv") / LAKH, 1).alias("gmv_lakh"),
            F.round("aov", 0).alias("aov"),
            F.round("late_pct", 1).alias("late_rate_pct"),
            F.round("discount_pct", 1).alias("discount_pct_of_gmv"),
        )
    )


def guardrails(orders: DataFrame) -> DataFrame:
    """Monthly figures that must not worsen, over all orders, cancelled included."""
    cancelled = F.when(F.col("status") == "cancelled", 1).otherwise(0)
    return (
        orders.groupBy(month_start("order_ts").alias("month"))
        .agg(
            percent_of_flags(cancelled).alias("cancel_pct"),
            measured_mean("delivery_minutes").alias("minutes"),
            measured_mean("rating").alias("rating"),
            percent(F.sum("discount"), F.sum("gmv")).alias("discount_pct"),
            money_mean(F.col("gmv") - F.col("discount")).alias("net"),
        )
        .select(
            month_label("month").alias("month"),
            F.round("cancel_pct", 2).alias("cancel_rate_pct"),
            F.round("minutes", 1).alias("avg_delivery_min"),
            F.round("rating", 2).alias("avg_rating"),
            F.round("discount_pct", 1).alias("discount_pct_of_gmv"),
            F.round("net", 0).alias("net_revenue_per_order"),
        )
    )


def extra_orders_per_retained_user(orders: DataFrame, rounded: bool = True) -> DataFrame:
    """Mean number of orders beyond the first, over users who came back."""
    per_user = delivered(orders).groupBy("user_id").agg(F.count("*").alias("n"))
    return per_user.filter(F.col("n") > 1).agg(
        rounded_if(rounded, F.avg(F.col("n") - 1), 2).alias("extra_orders")
    )


def returning_users(summary: DataFrame) -> DataFrame:
    """One row over ``user_summary``: matured new users, how many of them came back, and the mean number of orders
    beyond the first over users with more than one."""
    back = F.when(F.col("matured"), F.col("repeated"))
    return summary.agg(
        F.count_if("matured").alias("matured_new_users"),
        F.sum(back).alias("repeated_users"),
        F.avg(F.when(F.col("n_orders") > 1, F.col("n_orders") - 1)).alias("extra_orders"),
    )


def hour_of_day(orders: DataFrame) -> DataFrame:
    """Delivered orders per hour of day."""
    return delivered(orders).groupBy(F.hour("order_ts").alias("hour")).agg(
        F.count("*").alias("orders")
    )
