"""Per-user order histories, built so that no user is ever one task's work.

A plain window over ``user_id`` would sort all orders of a user in one task. The
helpers here first roll a history up to calendar grain (which map-side partial
aggregation already does), so what reaches a per-user window is bounded by the
number of time slots, however many orders one user holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.calendar import day_of, days, instant


LG_K = 12  # of sketches: 4096 registers


def by_user() -> WindowSpec:
    return Window.partitionBy("user_id")


def delivered(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("status") == "delivered")


def with_user(orders: DataFrame) -> DataFrame:
    """Orders that some user placed: those without a user_id have no history."""
    return orders.filter(F.col("user_id").isNotNull())


def active_users(
    orders: DataFrame, period: Column, name: str, approximate: bool = False
) -> DataFrame:
    """``name`` and ``active_users``: distinct users per ``period``; from one sketch per period, which
    spares the shuffle of users, if ``approximate`` (see ``distinct.relative_error``).

    Next to other aggregates, a distinct count would drag all their buffers
    through a shuffle by user; on its own it moves two narrow columns, and the
    other aggregates shrink to one row per period before they move at all.
    """
    if approximate:
        sketch = F.hll_sketch_agg("user_id", F.lit(LG_K))
        return orders.groupBy(period.alias(name)).agg(
            F.hll_sketch_estimate(sketch).alias("active_users")
        )
    return (
        orders.select(period.alias(name), "user_id")
        .distinct()
        .groupBy(name)
        .agg(F.count("user_id").alias("active_users"))
    )


def repeat_flags(orders: DataFrame, as_of, window_days: int = 30) -> DataFrame:
    """user_id, first_ts, repeated for users whose first delivered order is at
    least ``window_days`` old at ``as_of``. Orders without a user_id take no part.

    ``repeated`` is 1 if another delivered order came later than the first, and
    at most ``window_days`` after it. Histories are cut into slots of
    ``window_days`` days; the earliest and latest time of each slot decide that
    exactly. In the slot of the first order, every later time is near enough, so
    the latest tells; in the next slot every time is later, so the earliest tells.
    """
    slots = slots_of(with_user(delivered(orders)), "order_ts", "order_ts", F.count("*"), window_days)
    return flags_of_slots(slots, as_of, window_days)


def flags_of_slots(slots: DataFrame, as_of, window_days: int = 30) -> DataFrame:
    matured = F.col("first_ts") <= instant(as_of) - days(int(window_days))
    return slots.filter(matured).groupBy("user_id", "first_ts").agg(_came_back(window_days))


def user_summary(orders: DataFrame, as_of, window_days: int = 30) -> DataFrame:
    """user_id, first_ts, n_orders, matured, repeated: one row per user with a delivered order, from the same
    slots as :func:`repeat_flags`, so that one pass serves the repeat rate and the number of orders. Orders
    without a user_id make one row, which has not matured."""
    slots = slots_of(delivered(orders), "order_ts", "order_ts", F.count("*"), window_days)
    matured = F.col("first_ts") <= instant(as_of) - days(int(window_days))
    return (
        slots.groupBy("user_id", "first_ts")
        .agg(F.sum("n").alias("n_orders"), _came_back(window_days))
        .withColumn("matured", matured & F.col("user_id").isNotNull())
    )


def slots_of(
    rows: DataFrame, earliest: str, latest: str, n: Column, window_days: int
) -> DataFrame:
    """Each user's earliest and latest time and number of orders per slot of the window's length, and
    the time of the first order. ``rows`` are orders, or orders summed up by user and day."""
    if window_days != int(window_days) or window_days < 1:
        raise ValueError("window_days must be a whole number of days, 1 or more")
    day = F.unix_date(day_of(earliest))
    return (
        rows.groupBy("user_id", F.floor(day / int(window_days)).alias("slot"))
        .agg(F.min(earliest).alias("earliest"), F.max(latest).alias("latest"), n.alias("n"))
        .withColumn("first_ts", F.min("earliest").over(by_user()))
    )


def _came_back(window_days: int) -> Column:
    inside = (F.col("latest") > F.col("first_ts")) & (
        F.col("earliest") <= F.col("first_ts") + days(int(window_days))
    )
    return F.max(F.when(inside, 1).otherwise(0)).alias("repeated")


def first_n_orders(orders: DataFrame, n: int) -> DataFrame:
    """The first ``n`` orders each user placed, cancelled ones included, with
    their ``order_seq``.

    Spark keeps at most ``n`` rows per user in each map task before the shuffle
    (window group limit), so a user's whole history never meets in one task.
    """
    in_time = by_user().orderBy("order_ts", "order_id")
    return orders.withColumn("order_seq", F.row_number().over(in_time)).filter(
        F.col("order_seq") <= n
    )


def enrich_orders(
    orders: DataFrame, grace_minutes: float = 10, unit: str = "hour"
) -> DataFrame:
    """Add ``order_seq`` (1 = first placed order) and ``is_late`` where absent.

    All users are numbered by time slot, see :func:`_numbered_by_slot`: however many
    orders one user has, no task holds more than those of one slot. Orders without a
    user_id are numbered together, like those of one user.
    """
    if "is_late" not in orders.columns:
        overrun = F.col("delivery_minutes") - F.col("promised_minutes")
        orders = orders.withColumn("is_late", (overrun > grace_minutes).cast("int"))
    if "order_seq" in orders.columns:
        return orders
    return _numbered_by_slot(orders, unit).select(*orders.columns, "order_seq")


def _numbered_by_slot(orders: DataFrame, unit: str) -> DataFrame:
    """Number each user's orders without bringing them together: the count of the
    user's orders in earlier slots, plus the place within the own slot. Only the
    counts per slot meet per user. The places come before the join, which then
    finds both sides sorted."""
    slotted = orders.withColumn("slot", _slot("order_ts", unit))
    in_slot = Window.partitionBy("user_id", "slot").orderBy("order_ts", "order_id")
    before = by_user().orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slotted.groupBy("user_id", "slot")
        .agg(F.count("*").alias("n"))
        .select("user_id", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    )
    return (
        slotted.withColumn("place", F.row_number().over(in_slot))
        .alias("placed")
        .join(
            offsets.alias("offsets"),
            F.expr("placed.user_id <=> offsets.user_id AND placed.slot <=> offsets.slot"),
        )
        .select(
            "placed.*", (F.col("earlier") + F.col("place")).cast("int").alias("order_seq")
        )
    )


def _slot(ts: str, unit: str):
    """A number that grows with time and is constant within a day or an hour."""
    day = F.unix_date(day_of(ts))
    if unit == "day":
        return day
    if unit == "hour":
        return day * 24 + F.hour(ts)
    raise ValueError("unit must be 'hour' or 'day'")
