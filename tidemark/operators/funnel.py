"""Session funnels. A session counts at a step if it fired the event at least
once; the order of events inside a session plays no part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import week_start
from tidemark.functions.numeric import percent, rounded_if


def _sessions_at_steps(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys, "event_name", "step_no").agg(
        F.count_distinct("session_id").alias("sessions")
    )


def funnel(events: DataFrame) -> DataFrame:
    """Sessions per step, against the largest step and against the step before."""
    step_order = Window.orderBy("step_no")
    conversion = percent("sessions", F.lag("sessions").over(step_order))
    top = F.max("sessions").over(Window.partitionBy())
    return _sessions_at_steps(events).select(
        "step_no",
        "event_name",
        "sessions",
        F.round(percent("sessions", top), 1).alias("pct_of_top"),
        F.round(conversion, 1).alias("step_conv_pct"),
        F.round(F.lit(100.0) - conversion, 1).alias("step_dropoff_pct"),
    )


def funnel_by(events: DataFrame, dimension: str = "platform") -> DataFrame:
    """The step-to-step conversion of every segment of ``dimension``."""
    step_order = Window.partitionBy(dimension).orderBy("step_no")
    return _sessions_at_steps(events, dimension).select(
        dimension,
        "step_no",
        "event_name",
        "sessions",
        F.round(percent("sessions", F.lag("sessions").over(step_order)), 1).alias("step_conv_pct"),
    )


MAX_SEGMENTS = 1000


def observed_segments(by_segment: DataFrame, dimension: str = "platform") -> list[str]:
    """The segments that occur, in order. More than can be columns are an error, not a cut."""
    found = by_segment.select(dimension).filter(F.col(dimension).isNotNull()).distinct()
    names = [row[0] for row in found.limit(MAX_SEGMENTS + 1).collect()]
    if len(names) > MAX_SEGMENTS:
        raise ValueError(f"{dimension} has more than {MAX_SEGMENTS} values")
    return sorted(names)


def funnel_pivot(
    by_segment: DataFrame, segments: Sequence[str] | None = None, dimension: str = "platform"
) -> DataFrame:
    """Step conversion with one column per segment: those given, or all that occur."""
    if segments is None:
        segments = observed_segments(by_segment, dimension)
    wide = (
        by_segment.groupBy("event_name")
        .pivot(dimension, list(segments))
        .agg(F.first("step_conv_pct"))
    )
    return wide.select("event_name", *[F.col(f"`{s}`").alias(s.lower()) for s in segments])


def leak_size(
    events: DataFrame,
    from_step: int = 5,
    to_step: int = 6,
    weak: str = "Android",
    strong: str = "iOS",
    rounded: bool = True,
) -> DataFrame:
    """Orders the weak platform would gain at the strong platform's conversion.

    Each session is reduced to two flags first: one shuffle of one row per
    session, where two distinct counts would duplicate every event.
    """

    def reached(step: int):
        return F.max(F.when(F.col("step_no") == step, 1).otherwise(0))

    sessions = (
        events.filter(F.col("platform").isin(weak, strong))
        .groupBy("platform", "session_id")
        .agg(reached(from_step).alias("started"), reached(to_step).alias("finished"))
    )

    def total(flag: str, platform: str):
        return F.sum(F.when(F.col("platform") == platform, F.col(flag))).cast("double")

    totals = sessions.agg(
        total("started", weak).alias("weak_started"),
        total("finished", weak).alias("weak_finished"),
        total("started", strong).alias("strong_started"),
        total("finished", strong).alias("strong_finished"),
    )
    strong_rate = F.try_divide(F.col("strong_finished"), F.col("strong_started"))
    recoverable = F.col("weak_started") * strong_rate - F.col("weak_finished")
    return totals.select(
        rounded_if(rounded, percent("weak_finished", "weak_started"), 1).alias(
            f"{weak.lower()}_pay_conv_pct"
        ),
        rounded_if(rounded, percent("strong_finished", "strong_started"), 1).alias(
            f"{strong.lower()}_pay_conv_pct"
        ),
        rounded_if(rounded, recoverable, 0).alias("recoverable_orders_6mo"),
    )


def funnel_weekly(events: DataFrame, first_step: int = 1, last_step: int = 6) -> DataFrame:
    """Weekly share of started sessions that finished, in percent."""

    def reached(step: int):
        return F.max(F.when(F.col("step_no") == step, 1).otherwise(0))

    sessions = events.groupBy(week_start("event_ts").alias("week_start"), "session_id").agg(
        reached(first_step).alias("started"), reached(last_step).alias("finished")
    )
    return sessions.groupBy("week_start").agg(
        percent(F.sum("finished"), F.sum("started")).alias("value")
    )
