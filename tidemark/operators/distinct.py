"""Distinct counts that merge: sketches and bitmaps kept per day, rolled up to any longer period.

A distinct count over rows has to be made anew for every period. Here a day's members are kept in a form
that adds up: a sketch of a few kilobytes, whose count is approximate with a known error, or bitmaps over
dense numbers, whose count is exact. Weeks, months, quarters and the whole then come from the days, without
the rows. Rows are aggregated in the map tasks first, so a day or member that holds a third of all rows is no
task's work alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import month_start, week_start
from tidemark.operators.first_orders import LG_K
from tidemark.sources.scratch import park


def relative_error(lg_k: int = LG_K, deviations: float = 3.0) -> float:
    """Relative error that a sketch's estimate keeps to but for one case in hundreds: three standard
    deviations of a HyperLogLog sketch of 2 ** ``lg_k`` registers."""
    return deviations * 1.04 / 2 ** (lg_k / 2)


#: Start of the period that a day belongs to; None for all days together.
PERIODS = {
    "day": lambda day: F.col(day),
    "week": lambda day: week_start(day),
    "month": lambda day: month_start(day),
    "quarter": lambda day: F.trunc(day, "quarter"),
    "all": lambda day: F.lit(None).cast("date"),
}


def _period(grain: str, day: str = "day") -> Column:
    if grain not in PERIODS:
        raise ValueError(f"a grain is one of {', '.join(PERIODS)}")
    return PERIODS[grain](day).alias("period")


def daily_sketches(rows: DataFrame, member: str, ts: str, *keys: str, lg_k: int = LG_K) -> DataFrame:
    """day, the ``keys``, and a sketch of the distinct ``member`` values. Nulls are not members; rows
    without a time have a null day."""
    return rows.groupBy(F.to_date(ts).alias("day"), *keys).agg(F.hll_sketch_agg(member, F.lit(lg_k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, grain: str, *keys: str) -> DataFrame:
    """period, the ``keys``, and the union of the days' sketches, which merges further."""
    return sketches.groupBy(_period(grain), *keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def sketched_counts(sketches: DataFrame, grain: str, *keys: str) -> DataFrame:
    """period, the ``keys``, and ``members``: about how many distinct ones, see :func:`relative_error`."""
    merged = merged_sketches(sketches, grain, *keys)
    return merged.select("period", *keys, F.hll_sketch_estimate("sketch").alias("members"))


# exact, by bitmaps


def number_members(rows: DataFrame, member: str, known: DataFrame | None = None) -> DataFrame:
    """member, number: every distinct non-null ``member`` with a number of its own, from 1 without gaps. With
    ``known``, an earlier result, old members keep theirs and new ones follow.

    Members are numbered within the partitions they are in, and partitions follow one another: the
    driver sees nothing, and one task only a row per partition. Parked, as the numbers
    depend on how the members lie.
    """
    new = rows.select(F.col(member).alias("member")).filter("member is not null").distinct()
    if known is not None:
        new = new.join(known.select("member"), "member", "left_anti")
    placed = park(new.withColumn("place", F.monotonically_increasing_id()), "members-placed")
    part = F.shiftright("place", 33).alias("part")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part)
        .agg(F.count("*").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    numbered = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    number = F.col("offset") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    if known is None:
        return park(numbered.select("member", number.alias("number")), "member-numbers")
    highest = known.agg(F.coalesce(F.max("number"), F.lit(0))).scalar()
    added = numbered.select("member", (number + highest).alias("number"))
    return park(known.select("member", "number").unionAll(added), "member-numbers")


def daily_bitmaps(rows: DataFrame, member: str, ts: str, numbers: DataFrame, *keys: str) -> DataFrame:
    """day, the ``keys``, bucket, bits: a bitmap of 4 KB for each 32,768 numbers of which one occurs. Rows
    whose member has no number are an error, as they would be missing from the counts."""
    day = F.to_date(ts).alias("day")
    seen = rows.filter(F.col(member).isNotNull()).select(day, *keys, F.col(member).alias("member")).distinct()
    joined = seen.join(numbers, "member", "left")
    number = F.coalesce("number", F.raise_error(F.lit(f"a {member} has no number")).cast("long"))
    return joined.groupBy("day", *keys, F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")
    )


def merged_bitmaps(bitmaps: DataFrame, grain: str, *keys: str) -> DataFrame:
    """period, the ``keys``, bucket, bits: the union of the days' bitmaps, which merges further."""
    return bitmaps.groupBy(_period(grain), *keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_counts(bitmaps: DataFrame, grain: str, *keys: str) -> DataFrame:
    """period, the ``keys``, and ``members``: how many distinct ones, exactly."""
    merged = merged_bitmaps(bitmaps, grain, *keys)
    return merged.groupBy("period", *keys).agg(F.sum(F.bitmap_count("bits")).alias("members"))
