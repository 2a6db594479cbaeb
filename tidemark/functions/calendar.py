"""Calendar arithmetic on zone-free timestamps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The hours of day, both ends included, of each named daypart.
LUNCH_HOURS = (12, 14)
DINNER_HOURS = (19, 22)
DAYPARTS = ("Off peak", "Lunch peak", "Dinner peak")


def instant(value: dt.datetime | dt.date | str) -> Column:
    """A zone-free timestamp literal; a bare date means its midnight.

    It goes through text, because a Python datetime literal would pass through
    the session time zone.
    """
    return F.lit(str(value)).cast("timestamp_ntz")


def days(count: int) -> Column:
    return F.lit(dt.timedelta(days=count))


def day_of(ts: Column | str) -> Column:
    return F.to_date(ts)


def week_start(ts: Column | str) -> Column:
    """The Monday on or before ``ts``, as a date."""
    return F.trunc(F.to_date(ts), "week")


def within_week(ts: Column | str, monday: dt.date | str) -> Column:
    """Range form of ``week_start(ts) = monday``, which can be pushed down."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return (column >= instant(monday)) & (column < instant(monday) + days(7))


def month_start(ts: Column | str) -> Column:
    return F.trunc(F.to_date(ts), "month")


def month_label(month: Column | str) -> Column:
    return F.date_format(month, "yyyy-MM")


def month_number(ts: Column | str) -> Column:
    """Months since year 0: differences are calendar months, across years too."""
    return F.year(ts) * 12 + F.month(ts) - 1


def month_number_label(number: Column | str) -> Column:
    column = F.col(number) if isinstance(number, str) else number
    return month_label(F.make_date(F.floor(column / 12).cast("int"), column % 12 + 1, F.lit(1)))


def daypart(ts: Column | str) -> Column:
    return daypart_of(F.hour(ts))


def daypart_of(hour: Column) -> Column:
    return (
        F.when(hour.between(*LUNCH_HOURS), "Lunch peak")
        .when(hour.between(*DINNER_HOURS), "Dinner peak")
        .otherwise("Off peak")
    )
