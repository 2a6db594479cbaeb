"""Ratios, rounding and means as Column expressions.

Every mean and sum here is exact, so a result does not depend on the order in
which tasks finish: money is summed as decimal, measured doubles as scaled
longs, flags and half-point ratings are exact in a double already.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def rounded_if(on: bool, value: Column, places: int) -> Column:
    """Round half away from zero, or leave the exact value when ``on`` is false."""
    return F.round(value, places) if on else value


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Double division that yields NULL, not an error, on a zero denominator."""
    return F.try_divide(_column(numerator).cast("double"), _column(denominator).cast("double"))


def percent(numerator: Column | str, denominator: Column | str) -> Column:
    return F.try_divide(
        F.lit(100.0) * _column(numerator).cast("double"), _column(denominator).cast("double")
    )


def percent_of_flags(flag: Column | str) -> Column:
    """Share of 1s in a 0/1 column, NULLs left out."""
    return F.lit(100.0) * F.avg(_column(flag))


def money_mean(amount: Column | str) -> Column:
    """Mean of a decimal column through its exact sum."""
    return ratio(F.sum(_column(amount)), F.count(_column(amount)))


def measured_mean(value: Column | str, places: int = 4) -> Column:
    """Mean of a measured double, taken at ``places`` decimals through a long sum.

    Addition of longs is associative, addition of doubles is not: the same rows
    give the same mean whatever the partitioning or the number of retries. A sum
    that outgrows a long fails under ANSI mode instead of wrapping around.
    """
    return ratio(F.sum(scaled(value, places)), F.count(_column(value)) * F.lit(10**places))


def scaled(value: Column | str, places: int = 4) -> Column:
    """A measured double as a whole number of units of its last decimal place."""
    return F.rint(_column(value) * F.lit(float(10**places))).cast("long")
