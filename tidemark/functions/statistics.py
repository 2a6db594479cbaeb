"""Closed-form test statistics as Column expressions, so that one job can read
out any number of experiments or segments without leaving the JVM."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_OVER_ROOT_PI = 2.0 / math.sqrt(math.pi)
NEAR = 2.5  # up to here the series converges fast and loses few digits


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, to about 12 digits everywhere.

    Near zero it is one minus the error function, whose series with terms
    2^n x^(2n+1) / (2n+1)!! has one sign. Farther out it is the continued fraction of the
    tail, which does not cancel as one minus a distribution function does.
    """
    square = x * x
    series = F.lit(1.0)
    for n in range(45, 0, -1):
        series = F.lit(1.0) + series * square * F.lit(2.0 / (2 * n + 1))
    fraction = x
    for n in range(45, 0, -1):
        fraction = x + F.try_divide(F.lit(n / 2.0), fraction)
    near = F.lit(1.0) - F.lit(TWO_OVER_ROOT_PI) * x * F.exp(-square) * series
    far = F.try_divide(F.exp(-square), F.lit(math.sqrt(math.pi)) * fraction)
    return F.when(x <= NEAR, near).otherwise(far)


def chi_square_tail(x: Column, df: Column) -> Column:
    """Probability that a chi-square variable of ``df`` (whole, 1 or more) degrees exceeds x.

    For whole degrees the tail is a finite sum: of exp(-h) h^k / k! below df / 2 if df is even; else
    of erfc(sqrt(h)) and exp(-h) h^(k - 1/2) / gamma(k + 1/2), with h = x / 2.
    """
    half = x / F.lit(2.0)
    odd = df % 2 == 1
    first = F.when(odd, F.lit(TWO_OVER_ROOT_PI) * F.sqrt(half)).otherwise(F.lit(1.0))
    shift = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))
    terms = F.floor(df / 2).cast("int")
    added = F.aggregate(
        F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")),
        F.struct(first.alias("term"), F.lit(0.0).alias("sum")),
        lambda s, k: F.struct(
            (s["term"] * half / (k.cast("double") + shift)).alias("term"),
            (s["sum"] + s["term"]).alias("sum"),
        ),
        lambda s: s["sum"],
    )
    return F.when(odd, erfc(F.sqrt(half))).otherwise(0.0) + F.exp(-half) * added


def two_sided_p(z: Column) -> Column:
    return erfc(F.abs(z) / F.lit(2.0**0.5))


def pooled_z(hits_a: Column, n_a: Column, hits_b: Column, n_b: Column) -> Column:
    """z of rate a minus rate b, under one common rate."""
    pool = F.try_divide(hits_a + hits_b, n_a + n_b)
    spread = F.sqrt(
        pool * (F.lit(1.0) - pool) * (F.try_divide(F.lit(1.0), n_a) + F.try_divide(F.lit(1.0), n_b))
    )
    return F.try_divide(F.try_divide(hits_a, n_a) - F.try_divide(hits_b, n_b), spread)


def standard_error(rate: Column, n: Column) -> Column:
    return F.sqrt(F.try_divide(rate * (F.lit(1.0) - rate), n))


def critical_z(alpha: float) -> float:
    return NormalDist().inv_cdf(1 - alpha / 2)


def required_per_arm(base_rate: Column, lift: float, alpha: float, power: float) -> Column:
    """Users needed in each arm to see an absolute ``lift`` over ``base_rate``."""
    target = base_rate + F.lit(lift)
    middle = (base_rate + target) / F.lit(2.0)
    null_spread = F.sqrt(F.lit(2.0) * middle * (F.lit(1.0) - middle))
    real_spread = F.sqrt(
        base_rate * (F.lit(1.0) - base_rate) + target * (F.lit(1.0) - target)
    )
    total = F.lit(critical_z(alpha)) * null_spread + F.lit(NormalDist().inv_cdf(power)) * real_spread
    return F.ceil(total * total / F.lit(lift * lift)).cast("long")
