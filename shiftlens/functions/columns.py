"""Column expressions shared by the operators (all JVM-side, no UDFs)."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3.6e9
MICROS_PER_DAY = 8.64e10


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros_between(start, end) -> Column:
    """Exact elapsed microseconds ``end - start`` for NTZ timestamps (bigint)."""
    return F.timestamp_diff("MICROSECOND", col(start), col(end))


def hours_between(start, end) -> Column:
    """Fractional hours (``total_seconds() / 3600``)."""
    return micros_between(start, end) / F.lit(MICROS_PER_HOUR)


def days_between(start, end) -> Column:
    """Fractional days (``total_seconds() / 86400``)."""
    return micros_between(start, end) / F.lit(MICROS_PER_DAY)


def hour_boundaries_between(start, end) -> Column:
    """Warehouse ``DATEDIFF('hour', a, b)``: number of hour boundaries crossed."""
    return F.timestamp_diff("HOUR", F.date_trunc("HOUR", col(start)), F.date_trunc("HOUR", col(end)))


def clip(c, lower=None, upper=None) -> Column:
    """``Series.clip``: bounds applied, null stays null.

    ``greatest``/``least`` skip nulls, so the null case is kept explicitly.
    """
    c = col(c)
    out = c
    if lower is not None:
        out = F.greatest(out, lower if isinstance(lower, Column) else F.lit(lower))
    if upper is not None:
        out = F.least(out, upper if isinstance(upper, Column) else F.lit(upper))
    return F.when(c.isNotNull(), out)


def flag(cond: Column) -> Column:
    """0/1 integer from a boolean condition (null -> 0)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def sum_columns(cols) -> Column:
    return reduce(add, [col(c) for c in cols])


def safe_ratio(num, den) -> Column:
    """``num / den`` as double, null when ``den`` is 0 or null."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


# Terms of the two expansions of erfc; both are converged to double precision where they are used.
ERF_SERIES_TERMS = 50
ERFC_FRACTION_TERMS = 120


def erfc(x) -> Column:
    """Complementary error function to double precision.

    Up to |x| = 2 it is 1 - erf, with erf from its series of positive terms
    ``2x/sqrt(pi) exp(-x^2) sum (2x^2)^n / (1*3*..*(2n+1))``; beyond, the
    continued fraction ``exp(-x^2)/sqrt(pi) / (x + (1/2)/(x + (2/2)/(x + ..)))``.
    Both are folded from the innermost term outwards.
    """
    x = col(x).cast("double")
    z = F.abs(x)
    decay = F.exp(-z * z) / F.lit(math.sqrt(math.pi))

    def fold(terms: int, start: Column, step) -> Column:
        return F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), start, step)

    series = fold(ERF_SERIES_TERMS, F.lit(1.0), lambda acc, k: F.lit(1.0) + acc * F.lit(2.0) * z * z / (F.lit(2) * k + 1))
    fraction = fold(ERFC_FRACTION_TERMS, z, lambda acc, k: z + k / F.lit(2.0) / acc)
    upper = F.when(z <= 2, F.lit(1.0) - F.lit(2.0) * z * decay * series).otherwise(decay / fraction)
    return F.when(x >= 0, upper).otherwise(F.lit(2.0) - upper)


def normal_two_sided_p(z) -> Column:
    """Two-sided normal p for a non-negative statistic: ``2*sf(z) = erfc(z/sqrt2)``."""
    return erfc(col(z) / F.lit(2.0 ** 0.5))


def r6(c) -> Column:
    """Round a double to 6 places (stable comparison across engines)."""
    return F.round(col(c).cast("double"), 6)
