"""Numeric column functions.

ANSI mode turns a division by zero into an error, and ``corr`` raises on a constant input,
so every ratio in the library goes through the guarded forms below: an undefined value is NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the 80 % score interval: z, z^2 / 2, z^2 / 4 and z^2.
SCORE_Z = 1.2815515655446004
SCORE_HALF = 0.821187207574908
SCORE_QUARTER = 0.410593603787454
SCORE_FULL = 1.642374415149816


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(as_column(a).cast("double"), as_column(b).cast("double"))


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation of the complete pairs; NULL below two pairs or for a constant side."""
    x, y = as_column(x), as_column(y)
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def is_finite(c: Column | str) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    c = as_column(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def nan_to_zero(c: Column | str) -> Column:
    """NaN becomes 0; NULL stays NULL."""
    return F.nanvl(as_column(c).cast("double"), F.lit(0.0))


def null_to_zero(c: Column | str) -> Column:
    return F.coalesce(as_column(c).cast("double"), F.lit(0.0))


def finite_or_zero(c: Column | str) -> Column:
    """NULL, NaN and infinite become 0."""
    c = as_column(c).cast("double")
    return F.when(is_finite(c), c).otherwise(F.lit(0.0))


def bin_number(c: Column | str, width: float) -> Column:
    """Lower edge of the bin of ``width``; the remainder keeps the sign of the value."""
    if width == 0:
        raise ValueError("bin width must not be zero")
    c = as_column(c)
    return c - c % F.lit(width)


def lenient_number(c: Column | str) -> Column:
    """The number a text starts with, else NULL ('12abc' is 12, 'x' is NULL)."""
    text = as_column(c).cast("string")
    number = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
    infinite = r"^\s*([+-]?Infinity)"
    return F.coalesce(
        F.regexp_extract(text, number, 1).try_cast("double"),
        F.when(text.rlike(infinite), F.regexp_extract(text, infinite, 1)).try_cast("double"),
    )


def number_of(c: Column, data_type: str) -> Column:
    """A value as a double for the cross-tab: lenient for text, NaN counts as missing."""
    value = lenient_number(c) if data_type == "string" else c.cast("double")
    return F.when(~F.isnan(value), value)


def row_mean(*columns: Column | str) -> Column:
    """Mean over several columns of one row, leaving NULLs out; NULL if all are NULL."""
    cols = [as_column(c).cast("double") for c in columns]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    present = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in cols])
    return safe_div(total, present)


def score_bound(numerator: Column, denominator: Column, upper: bool) -> Column:
    """80 % score bound of the ratio of two sums; NULL where it is undefined.

    A ratio outside [0, 1] can make the root negative: that is undefined as well.
    """
    ratio = safe_div(numerator, denominator)
    spread = F.try_divide(F.lit(SCORE_QUARTER), denominator * denominator) + F.try_divide(
        ratio * (1 - ratio), denominator)
    side = F.lit(SCORE_Z if upper else -SCORE_Z) * F.sqrt(F.when(spread >= 0, spread))
    centre = F.try_divide(F.lit(SCORE_HALF), denominator) + ratio
    return F.try_divide(centre + side, 1 + F.try_divide(F.lit(SCORE_FULL), denominator))


def volume_band(c: Column | str) -> Column:
    """Below 100 low, below 1000 medium, else high."""
    c = as_column(c)
    return F.when(c < 100, "low").when(c < 1000, "medium").otherwise("high")
