"""NULL-preserving scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helioframe.schema import NIGHT_HOURS


def as_column(value: Column | str | float | int) -> Column:
    """A column name, a Column, or a number as a Column."""
    if isinstance(value, str):
        return F.col(value)
    if isinstance(value, Column):
        return value
    return F.lit(float(value))


def measure(col: Column | str) -> Column:
    """DOUBLE with NULL for missing: NaN would compare as the largest number."""
    x = as_column(col).cast("double")
    return F.when(~F.isnan(x), x)


def at_least(x: Column, low: float) -> Column:
    # greatest() would turn a NULL into the bound.
    return F.when(x < low, F.lit(float(low))).otherwise(x)


def clip(x: Column, low: float, high: float) -> Column:
    bounded = F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))
    return F.when(x.isNotNull(), bounded)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division with NULL for a zero denominator (plain ``/`` raises under ANSI)."""
    return F.try_divide(numerator, denominator)


def is_night(ts: Column | str, hours: tuple[int, ...] = NIGHT_HOURS) -> Column:
    return F.hour(as_column(ts)).isin(*hours)


def capacity_factor(generation: Column, capacity: Column) -> Column:
    """``generation / capacity`` in [0, 1].

    Zero capacity follows IEEE division before clipping: any output is full load, any
    draw is none, 0/0 is unknown.
    """
    at_zero = F.when(generation > 0, F.lit(1.0)).when(generation < 0, F.lit(0.0))
    return F.when(capacity == 0, at_zero).otherwise(clip(ratio(generation, capacity), 0.0, 1.0))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation aggregate, NULL for a constant input (``corr`` raises under ANSI)."""
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
