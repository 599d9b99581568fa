"""Two-valued predicates and guarded arithmetic.

Missing values make a test false (never unknown), and a zero or missing
denominator makes a ratio null instead of raising under ANSI mode.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def b(test: Column) -> Column:
    """A boolean test with unknown read as false."""
    return F.coalesce(test, F.lit(False))


def all_of(*tests: Column) -> Column:
    return reduce(lambda x, y: x & y, [b(t) for t in tests])


def any_of(*tests: Column) -> Column:
    return reduce(lambda x, y: x | y, [b(t) for t in tests])


def flag(test: Column) -> Column:
    """0/1 integer of a test."""
    return b(test).cast("int")


def ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def change(value: Column, base: Column) -> Column:
    """Relative change of value against base."""
    return ratio(value - base, base)


def clip(value: Column, low=None, high=None) -> Column:
    """Bound a value, keeping null as null."""
    out = value
    if low is not None:
        out = F.when(out < F.lit(low), F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > F.lit(high), F.lit(high)).otherwise(out)
    return out


def not_nan(value: Column) -> Column:
    """NaN as null (Spark would rank NaN above every number)."""
    return F.when(~F.isnan(value), value)


def larger(x: Column, y: Column) -> Column:
    """Larger of two values; null when either is null."""
    return F.when(x.isNotNull() & y.isNotNull(), F.greatest(x, y))


def half_even(value: Column, places: int) -> Column:
    """Round the scaled double half to even, as array libraries do.

    F.round works on the shortest decimal text and sends ties away from zero;
    price targets sit on half paise often enough for that to show.
    """
    scale = F.lit(float(10**places))
    return F.rint(value.cast("double") * scale) / scale
