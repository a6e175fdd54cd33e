"""Null- and zero-safe arithmetic used by every feature formula."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio_or_zero(num: Column, den: Column) -> Column:
    """``num / den`` in double precision; 0.0 when the denominator is 0 or NULL."""
    n, d = num.cast("double"), den.cast("double")
    return F.when(d != 0, n / d).otherwise(F.lit(0.0))


def finite_or_zero(c: Column) -> Column:
    """NULL, NaN and both infinities become 0.0."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def number_or_zero(c: Column) -> Column:
    """Text or numeric input as double; anything unparsable is 0.0."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def row_mean(cols: list[Column]) -> Column:
    return total(cols) / F.lit(float(len(cols)))


def pick(branches: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    """First branch whose condition holds."""
    cond, value = branches[0]
    out = F.when(cond, value)
    for cond, value in branches[1:]:
        out = out.when(cond, value)
    return out if default is None else out.otherwise(default)
