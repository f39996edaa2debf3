"""Null-safe clipping and half-even rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value) -> Column:
    """A name becomes a column, a number a literal, a Column stays."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def clip(value, low=None, high=None) -> Column:
    """Bound a value; a missing value stays missing, unlike bare least/greatest."""
    value = as_col(value)
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, as_col(low))
    if high is not None:
        bounded = F.least(bounded, as_col(high))
    return F.when(value.isNotNull(), bounded)


def round_even(value, digits: int) -> Column:
    """Scaled half-even rounding; the added zero turns -0.0 into 0.0."""
    scale = float(10**digits)
    return F.rint(as_col(value) * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def nan_to_null(value) -> Column:
    value = as_col(value)
    return F.when(~F.isnan(value), value)


def share(part, whole) -> Column:
    """part / whole, missing when whole is zero."""
    return F.try_divide(as_col(part).cast("double"), as_col(whole).cast("double"))
