"""Rounding and guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(value: Column, digits: int) -> Column:
    """Round half away from zero, after settling the value at six decimals.

    Sums of doubles differ in their last bits with the order partitions arrive
    in, which could tip a value that lies on a rounding boundary either way. The
    first rounding removes that difference, so every run gives the same result.
    """
    return F.round(F.round(value.cast("double"), 6), digits)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as double, null when the whole is zero or null."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return rnd(ratio(part, whole) * 100, digits)


def tally(condition: Column) -> Column:
    """Number of rows for which the condition is true (0 for an empty group of hits)."""
    return F.sum(F.when(condition, 1).otherwise(0))
