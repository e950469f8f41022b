"""The percentile definitions that the metrics use; they are not the same.

Each gives, for n sorted values from index 0, the index of the value, or of the
two values and the share of the second.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest(n: Column, p: float) -> tuple:
    """Index round(p * (n - 1)), halves away from zero."""
    return F.round(F.lit(p) * (n - 1)).cast("long"), None, None


def nearest_even(n: Column, p: float) -> tuple:
    """Index round(p * (n - 1)), halves to even."""
    return F.bround(F.lit(p) * (n - 1)).cast("long"), None, None


def linear(n: Column, p: float) -> tuple:
    """Between the values next to p * (n - 1); p = 0.5 is the median."""
    at = F.lit(p) * (n - 1)
    low = F.floor(at).cast("long")
    return low, F.ceil(at).cast("long"), at - low


DEFINITIONS = {"nearest": nearest, "nearest_even": nearest_even, "linear": linear}


def or_zero(numerator: Column, denominator: Column) -> Column:
    """A rate that is 0.0 where its denominator is not positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))
