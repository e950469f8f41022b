"""Algebra of inclusive intervals [lo, hi], as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Interval = tuple[Column, Column]


def contains(a: Interval, x: Column) -> Column:
    return x.between(*a)


def overlaps(a: Interval, b: Interval) -> Column:
    return (a[0] <= b[1]) & (b[0] <= a[1])


def disjoint(a: Interval, b: Interval) -> Column:
    return ~overlaps(a, b)


def covers(a: Interval, b: Interval) -> Column:
    return (a[0] <= b[0]) & (b[1] <= a[1])


def intersection(a: Interval, b: Interval) -> Interval:
    """May be inverted, which means empty."""
    return F.greatest(a[0], b[0]), F.least(a[1], b[1])


def hull(a: Interval, b: Interval) -> Interval:
    return F.least(a[0], b[0]), F.greatest(a[1], b[1])


def from_half_open(start: Column, stop: Column) -> Interval:
    """[start, stop) as an inclusive interval; 0..0 stays [0, 0], as lengths below one do not exist."""
    return start, F.greatest(start, stop - 1)


def split_even(lo: Column, hi: Column, parts: int) -> Column:
    """An array of at most ``parts`` (lo, hi) pieces of [lo, hi], as even as can
    be, without gap or overlap; pieces that would be empty are left out."""
    span = hi - lo + 1
    n = F.least(F.lit(parts).cast("long"), span)
    cut = lambda i: lo + F.expr("0").cast("long") + F.floor(i * span / n)
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct(cut(i).alias("lo"), (cut(i + 1) - 1).alias("hi")))
