"""Numeric helpers that keep doubles equal across summation orders and engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def settled(value: Column, digits: int = 4) -> Column:
    """``value`` rounded half up by FLOOR, unlike ROUND equal on every engine."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def half_even(value: Column, step: float) -> Column:
    """Nearest multiple of ``step``, halves to the even one."""
    return F.rint(value / F.lit(step)) * F.lit(step)


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
