"""Nonlinear functions of a series, as Column -> Column; each stays within the JVM.

Where a value is outside a function's domain the result is NaN or an infinity, never null: null would be skipped silently by
averages, NaN is seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Symbolic = Callable[[Column], Column]


def power(exponent: float) -> Symbolic:
    """x ** exponent; NaN for a negative base and a fractional exponent."""
    return lambda x: F.pow(x, F.lit(float(exponent)))


def log1p(x: Column) -> Column:
    """ln(1 + x); -inf at -1 and NaN below."""
    return F.when(x < -1, F.lit(float("nan"))).when(x == -1, F.lit(float("-inf"))).otherwise(F.log1p(x))


def clip_negative(x: Column) -> Column:
    """max(x, 0); NaN stays NaN and null null."""
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


#: What a symbolic model uses if no functions are named.
DEFAULT: tuple[Symbolic, ...] = (power(1.5), power(0.5), log1p)
