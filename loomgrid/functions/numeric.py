"""Scalar functions of the engine as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that count as zero when dense rows become sparse (fixed value).
EPS = 1e-6


def draw(x: Column) -> Column:
    """A reproducible pseudo-random number of 15 bits from an integer: the high bits of a linear congruential step."""
    return F.floor(F.pmod(x * F.lit(1103515245) + F.lit(12345), F.lit(2147483648)) / 65536).cast("long")


def draw_wide(x: Column) -> Column:
    """30 bits of the same."""
    return draw(x) * 32768 + draw(x + 7919)


def byte_width(n: Column) -> Column:
    """Bytes that hold unsigned integers up to n: 1 to 4."""
    return F.when(n < 1 << 8, 1).when(n < 1 << 16, 2).when(n < 1 << 24, 3).otherwise(4)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def scaled(x: Column, factor: float) -> Column:
    """x times factor; a factor of 0 means not to scale."""
    return x * F.lit(float(factor)) if factor else x
