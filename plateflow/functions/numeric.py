"""Rounding, clamping and small matrices as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """The nearest integer, halves toward plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("long")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within [low, high]; NaN becomes low."""
    return F.when(F.isnan(x), F.lit(low)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def to_byte(x: Column) -> Column:
    """A unit value as 0 to 255."""
    return half_up(clamp(x) * F.lit(255.0))


def from_byte(v: Column) -> Column:
    return v / F.lit(255.0)


def transform3(m: list[list[float]], v: tuple[Column, Column, Column]) -> tuple[Column, ...]:
    """A 3 x 3 matrix times a vector."""
    return tuple(F.lit(r[0]) * v[0] + F.lit(r[1]) * v[1] + F.lit(r[2]) * v[2] for r in m)


def multiply(a: list[list[float]], b: list[list[float]]) -> list[list[float]]:
    return [[sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)] for i in range(3)]


def inverse(m: list[list[float]]) -> list[list[float]]:
    """Of a 3 x 3 matrix, by cofactors."""
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    cof = [[e * i - f * h, c * h - b * i, b * f - c * e], [f * g - d * i, a * i - c * g, c * d - a * f], [d * h - e * g, b * g - a * h, a * e - b * d]]
    return [[x / det for x in r] for r in cof]
