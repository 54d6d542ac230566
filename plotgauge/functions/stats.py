"""Numbers: normalisation, clipping, ranks and correlations."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def clip_judge(score: Column) -> Column:
    """A judge's 1..5 as 0..1."""
    return F.least(F.greatest((score - 1) / 4, F.lit(0.0)), F.lit(1.0))


def minmax(value: Column, low: Column, high: Column) -> Column:
    """Training range to 0..1 with a small offset, not clipped."""
    return ((value - low) / (high - low) + 0.0001) / 1.0001


def average_rank(value: str, partition: list[str]) -> Column:
    """Rank from the highest value down; equal values share the mean of their ranks."""
    ordered = Window.partitionBy(*partition).orderBy(F.desc(value))
    tied = Window.partitionBy(*partition, value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(tied) - 1) / 2.0


def pearson(x: str, y: str) -> Column:
    """Aggregate: correlation of two columns; null where one is constant."""
    n = F.count(F.lit(1))
    sxy = F.sum(F.col(x) * F.col(y)) - F.sum(x) * F.sum(y) / n
    sxx = F.sum(F.col(x) * F.col(x)) - F.sum(x) * F.sum(x) / n
    syy = F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y) / n
    return F.try_divide(sxy, F.sqrt(F.greatest(sxx, F.lit(0.0)) * F.greatest(syy, F.lit(0.0))))


def opencv_lab_to_cielab(l8: Column, a8: Column, b8: Column) -> list[Column]:
    """8-bit LAB as CIELAB, one decimal."""
    return [F.bround(l8 * 100.0 / 255.0, 1), F.bround(a8 - 128.0, 1), F.bround(b8 - 128.0, 1)]
