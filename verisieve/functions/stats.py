"""Ranks, intervals and calibration as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_rank(values: Column, p: float, rule: str = "round") -> Column:
    """The value of a sorted array at a percentile, by one of four rules.

    round: round(p * (n - 1)); ceil: ceil(p * n) - 1; floor: floor(p * n), the
    last at most.
    """
    n = F.size(values)
    at = {"round": F.round(F.lit(p) * (n - 1)), "ceil": F.ceil(F.lit(p) * n) - 1, "floor": F.floor(F.lit(p) * n)}[rule]
    return F.get(values, F.greatest(F.least(at.cast("int"), n - 1), F.lit(0)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and zero where b is zero."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson score interval, zero and zero without cases."""
    p = ratio(hits, n)
    zz = F.lit(z * z)
    some = F.nullif(n, F.lit(0))
    denominator = 1 + zz / some
    center = p + zz / (2 * some)
    margin = z * F.sqrt(p * (1 - p) / some + zz / (4 * some * some))
    low, high = (center - margin) / denominator, (center + margin) / denominator
    return F.coalesce(F.greatest(low, F.lit(0.0)), F.lit(0.0)), F.coalesce(F.least(high, F.lit(1.0)), F.lit(0.0))
