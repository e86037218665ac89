"""Interval bounds, index percentiles and calibration pieces as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson_lower(k: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of the Wilson score interval of k successes in n trials; 0 without trials."""
    p = k / n
    return F.when(n == 0, 0.0).otherwise((p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


def percentile_index(values: Column, q: float) -> Column:
    """Aggregate: the element at index min(n - 1, floor(n * q)) of the sorted values. For groups of bounded size."""
    xs = F.sort_array(F.collect_list(values))
    return F.get(xs, F.least(F.size(xs) - 1, F.floor(F.size(xs) * F.lit(q)).cast("int")))


def rate(flag: Column) -> Column:
    """Aggregate: the share of rows where the flag is true; null counts as false."""
    return F.avg(F.when(flag, 1.0).otherwise(0.0))
