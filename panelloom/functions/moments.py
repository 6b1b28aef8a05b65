"""Bias-adjusted sample moments as aggregates or window expressions.

Spark's ``skewness`` and ``kurtosis`` are population moments; these apply the
usual small-sample factors and give NULL below the smallest defined n.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def skew(value: Column) -> Column:
    n = F.count(value).cast("double")
    spread = F.stddev_pop(value)
    adjusted = F.skewness(value) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n >= 3, F.when(spread == 0, F.lit(0.0)).otherwise(adjusted))


def excess_kurtosis(value: Column) -> Column:
    n = F.count(value).cast("double")
    spread = F.stddev_pop(value)
    factor = F.try_divide(n - 1, (n - 2) * (n - 3))
    adjusted = factor * ((n + 1) * F.kurtosis(value) + 6)
    return F.when(n >= 4, F.when(spread == 0, F.lit(0.0)).otherwise(adjusted))
