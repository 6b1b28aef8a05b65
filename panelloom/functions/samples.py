"""Arithmetic on one forecast: an ARRAY<DOUBLE> of draws and the observed value.

Everything here is row-local, so it needs no shuffle and runs where the scan
runs.  ``sorted_draws`` arguments expect the output of :func:`ordered`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

IGN_FLOOR = 1e-10
IGN_PENALTY = 50.0


def ordered(draws: Column) -> Column:
    return F.array_sort(draws)


def total(draws: Column) -> Column:
    return F.aggregate(draws, F.lit(0.0), lambda acc, v: acc + v)


def mean(draws: Column) -> Column:
    return total(draws) / F.size(draws)


def crps(draws: Column, sorted_draws: Column, y: Column, exact: bool = False) -> Column:
    """Continuous ranked probability score of an empirical forecast.

    The spread term weighs the i-th smallest draw (from 0) by ``2i - S``, the
    form used by the published scores this library is compared with.  ``exact``
    uses the unbiased weight ``2i - S + 1``.
    """
    n = F.size(draws).cast("double")
    error = F.aggregate(draws, F.lit(0.0), lambda acc, v: acc + F.abs(v - y)) / n
    shift = 1.0 if exact else 0.0
    weighted = F.transform(sorted_draws, lambda v, i: (2.0 * i - n + F.lit(shift)) * v)
    return error - total(weighted) / (n * n)


def quantile(sorted_draws: Column, q: float) -> Column:
    """Linearly interpolated quantile."""
    position = (F.size(sorted_draws) - 1) * F.lit(float(q))
    low = F.floor(position).cast("int")
    weight = position - low
    at = lambda i: F.element_at(sorted_draws, i + 1)
    high = F.least(low + 1, F.size(sorted_draws) - 1)
    return at(low) + (at(high) - at(low)) * weight


def lower_median(sorted_draws: Column) -> Column:
    """Middle draw; of two middle draws the smaller one."""
    return F.element_at(sorted_draws, F.floor((F.size(sorted_draws) - 1) / 2).cast("int") + 1)


def pit(draws: Column, y: Column) -> Column:
    """Share of draws at or below the observed value."""
    return F.aggregate(draws, F.lit(0.0), lambda acc, v: acc + (v <= y).cast("double")) / F.size(draws)


def zero_share(draws: Column) -> Column:
    return F.aggregate(draws, F.lit(0.0), lambda acc, v: acc + (v == 0).cast("double")) / F.size(draws)


def _moments(draws: Column) -> Column:
    """STRUCT<n, mean, m2> in one pass (Welford)."""

    def step(acc: Column, v: Column) -> Column:
        n = acc["n"] + 1
        mean = acc["mean"] + (v - acc["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (acc["m2"] + (v - acc["mean"]) * (v - mean)).alias("m2"))

    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(draws, zero, step)


def ignorance(draws: Column, y: Column) -> Column:
    """Negative log density of a Gaussian kernel estimate at the observed value.

    The bandwidth follows Silverman's rule.  A forecast without spread scores 0
    when it hits the observation and a fixed penalty when it does not.  Whatever
    is constant over the draws rides in the accumulator: an expression inside
    the lambda would be evaluated for every draw.
    """
    m = _moments(draws)
    start = F.transform(
        F.array(m),
        lambda s: F.struct(
            F.lit(0.0).alias("k"),
            (F.pow(s["n"] * 0.75, F.lit(-0.2)) * F.sqrt(s["m2"] / (s["n"] - 1))).alias("w"),
            s["n"].alias("n"), s["mean"].alias("mean"), s["m2"].alias("m2"), y.alias("y"),
        ),
    )[0]

    def step(acc: Column, v: Column) -> Column:
        z = (acc["y"] - v) / acc["w"]
        kernel = acc["k"] + F.when(acc["m2"] > 0, F.exp(-0.5 * z * z)).otherwise(0.0)
        return F.struct(kernel.alias("k"), *[acc[f].alias(f) for f in ("w", "n", "mean", "m2", "y")])

    def finish(acc: Column) -> Column:
        density = acc["k"] / (acc["n"] * acc["w"] * math.sqrt(2 * math.pi))
        degenerate = F.when(F.abs(acc["y"] - acc["mean"]) < 1e-6, F.lit(0.0)).otherwise(F.lit(IGN_PENALTY))
        flat = F.sqrt(acc["m2"] / acc["n"]) < 1e-10
        return F.when(flat, degenerate).otherwise(-F.log(F.greatest(density, F.lit(IGN_FLOOR))))

    return F.aggregate(draws, start, step, finish)


def interval_score(y: Column, low: Column, high: Column, alpha: float) -> Column:
    """Width of the interval plus a penalty for each side it misses on."""
    miss = F.greatest(low - y, F.lit(0.0)) + F.greatest(y - high, F.lit(0.0))
    return (high - low) + (2.0 / alpha) * miss
