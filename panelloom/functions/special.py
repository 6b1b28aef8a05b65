"""Special functions that Spark SQL lacks, on pandas series or numpy arrays.

Used inside Arrow UDFs only; each is a few vectorised numpy operations.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

# The coefficients of Stirling's series, B(2k) / (2k (2k - 1)).
STIRLING = (
    1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156,
)


def lgamma(x):
    """log |gamma(x)| for positive x, NaN for others.

    Stirling's series above 15, reached from below by the recurrence.
    """
    x = np.asarray(x, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        known = np.where(x > 0, x, np.nan)
        steps = np.maximum(np.ceil(15 - known), 0)
        product, z = np.ones_like(known), known.copy()
        for _ in range(15):
            below = steps > 0
            product = np.where(below, product * z, product)
            z = np.where(below, z + 1, z)
            steps = steps - below
        series = np.zeros_like(z)
        for c in reversed(STIRLING):
            series = series / (z * z) + c
        return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series / z - np.log(product)


def erf(x):
    """Error function: its all-positive series, and the continued fraction of the complement beyond 3."""
    x = np.asarray(x, dtype=float)
    size = np.minimum(np.abs(x), 30.0)
    near = np.minimum(size, 3.0)
    total = np.ones_like(near)
    for k in range(60, 0, -1):
        total = 1 + total * 2 * near * near / (2 * k + 1)
    inner = 2 / math.sqrt(math.pi) * near * np.exp(-near * near) * total
    far = np.maximum(size, 3.0)
    tail = far.copy()
    for k in range(60, 0, -1):
        tail = far + k / 2 / tail
    outer = 1 - np.exp(-far * far) / (tail * math.sqrt(math.pi))
    return np.sign(x) * np.where(size <= 3.0, inner, outer)


def erfc(x):
    """Complement for x >= 0, without cancellation in the tail."""
    x = np.asarray(x, dtype=float)
    far = np.maximum(x, 3.0)
    tail = far.copy()
    for k in range(60, 0, -1):
        tail = far + k / 2 / tail
    return np.where(x < 3.0, 1 - erf(x), np.exp(-far * far) / (tail * math.sqrt(math.pi)))


def normal_cdf(z):
    return 0.5 * (1.0 + erf(np.asarray(z, dtype=float) / math.sqrt(2.0)))


def betainc(a, b, x, iterations: int = 300):
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    # The fraction converges fast below the mean; use the symmetry above it.
    swap = x > (a + 1) / (a + b + 2)
    p, q, t = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(
            lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(t) + q * np.log1p(-t)
        ) / p
        c = np.ones_like(t)
        d = 1 - (p + q) * t / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, iterations + 1):
            for top in (
                m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m)),
                -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1)),
            ):
                d = 1 + top * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + top / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * (d * c)
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
        value = np.where(t <= 0, 0.0, front * h)
    value = np.where(swap, 1 - value, value)
    return np.where(np.isnan(x), np.nan, np.clip(value, 0.0, 1.0))


def student_log_density(z, nu):
    """Log density of the standard Student t."""
    z, nu = np.asarray(z, dtype=float), np.asarray(nu, dtype=float)
    return (
        lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * np.log(nu * math.pi) - (nu + 1) / 2 * np.log1p(z * z / nu)
    )


def student_cdf(z, nu):
    z, nu = np.asarray(z, dtype=float), np.asarray(nu, dtype=float)
    tail = 0.5 * betainc(nu / 2, 0.5, nu / (nu + z * z))
    return np.where(z >= 0, 1 - tail, tail)


def chi2_sf(stat: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of the chi-squared distribution, by the series over its degrees of freedom."""
    x = pd.to_numeric(stat).to_numpy(dtype=float)
    k = pd.to_numeric(df).to_numpy(dtype=float)
    known = ~np.isnan(x) & (k > 0)
    half = np.where(known, np.maximum(x, 0.0), 0.0) / 2
    k = np.where(known, np.floor(k), 1.0)
    odd = k % 2 == 1
    # Recurrence Q(a + 1, h) = Q(a, h) + h^a e^-h / gamma(a + 1), from a = 1/2 or 1.
    tail = np.where(odd, erfc(np.sqrt(half)), np.exp(-half))
    a = np.where(odd, 0.5, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        while (more := a < k / 2 - 1e-9).any():
            term = np.where(half > 0, np.exp(a * np.log(half) - half - lgamma(a + 1)), 0.0)
            tail = np.where(more, tail + term, tail)
            a = a + more
    return pd.Series(np.where(known, np.minimum(tail, 1.0), np.nan), index=stat.index, dtype="float64")
