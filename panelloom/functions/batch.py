"""Numpy kernels for Arrow batches of forecasts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from panelloom.functions.samples import IGN_FLOOR, IGN_PENALTY

# Draws handled at once, to bound the working memory of a Python worker.
DRAWS_PER_SLICE = 1_000_000
COLUMNS = ("crps", "ign", "is_90", "is_50", "pit", "upper", "predicted")


def _quantile(ordered: np.ndarray, q: float) -> np.ndarray:
    position = (ordered.shape[1] - 1) * q
    low = int(math.floor(position))
    high = min(low + 1, ordered.shape[1] - 1)
    return ordered[:, low] + (ordered[:, high] - ordered[:, low]) * (position - low)


def _interval(y: np.ndarray, ordered: np.ndarray, alpha: float) -> np.ndarray:
    low, high = _quantile(ordered, alpha / 2), _quantile(ordered, 1 - alpha / 2)
    return high - low + (2 / alpha) * (np.maximum(low - y, 0) + np.maximum(y - high, 0))


def score_matrix(draws: np.ndarray, y: np.ndarray, alert_quantile: float) -> dict[str, np.ndarray]:
    """Scores of N forecasts with S draws each (an N x S matrix).

    Everything comes from the ordered draws: distances to y from the number of
    draws below it and prefix sums, the spread from their rank weights.
    """
    n = draws.shape[1]
    ordered = np.sort(draws, axis=1)
    upto = np.concatenate([np.zeros((len(y), 1)), np.cumsum(ordered, axis=1)], axis=1)
    below = (ordered <= y[:, None]).sum(axis=1)
    under = np.take_along_axis(upto, below[:, None], axis=1)[:, 0]
    total = upto[:, -1]
    distance = y * (2 * below - n) + total - 2 * under
    ranked = 2 * (ordered @ np.arange(n, dtype=float)) - n * total
    mean = total / n
    deviation = ((ordered - mean[:, None]) ** 2).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        width = (n * 0.75) ** -0.2 * np.sqrt(deviation / (n - 1)) if n > 1 else np.zeros(len(y))
        kernel = np.exp(-0.5 * ((y[:, None] - ordered) / width[:, None]) ** 2).sum(axis=1)
        density = kernel / (n * width * math.sqrt(2 * math.pi))
    flat = np.sqrt(deviation / n) < 1e-10
    missed = np.where(np.abs(y - mean) < 1e-6, 0.0, IGN_PENALTY)
    ign = np.where(flat, missed, -np.log(np.maximum(np.where(flat, 1.0, density), IGN_FLOOR)))
    return {
        "crps": distance / n - ranked / (n * n),
        "ign": ign,
        "is_90": _interval(y, ordered, 0.1),
        "is_50": _interval(y, ordered, 0.5),
        "pit": below / n,
        "upper": _quantile(ordered, alert_quantile),
        "predicted": mean,
    }


def score_batch(samples: pa.Array, y: pa.Array, alert_quantile: float) -> pa.StructArray:
    """Scores of a batch whose forecasts may differ in length; NULL or empty ones score NULL."""
    sizes = pc.fill_null(pc.list_value_length(samples), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = samples.flatten().to_numpy(zero_copy_only=False).astype(float)
    first = np.cumsum(sizes) - sizes
    observed = y.to_numpy(zero_copy_only=False).astype(float)
    out = {c: np.full(len(sizes), np.nan) for c in COLUMNS}
    for size in np.unique(sizes[sizes > 0]):
        where = np.flatnonzero((sizes == size) & ~np.isnan(observed))
        step = max(1, DRAWS_PER_SLICE // int(size))
        for start in range(0, len(where), step):
            part = where[start : start + step]
            draws = flat[first[part][:, None] + np.arange(size)]
            for name, values in score_matrix(draws, observed[part], alert_quantile).items():
                out[name][part] = values
    arrays = [pa.array(v, mask=np.isnan(v)) for v in out.values()]
    return pa.StructArray.from_arrays([*arrays, pa.array(sizes.astype(np.int32))], names=[*COLUMNS, "n_draws"])
