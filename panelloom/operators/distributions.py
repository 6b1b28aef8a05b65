"""Jobs over tables of predictive-distribution parameters.

Two families: a zero-inflated mixture of log-normals (``pi_zero``, arrays
``mix_weights``, ``mus``, ``sigmas``) and a hurdle Student t on log1p counts
(``conflict_logit``, ``mu``, ``sigma``, ``nu``).  Densities that Spark SQL can
express stay there; erf, log-gamma, the incomplete beta function and the samplers run in Arrow
batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions import draws, special

EPS = 1e-8
MIN_POSITIVE = 1e-6
MAX_LOG = 15.0
HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


def zilnm_logprob(df: DataFrame, y: str = "y", name: str = "logprob") -> DataFrame:
    """Log probability under the zero-inflated log-normal mixture."""
    log_y = F.log(F.greatest(F.col(y), F.lit(MIN_POSITIVE)))
    terms = F.transform(
        F.arrays_zip("mix_weights", "mus", "sigmas"),
        lambda p: F.log(p["mix_weights"])
        - log_y
        - F.log(p["sigmas"])
        - HALF_LOG_2PI
        - 0.5 * F.pow((log_y - p["mus"]) / p["sigmas"], F.lit(2.0)),
    )
    return (
        df.withColumn("_terms", terms)
        .withColumn("_peak", F.array_max("_terms"))
        .withColumn(
            "_mix",
            F.col("_peak")
            + F.log(F.aggregate("_terms", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("_peak")))),
        )
        .withColumn(
            name,
            F.when(F.col(y) == 0, F.log(F.col("pi_zero") + EPS)).otherwise(
                F.log(1 - F.col("pi_zero") + EPS) + F.col("_mix")
            ),
        )
        .drop("_terms", "_peak", "_mix")
    )


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _normal_cdfs(scores: pa.Array) -> pa.Array:
    flat = scores.flatten()
    values = special.normal_cdf(flat.to_numpy(zero_copy_only=False))
    lengths = pc.fill_null(pc.list_value_length(scores), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values, mask=np.isnan(values)))


def zilnm_cdf(df: DataFrame, y: str = "y", name: str = "cdf") -> DataFrame:
    """Distribution function at y, clipped to [0, 1]; any number of mixture parts.

    Only the standard scores cross to Python, as one list per row.
    """
    log_y = F.log(F.greatest(F.col(y), F.lit(MIN_POSITIVE)))
    scores = F.zip_with("mus", "sigmas", lambda mu, sigma: (log_y - mu) / sigma)
    parts = F.zip_with("mix_weights", _normal_cdfs(scores), lambda w, p: w * p)
    mixture = F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)
    value = F.col("pi_zero") + (1 - F.col("pi_zero")) * mixture
    return df.withColumn(name, F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))))


def _log_sigmoid(x: Column) -> Column:
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


@F.pandas_udf(T.DoubleType())
def _student_log_density(z: pd.Series, nu: pd.Series) -> pd.Series:
    return pd.Series(special.student_log_density(z.to_numpy(dtype=float), nu.to_numpy(dtype=float)), index=z.index)


@F.pandas_udf(T.DoubleType())
def _student_cdf(z: pd.Series, nu: pd.Series) -> pd.Series:
    return pd.Series(special.student_cdf(z.to_numpy(dtype=float), nu.to_numpy(dtype=float)), index=z.index)


def _student_z(y: str) -> Column:
    return (F.log1p(F.greatest(F.col(y), F.lit(0.0))) - F.col("mu")) / F.col("sigma")


def student_part(df: DataFrame, y: str = "y", name: str = "severity_logprob") -> DataFrame:
    """Log density of log1p(y) under the Student t part alone (no Jacobian)."""
    return df.withColumn(name, _student_log_density(_student_z(y), F.col("nu")) - F.log("sigma"))


def hurdle_t_logprob(df: DataFrame, y: str = "y", name: str = "logprob") -> DataFrame:
    """Log probability under the hurdle Student t."""
    part = student_part(df, y, "_part")
    gate = F.col("conflict_logit")
    value = F.when(F.col(y) == 0, _log_sigmoid(-gate)).otherwise(_log_sigmoid(gate) + F.col("_part"))
    return part.withColumn(name, value).drop("_part")


def hurdle_t_cdf(df: DataFrame, y: str = "y", name: str = "cdf") -> DataFrame:
    p_zero = 1 / (1 + F.exp(F.col("conflict_logit")))
    value = p_zero + (1 - p_zero) * _student_cdf(_student_z(y), F.col("nu"))
    return df.withColumn(name, F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


CELLS = 1 << 20  # draws made at once


def keyed(df: DataFrame, keys: Sequence[str], params: Sequence[str], seed: int) -> DataFrame:
    """(keys..., _key, _counter, params...): two 32-bit numbers from one digest of seed and keys, NULL where a parameter is NULL."""
    digest = F.md5(F.concat_ws("|", F.lit(f"{seed}"), *[F.col(k).cast("string") for k in keys]))
    whole = reduce(lambda a, b: a & b, [F.col(p).isNotNull() for p in params])

    def word(at: int) -> Column:
        return F.when(whole, F.conv(F.substring(digest, at, 8), 16, 10).cast("long"))

    cast = [F.col(p).cast("array<double>" if isinstance(df.schema[p].dataType, T.ArrayType) else "double").alias(f"_{p}") for p in params]
    return df.select(*keys, word(1).alias("_key"), word(9).alias("_counter"), *cast)


def sampled(df: DataFrame, keys: Sequence[str], params: Sequence[str], n: int, seed: int, draw) -> DataFrame:
    """(keys..., samples): ``draw`` maps parameters and uniform numbers (rows x draws) to values.

    Draw i of a row takes its four numbers from the row's key and the counters 2i and 2i + 1, so a retried or
    moved task draws the same.  Lists are filled as one flat array, a bounded number of draws at a time.
    """
    source = keyed(df, keys, params, seed)
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = np.arange(n, dtype=np.uint64) * np.uint64(2)
        step = max(1, CELLS // max(n, 1))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                known = np.flatnonzero(part.column(k).is_valid().to_numpy(zero_copy_only=False))
                held = part.take(pa.array(known))
                key, row = (held.column(k + i).to_numpy(zero_copy_only=False).astype(np.uint64)[:, None] for i in (0, 1))
                first, second = draws.uniforms(key, counter, row), draws.uniforms(key, counter + np.uint64(1), row)
                values = draw([held.column(k + 2 + i) for i in range(len(params))], *first, *second)
                full = np.full((part.num_rows, n), np.nan)
                full[known] = values
                missing = np.isnan(full[:, 0]) if n else np.zeros(part.num_rows, dtype=bool)
                samples = pa.ListArray.from_arrays(
                    pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * n), pa.array(full.ravel()), mask=pa.array(missing)
                )
                yield pa.RecordBatch.from_arrays([*part.columns[:k], samples], names=[*keys, "samples"])

    schema = T.StructType([*[source.schema[c] for c in keys], T.StructField("samples", T.ArrayType(T.DoubleType()))])
    return source.mapInArrow(run, schema)


def _flat(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _mixture(params: list[pa.Array], gate, choice, radius, angle) -> np.ndarray:
    """Values of the zero-inflated mixture; rows whose lists differ in length, hold NULL or have no weight give NaN."""
    zero, weights = _flat(params[0]), params[1]
    size = np.stack([pc.list_value_length(p).to_numpy(zero_copy_only=False) for p in params[1:]])
    out = np.full(gate.shape, np.nan)
    score = np.sqrt(-2 * np.log(radius)) * np.cos(2 * math.pi * angle)
    for k in np.unique(size[0]).tolist():
        rows = np.flatnonzero((size == k).all(axis=0)) if k else []
        if not len(rows):
            continue
        weight, mu, sigma = (_flat(p.take(pa.array(rows)).flatten()).astype(float).reshape(-1, k) for p in (weights, *params[2:]))
        good = np.isfinite(weight).all(axis=1) & (weight >= 0).all(axis=1) & (weight.sum(axis=1) > 0) & ~np.isnan(mu + sigma).any(axis=1)
        rows, weight, mu, sigma = rows[good], weight[good], mu[good], sigma[good]
        part = draws.alias_draw(*draws.alias_table(weight), choice[rows])
        level = np.exp(np.take_along_axis(mu, part, 1) + np.take_along_axis(sigma, part, 1) * score[rows])
        out[rows] = np.where(gate[rows] >= zero[rows, None], np.maximum(np.rint(level), 0.0), 0.0)
    return out


def zilnm_sample(df: DataFrame, keys: Sequence[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """(keys..., samples): rounded draws from the zero-inflated log-normal mixture.

    The part comes from an alias table, the normal score from Box and Muller; any number of parts, also by row.
    NULL where a parameter is NULL, the lists differ in length or no part has weight.
    """
    return sampled(df, keys, ["pi_zero", "mix_weights", "mus", "sigmas"], n, seed, _mixture)


def _hurdle(params: list[pa.Array], gate, _, radius, angle) -> np.ndarray:
    logit, mu, sigma, nu = (_flat(p).astype(float)[:, None] for p in params)
    score = np.sqrt(nu * (np.power(radius, -2 / nu) - 1)) * np.cos(2 * math.pi * angle)
    log_y = np.minimum(mu + sigma * score, MAX_LOG)
    return np.where(gate < 1 / (1 + np.exp(-logit)), np.rint(np.maximum(np.expm1(log_y), 0.0)), 0.0)


def hurdle_t_sample(df: DataFrame, keys: Sequence[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """(keys..., samples): rounded draws from the hurdle Student t, log values capped.

    The t score is Bailey's polar form, for any degrees of freedom.
    """
    return sampled(df, keys, ["conflict_logit", "mu", "sigma", "nu"], n, seed, _hurdle)


def _spike_weight(y: str, threshold: float, factor: float) -> Column:
    return F.when(F.col(y) > threshold, factor).otherwise(1.0)


def weighted_nll(
    df: DataFrame, y: str = "y", logprob: str = "logprob", threshold: float = 500.0, factor: float = 5.0
) -> DataFrame:
    """(loss, mean_log_prob): mean negative log likelihood, spikes weighing more."""
    return df.agg(
        F.avg(-F.col(logprob) * _spike_weight(y, threshold, factor)).alias("loss"),
        F.avg(logprob).alias("mean_log_prob"),
    )


def asymmetric_nll(
    df: DataFrame,
    y: str = "y",
    logprob: str = "logprob",
    threshold: float = 500.0,
    factor: float = 5.0,
    alpha: float = 2.0,
    log1p_max: float = 13.5,
) -> DataFrame:
    """(loss, mean_log_prob): as above, and under-prediction weighs more with severity."""
    log_y = F.log1p(F.greatest(F.col(y), F.lit(0.0)))
    under = (log_y - F.col("mu") > 0) & (F.col(y) > 0)
    skewed = F.when(under, 1 + alpha * log_y / log1p_max).otherwise(1.0)
    return df.agg(
        F.avg(-F.col(logprob) * skewed * _spike_weight(y, threshold, factor)).alias("loss"),
        F.avg(logprob).alias("mean_log_prob"),
    )


def hurdle_loss(df: DataFrame, y: str = "y", pos_weight: float = 5.1) -> DataFrame:
    """(loss, bce, nll): weighted gate cross-entropy plus severity loss of positive rows.

    Each part is averaged over its own rows.
    """
    gate = F.col("conflict_logit")
    positive = F.col(y) > 0
    bce = -F.when(positive, pos_weight * _log_sigmoid(gate)).otherwise(_log_sigmoid(-gate))
    scored = student_part(df, y, "_part")
    row = scored.agg(
        F.avg(bce).alias("bce"),
        F.coalesce(F.avg(F.when(F.col(y) > 0.5, -F.col("_part"))), F.lit(0.0)).alias("nll"),
    )
    return row.select((F.col("bce") + F.col("nll")).alias("loss"), "bce", "nll")
