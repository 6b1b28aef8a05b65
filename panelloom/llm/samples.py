"""Bounded samples of labelled rows and small logistic models fitted on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, usable: Column, per_class: int
) -> list[tuple[str, int, int]]:
    """(text, label, draw) of at most ``per_class`` labelled rows of each class.

    The rows with the smallest keyed hash of the id are drawn, so the sample is
    the same in every run.  It is the only thing that reaches the driver.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(
        usable & F.col("label").isin(0, 1)
    )
    drawn = [
        known.where(F.col("label") == c).distinct().withColumn("draw", F.xxhash64(F.lit(label_col), "id")).orderBy("draw", "id").limit(per_class)
        for c in (0, 1)
    ]
    chosen = drawn[0].unionByName(drawn[1])
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The sample is bounded by 2 * per_class ids, so it may go to every task.
    rows = texts.join(F.broadcast(chosen), "id").select("id", "text", "label", "draw").distinct().collect()
    return [(r.text, r.label, r.draw) for r in sorted(rows, key=lambda r: (r.draw, str(r.id), r.text))]


def share_of_ones(labels: DataFrame, label_col: str, id_col: str, usable: Column) -> float:
    """Share of label 1 among all usable labelled rows."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    share = known.where(usable & F.col("label").isin(0, 1)).agg(F.avg("label")).first()[0]  # one row
    return 0.5 if share is None else float(share)


def class_weights(y: np.ndarray, share: float) -> np.ndarray:
    """Weights that give label 1 its share of the population; the mean weight is 1."""
    return np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 30) -> np.ndarray:
    """Coefficients, the constant last, of a ridge logistic regression on targets in [0, 1]."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ beta)
        slope = x.T @ (weight * (p - y)) + ridge * beta
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        beta -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return beta
