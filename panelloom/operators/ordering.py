"""Sorts, top-k and seeded samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def panel_sort(df: DataFrame, entity: str = "entity", period: str = "period") -> DataFrame:
    """Global order by key (range partitioning, no single-task sort)."""
    return df.orderBy(entity, period)


def top_entities(df: DataFrame, value: str, k: int = 20, entity: str = "entity") -> DataFrame:
    """(entity, mean, position) of the k entities with the highest mean.

    The limit keeps k rows per task before they meet; the position is numbered
    over those k rows.
    """
    means = df.groupBy(entity).agg(F.avg(value).alias("mean"))
    top = means.filter(F.col("mean").isNotNull()).orderBy(F.desc("mean"), entity).limit(k)
    w = W.partitionBy(F.lit(0)).orderBy(F.desc("mean"), entity)
    return top.withColumn("position", F.row_number().over(w))


def top_entity_matrix(
    df: DataFrame, value: str, k: int = 20, entity: str = "entity", period: str = "period"
) -> DataFrame:
    """Mean per (entity, period) of the top k entities, with their position.

    Long form of the heat map; k rows are broadcast.
    """
    top = top_entities(df, value, k, entity)
    cells = df.join(F.broadcast(top.select(entity, "position")), entity)
    return cells.groupBy("position", entity, period).agg(F.avg(value).alias("value"))


def pivot_periods(matrix: DataFrame, periods: Sequence[str], entity: str = "entity", value: str = "value") -> DataFrame:
    """Periods to columns for a given list of periods."""
    return matrix.groupBy("position", entity).pivot("period", list(periods)).agg(F.first(value))


def top_rows(df: DataFrame, order: Sequence, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def seeded_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """n pseudo-random rows in the order of a key digest, the same for any partitioning."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return df.withColumn("_draw", draw).orderBy("_draw", *keys).limit(n).drop("_draw")


def leaderboard(means: DataFrame, benchmark_prefix: str = "VIEWS_bm") -> DataFrame:
    """Models by CRPS with rank and a benchmark mark.

    One row per model: the number of models, not of forecasts, bounds the
    single window partition.
    """
    w = W.partitionBy(F.lit(0)).orderBy("crps", "model")
    return means.select(
        F.row_number().over(w).alias("rank"),
        "model",
        "crps",
        "ign",
        "mis",
        F.col("model").startswith(benchmark_prefix).alias("is_benchmark"),
    )
