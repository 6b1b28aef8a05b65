"""Row-local features: transforms, composites, encodings and availability."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions import scalar


MOST_LABELS = 10_000  # that may become columns


def log1p_clip(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """log1p(max(x, 0)) on the listed columns that exist."""
    return df.withColumns({c: scalar.log1p_clipped(F.col(c)) for c in columns if c in df.columns})


def log1p_plain(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.log1p(c) for c in columns if c in df.columns})


def expm1_target(df: DataFrame, target: str) -> DataFrame:
    """Undo log1p on the target."""
    return df.withColumn(target, F.expm1(target))


def governance_deficit(*indices: str) -> Column:
    """1 - mean of the indices; missing ones are skipped."""
    return 1 - scalar.row_mean([F.col(c) for c in indices])


def repression_index(corruption: Sequence[str], integrity: str) -> Column:
    """Half of (mean corruption + 1 - physical integrity)."""
    return (scalar.row_mean([F.col(c) for c in corruption]) + (1 - F.col(integrity))) / 2


def one_hot_fixed(df: DataFrame, column: str, values: Sequence[int], prefix: str) -> DataFrame:
    """One 0/1 column per value of a closed category; NULL gives 0 everywhere."""
    return df.withColumns({f"{prefix}_{v}": scalar.flag(F.col(column) == v) for v in values})


def one_hot_open(df: DataFrame, column: str, prefix: str, labels: Sequence[str] | None = None) -> DataFrame:
    """One 0/1 column per label that occurs.

    The labels fix the output schema, so without ``labels`` the distinct ones
    come to the driver; more than ``MOST_LABELS`` are refused.  ``one_hot_long`` needs none of them there.
    """
    if labels is None:
        found = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(MOST_LABELS + 1).collect()
        if len(found) > MOST_LABELS:
            raise ValueError(f"{column} has more than {MOST_LABELS} labels; use one_hot_long")
        labels = sorted(r[0] for r in found)
    return df.withColumns({f"{prefix}_{v}": scalar.flag(F.col(column) == v) for v in labels})


def one_hot_long(df: DataFrame, column: str, keys: Sequence[str] = ("entity", "period")) -> DataFrame:
    """(keys..., label, flag): a row for each label that is set; for categories too wide for columns."""
    return df.filter(F.col(column).isNotNull()).select(*keys, F.col(column).alias("label"), F.lit(1).alias("flag"))


def availability(df: DataFrame, markers: Mapping[str, str]) -> DataFrame:
    """flag -> 1 where the source's marker column is known, 0 if it is missing or absent."""
    flags = {}
    for flag, marker in markers.items():
        flags[flag] = F.col(marker).isNotNull().cast("int") if marker in df.columns else F.lit(0)
    return df.withColumns(flags)


def months_since_date(df: DataFrame, date: str, name: str, period: str = "period") -> DataFrame:
    """Average-length months since a (text or typed) date; future dates give NULL."""
    return df.withColumn(name, scalar.months_since(F.col(period), F.col(date).try_cast("date")))


def age_risk(df: DataFrame, age: str, name: str, low: float = 40, high: float = 75) -> DataFrame:
    return df.withColumn(name, scalar.outside_band(F.col(age), low, high))
