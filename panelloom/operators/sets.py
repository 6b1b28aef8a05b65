"""Set operations on keys, entities and registries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_union(frames: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """Distinct keys over all frames; each side is deduplicated before the shuffle."""
    return reduce(DataFrame.union, (f.select(*columns) for f in frames)).distinct()


def membership(frames: Mapping[str, DataFrame], entity: str = "entity") -> DataFrame:
    """(entity, in_<name>...) over the union of entities, in one aggregation."""
    tagged = reduce(
        DataFrame.union,
        (f.select(entity).distinct().withColumn("_from", F.lit(name)) for name, f in frames.items()),
    )
    marks = [F.bool_or(F.col("_from") == name).alias(f"in_{name}") for name in frames]
    return tagged.groupBy(entity).agg(*marks)


def shared(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    return a.select(*columns).intersect(b.select(*columns))


def only_in(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    return a.select(*columns).subtract(b.select(*columns))


def registry_union(*registries: DataFrame) -> DataFrame:
    """Rows of all registries; columns a registry lacks are NULL."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), registries)
