"""History features of series too long for one window partition.

The operators of ``windows`` put an entity's whole history into one task, which the calendar bounds for monthly
panels but nothing bounds for daily or event series of one hot entity.  Here the rows are dealt to blocks by ranges
of (entity, period), so a long history spans many blocks and a block many short ones.  Each block of an entity is
reduced to a mergeable state; the states, one row per block and entity, are scanned in
order; and every block is finished in parallel from the state before it.  The results are those of
``windows``.  Keys are unique; the blocks are a stored stage, so all passes see the same ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelloom.functions import scalar
from panelloom.session import stored

BLOCK = "_block"


def in_blocks(df: DataFrame, blocks: int | None = None, entity: str = "entity", period: str = "period") -> DataFrame:
    """The rows with the number of their block; by default as many blocks as shuffle partitions, or fewer for little data."""
    by = [entity, period]
    ranged = df.repartitionByRange(blocks, *by) if blocks else df.repartitionByRange(*by)
    return stored(df.sparkSession, ranged.withColumn(BLOCK, F.spark_partition_id()), "blocks")


def inner(entity: str, period: str) -> WindowSpec:
    """An entity's rows of one block so far."""
    return W.partitionBy(entity, BLOCK).orderBy(period).rowsBetween(W.unboundedPreceding, W.currentRow)


def carried(rows: DataFrame, states: Mapping[str, Column], before: Mapping[str, Column], entity: str = "entity") -> DataFrame:
    """The rows with the state of all earlier blocks of their entity.

    ``states`` are aggregates of a block; ``before`` combines them by aggregates over the blocks before.
    """
    reduced = rows.groupBy(entity, BLOCK).agg(*[v.alias(k) for k, v in states.items()])
    # At most one row per block and entity.
    earlier = W.partitionBy(entity).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(entity)
    reduced = reduced.withColumns({f"{k}_all": F.sum(k).over(whole) for k in ("_n", "_sum") if k in states})
    prefix = reduced.select(F.col(entity).alias("_e"), F.col(BLOCK).alias("_b"), *[v.over(earlier).alias(k) for k, v in before.items()])
    return rows.join(prefix, F.col(entity).eqNullSafe(F.col("_e")) & (F.col(BLOCK) == F.col("_b"))).drop("_e", "_b")


def ffill(rows: DataFrame, columns: Sequence[str], entity: str = "entity", period: str = "period") -> DataFrame:
    """Last known value, over blocked rows."""
    last = {f"_last_{c}": F.max_by(c, F.when(F.col(c).isNotNull(), F.col(period))) for c in columns}
    out = carried(rows, last, {k: F.last(k, ignorenulls=True) for k in last}, entity)
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(inner(entity, period)), F.col(f"_last_{c}")) for c in columns}
    return out.withColumns(filled).drop(*last)


def cumulative_events(rows: DataFrame, event: str, name: str, entity: str = "entity", period: str = "period") -> DataFrame:
    """Running sum of a column, over blocked rows; NULL before its first value."""
    out = carried(rows, {"_held": F.sum(event)}, {"_before": F.sum("_held")}, entity)
    here = F.sum(event).over(inner(entity, period))
    known = here.isNotNull() | F.col("_before").isNotNull()
    zero = F.lit(0)
    return out.withColumn(name, F.when(known, F.coalesce(here, zero) + F.coalesce("_before", zero))).drop("_before")


def periods_since(rows: DataFrame, event: Column, name: str, entity: str = "entity", period: str = "period") -> DataFrame:
    """Rows since the last event: 0 at an event, NULL before the first; over blocked rows."""
    w = inner(entity, period)
    numbered = rows.withColumn("_row", F.row_number().over(W.partitionBy(entity, BLOCK).orderBy(period)))
    marked = numbered.withColumn("_hit", F.when(event, F.col("_row")))
    # Rows from a block's last event to its end, if it has one, and all its rows.
    states = {"_rows": F.count(F.lit(1)), "_tail": F.count(F.lit(1)) - F.max("_hit")}
    out = carried(marked, states, {"_past": F.sum("_rows"), "_blocks": F.collect_list(F.struct("_rows", "_tail"))}, entity)
    # Fold the states before: rows since the last event at the end of each block.
    since = F.aggregate(
        "_blocks", F.lit(None).cast("long"), lambda acc, s: F.coalesce(s["_tail"], acc + s["_rows"])
    )
    last = F.max("_hit").over(w)
    value = F.when(last.isNotNull(), F.col("_row") - last).otherwise(since + F.col("_row"))
    return out.withColumn(name, value.cast("double")).drop("_row", "_hit", "_past", "_blocks")


def expanding_zscore(
    rows: DataFrame, value: str, name: str, minimum: int = 6, floor: float = 1e-8, entity: str = "entity", period: str = "period"
) -> DataFrame:
    """(x - mean so far) / max(std so far, floor) once ``minimum`` values are seen, over blocked rows.

    Blocks merge by count, mean and centred squares; block means are taken from the entity's overall mean, so
    large levels do not cancel.
    """
    x = F.col(value).cast("double")
    states = {"_n": F.count(x), "_sum": F.sum(x), "_m2": F.var_pop(x) * F.count(x)}
    off = F.try_divide(F.col("_sum"), F.col("_n")) - F.try_divide(F.col("_sum_all"), F.col("_n_all"))
    before = {
        "_n0": F.sum("_n"),
        "_s0": F.sum(F.col("_n") * off),
        "_q0": F.sum(F.coalesce("_m2", F.lit(0.0)) + F.coalesce(F.col("_n") * off * off, F.lit(0.0))),
        "_c": F.max(F.try_divide(F.col("_sum_all"), F.col("_n_all"))),
    }
    out = carried(rows, states, before, entity)
    w = inner(entity, period)
    n0, n1 = F.coalesce("_n0", F.lit(0)), F.count(x).over(w)
    n = n0 + n1
    mean0 = F.try_divide(F.col("_s0"), n0.cast("double"))
    m20 = F.coalesce(F.col("_q0") - F.col("_s0") * mean0, F.lit(0.0))
    mean0 = F.coalesce(mean0 + F.col("_c"), F.lit(0.0))
    mean1, m21 = F.coalesce(F.avg(x).over(w), F.lit(0.0)), F.coalesce(F.var_pop(x).over(w) * n1, F.lit(0.0))
    apart = mean1 - mean0
    mean = F.try_divide(mean0 * n0 + mean1 * n1, n.cast("double"))
    m2 = m20 + m21 + F.coalesce(apart * apart * F.try_divide((n0 * n1).cast("double"), n.cast("double")), F.lit(0.0))
    std = F.when(n > 1, F.sqrt(F.greatest(F.try_divide(m2, (n - 1).cast("double")), F.lit(0.0))))
    score = (x - mean) / scalar.clip(std, low=floor)
    return out.withColumn(name, F.when(n >= minimum, score)).drop("_n0", "_s0", "_q0", "_c")
