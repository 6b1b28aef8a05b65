"""Features over an entity's ordered history.

Every operator orders by period within an entity of a panel, so a window
partition holds at most one row per period of the calendar.  Consecutive
operators share one exchange and one sort because they share the window
specification.  Shifts count rows, not months: expand to a skeleton first where
gaps must count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions import scalar


def history(entity: str = "entity", period: str = "period") -> WindowSpec:
    return W.partitionBy(entity).orderBy(period)


def frame(first: int, last: int, entity: str = "entity", period: str = "period") -> WindowSpec:
    return history(entity, period).rowsBetween(first, last)


def so_far(entity: str = "entity", period: str = "period") -> WindowSpec:
    return history(entity, period).rowsBetween(W.unboundedPreceding, W.currentRow)


def at_least(value: Column, over: WindowSpec, minimum: int, result: Column) -> Column:
    """``result`` where the frame holds ``minimum`` non-null values, else NULL."""
    return F.when(F.count(value).over(over) >= minimum, result)


def lag_columns(
    df: DataFrame, columns: Sequence[str], n: int = 1, entity: str = "entity", period: str = "period", suffix: str = ""
) -> DataFrame:
    """Shift columns by n rows per entity, in place or under a suffix."""
    w = history(entity, period)
    return df.withColumns({c + suffix: F.lag(c, n).over(w) for c in columns})


def lag_series(df: DataFrame, columns: Sequence[str], n: int = 1, period: str = "period") -> DataFrame:
    """Shift a month-level series by n rows.

    The table has one row per month, so the single window partition is bounded
    by the calendar; a second row for a month, as in a panel, is an error.
    """
    w = W.partitionBy(F.lit(0)).orderBy(period)
    again = F.lag(period).over(w) == F.col(period)
    fault = F.raise_error(F.concat_ws(" ", F.lit("not a month-level series:"), F.col(period).cast("string")))
    checked = F.when(again, fault.cast(df.schema[period].dataType)).otherwise(F.col(period))
    return df.withColumns({**{c: F.lag(c, n).over(w) for c in columns}, period: checked})


def log_diff(
    df: DataFrame, columns: Sequence[str], entity: str = "entity", period: str = "period", suffix: str = "_ld"
) -> DataFrame:
    """First difference of columns that are log1p already."""
    w = history(entity, period)
    return df.withColumns({c + suffix: F.col(c) - F.lag(c).over(w) for c in columns})


def pct_change(value: str, k: int = 1, entity: str = "entity", period: str = "period") -> Column:
    return scalar.ratio_change(F.col(value), F.lag(value, k).over(history(entity, period)))


def diff(value: str, k: int = 1, entity: str = "entity", period: str = "period") -> Column:
    return F.col(value) - F.lag(value, k).over(history(entity, period))


def rolling_std(
    value: str, rows: int, minimum: int, entity: str = "entity", period: str = "period"
) -> Column:
    w = frame(1 - rows, 0, entity, period)
    return at_least(F.col(value), w, minimum, F.stddev_samp(value).over(w))


def rolling_mean(
    value: str, rows: int, minimum: int, entity: str = "entity", period: str = "period"
) -> Column:
    w = frame(1 - rows, 0, entity, period)
    return at_least(F.col(value), w, minimum, F.avg(value).over(w))


def rolling_deviation(
    value: str, rows: int = 5, minimum: int = 3, floor: float = 0.01, entity: str = "entity", period: str = "period"
) -> Column:
    """(x - rolling mean) / max(rolling std, floor)."""
    spread = scalar.clip(rolling_std(value, rows, minimum, entity, period), low=floor)
    return (F.col(value) - rolling_mean(value, rows, minimum, entity, period)) / spread


def expanding_zscore(
    value: str, minimum: int = 6, floor: float = 1e-8, entity: str = "entity", period: str = "period"
) -> Column:
    """(x - mean so far) / max(std so far, floor) once ``minimum`` values are seen."""
    w = so_far(entity, period)
    score = (F.col(value) - F.avg(value).over(w)) / scalar.clip(F.stddev_samp(value).over(w), low=floor)
    return at_least(F.col(value), w, minimum, score)


def entity_outlier_flag(
    value: str, sigmas: float = 2.0, entity: str = "entity", period: str = "period", expanding: bool = False
) -> Column:
    """1 above the entity's mean + sigmas * std; 0 where the std is NULL or 0.

    By default the whole history counts, which looks ahead; ``expanding`` uses
    the rows so far.
    """
    w = so_far(entity, period) if expanding else W.partitionBy(entity)
    mean, std = F.avg(value).over(w), F.stddev_samp(value).over(w)
    return scalar.flag((std > 0) & (F.col(value) > mean + sigmas * std))


def entity_stats(df: DataFrame, value: str, entity: str = "entity") -> DataFrame:
    """Add the entity's mean and std of a column to its rows, without a join."""
    w = W.partitionBy(entity)
    return df.withColumns(
        {f"{value}_mean": F.avg(value).over(w), f"{value}_std": F.stddev_samp(value).over(w)}
    )


def ffill(df: DataFrame, columns: Sequence[str], entity: str = "entity", period: str = "period") -> DataFrame:
    """Last known value; fills existing rows only."""
    w = so_far(entity, period)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def ffill_limit(
    df: DataFrame, columns: Sequence[str], limit: int = 3, entity: str = "entity", period: str = "period"
) -> DataFrame:
    """Last known value of at most ``limit`` rows ago."""
    w = frame(-limit, 0, entity, period)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def change_flag(value: str, entity: str = "entity", period: str = "period") -> Column:
    """1 where a category differs from the row before, 0 in the first row, NULL for NULL."""
    w = history(entity, period)
    changed = ~F.lag(value).over(w).eqNullSafe(F.col(value))
    first = F.row_number().over(w) == 1
    return F.when(F.col(value).isNull(), None).when(first, F.lit(0.0)).otherwise(changed.cast("double"))


def structural_break(*flags: str) -> Column:
    """1 where any of the flags is 1, NULL counting as 0."""
    hit = F.lit(False)
    for name in flags:
        hit = hit | F.coalesce(F.col(name) == 1, F.lit(False))
    return hit.cast("double")


def periods_since(
    df: DataFrame, event: Column, name: str, entity: str = "entity", period: str = "period"
) -> DataFrame:
    """Rows since the last event: 0 at an event, NULL before the first."""
    row = F.row_number().over(history(entity, period))
    numbered = df.withColumn("_row", row)
    last = F.max(F.when(event, F.col("_row"))).over(so_far(entity, period))
    return numbered.withColumn(name, (F.col("_row") - last).cast("double")).drop("_row")


def cumulative_events(
    df: DataFrame, event: str, name: str, entity: str = "entity", period: str = "period"
) -> DataFrame:
    return df.withColumn(name, F.sum(event).over(so_far(entity, period)))


def stale_flag(
    df: DataFrame, broken: Column, name: str, entity: str = "entity", period: str = "period"
) -> DataFrame:
    """1 in the months of an entity's year after its first break in that year.

    The window key (entity, year) is satisfied by a partitioning on the entity
    that an earlier window left behind.
    """
    year = F.substring(period, 1, 4)
    first = F.min(F.when(broken, F.col(period))).over(W.partitionBy(entity, year))
    return df.withColumn(name, scalar.flag(F.col(period) > first))


def target_lags(df: DataFrame, target: str, entity: str = "entity", period: str = "period") -> DataFrame:
    """target_lag1..3 and target_diff1."""
    w = history(entity, period)
    lags = {f"target_lag{n}": F.lag(target, n).over(w) for n in (1, 2, 3)}
    return df.withColumns({**lags, "target_diff1": lags["target_lag1"] - lags["target_lag2"]})


# Wider frames are walked once instead of being rebuilt for every row.
WIDE = 48


def rolling_target_stats(
    df: DataFrame, target: str, widths: Sequence[int] = (3, 6, 12), entity: str = "entity", period: str = "period", wide: int = WIDE
) -> DataFrame:
    """Mean, median, std and max of the ``w`` rows before the current one.

    Frames of at most ``wide`` rows share the window of the operators around them; a window rebuilds each frame,
    so wider ones, as of daily series, go through ``rolling_walk``.
    """
    out: dict[str, Column] = {}
    for width in [w for w in widths if w <= wide]:
        w = frame(-width, -1, entity, period)
        out[f"target_roll{width}_mean"] = F.avg(target).over(w)
        out[f"target_roll{width}_median"] = F.percentile(F.col(target), 0.5).over(w)
        out[f"target_roll{width}_std"] = F.stddev_samp(target).over(w)
        out[f"target_roll{width}_max"] = F.max(target).over(w)
    rows = df.withColumns(out) if out else df
    wider = [w for w in widths if w > wide]
    return rolling_walk(rows, target, wider, entity, period) if wider else rows


STATS = ("mean", "median", "std", "max")


CELLS = 1 << 20


def moments_before(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of the known ones among the ``width`` values before each; NaN where undefined."""
    padded = np.concatenate([np.full(width, np.nan), values])
    frames = np.lib.stride_tricks.sliding_window_view(padded, width)[: len(values)]
    mean, std = np.full(len(values), np.nan), np.full(len(values), np.nan)
    step = max(1, CELLS // width)
    for lo in range(0, len(values), step):
        part = frames[lo : lo + step]
        known = ~np.isnan(part)
        n = known.sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            middle = np.where(known, part, 0.0).sum(axis=1) / n
            apart = np.where(known, part - middle[:, None], 0.0)
            spread = np.sqrt((apart * apart).sum(axis=1) / (n - 1))
        mean[lo : lo + step] = middle
        std[lo : lo + step] = np.where(n > 1, spread, np.nan)
    return mean, std


def rolling_walk(df: DataFrame, target: str, widths: Sequence[int], entity: str = "entity", period: str = "period") -> DataFrame:
    """The columns of ``rolling_target_stats`` for any widths, in one pass over the sorted rows.

    All widths share the walk.  From row to row a value enters and one leaves an order statistic, so a median costs the
    logarithm of the width.  Means and deviations are summed anew for each row, many rows at once: running sums would keep
    the rounding errors of large values that have left.  A task holds one batch and the last ``max(widths)`` values
    of the current entity, however long its history.
    """
    names = [f"target_roll{w}_{s}" for w in widths for s in STATS]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    at, where, reach = df.columns.index(entity), df.columns.index(target), max(widths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, owner = np.zeros(0), None
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            ids = batch.column(at)
            values = batch.column(where).cast(pa.float64()).to_numpy(zero_copy_only=False)
            new = pc.not_equal(ids.slice(1), ids.slice(0, m - 1)).fill_null(False).to_numpy(zero_copy_only=False)
            new |= ids.slice(1).is_null().to_numpy(zero_copy_only=False) != ids.slice(0, m - 1).is_null().to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(new) + 1).tolist()]
            out = np.full((len(names), m), np.nan)
            for a, b in zip(starts, [*starts[1:], m]):
                head = before if a == 0 and owner is not None and ids[0].as_py() == owner[0] else np.zeros(0)
                series = pd.Series(np.concatenate([head, values[a:b]]))
                for i, width in enumerate(widths):
                    rolled = series.rolling(width, min_periods=1, closed="left")
                    found = *moments_before(series.to_numpy(), width), rolled.median().to_numpy(), rolled.max().to_numpy()
                    for stat, column in zip(("mean", "std", "median", "max"), found):
                        out[i * len(STATS) + STATS.index(stat), a:b] = column[len(head) :]
                before, owner = series.to_numpy()[-reach:], (ids[b - 1].as_py(),)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, mask=np.isnan(c)) for c in out]], names=schema.names)

    return df.repartition(entity).sortWithinPartitions(entity, period).mapInArrow(run, schema)


def rolling_target_zscores(df: DataFrame, widths: Sequence[int] = (3, 6, 12)) -> DataFrame:
    """(lag1 - rolling mean) / rolling std from the columns above; NULL for std 0."""
    lag1 = F.col("target_lag1")
    return df.withColumns(
        {
            f"target_roll{w}_zscore": F.try_divide(lag1 - F.col(f"target_roll{w}_mean"), F.col(f"target_roll{w}_std"))
            for w in widths
        }
    )


def periods_since_spike(
    df: DataFrame,
    target: str,
    threshold: float,
    name: str = "target_months_since_spike",
    entity: str = "entity",
    period: str = "period",
) -> DataFrame:
    """Rows since the lagged target exceeded a threshold."""
    lagged = df.withColumn("_lag1", F.lag(target).over(history(entity, period)))
    return periods_since(lagged, F.col("_lag1") > threshold, name, entity, period).drop("_lag1")


def _windows(
    df: DataFrame, features: Sequence[str], y: Column, size: int, entity: str, period: str, short: bool, keep: Column | None = None
) -> DataFrame:
    """(entity, period, x, y): for each row the ``size`` rows of its entity before it as a list of feature structs, oldest first.

    Rows with fewer predecessors give none, or with ``short`` a list padded in front with zeros; ``keep`` selects rows.
    Sorted rows stream through with the last ``size`` of the current entity carried along, and lists are index
    ranges taken from flat columns, a bounded number at a time: a task holds a batch and its carry, however long a history is.
    """
    cells = F.struct(*features)
    rows = df.select(entity, period, y.alias("y"), cells.alias("_cell"), (F.lit(True) if keep is None else keep).alias("_keep"))
    kind = rows.schema["_cell"].dataType
    schema = T.StructType([rows.schema[entity], rows.schema[period], T.StructField("x", T.ArrayType(kind)), rows.schema["y"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None  # the last rows of the current entity
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            head = carry.num_rows if carry is not None else 0
            joint = batch if not head else pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
            n = joint.num_rows
            ids = joint.column(0)
            new = np.ones(n, dtype=bool)
            new[1:] = pc.not_equal(ids.slice(1), ids.slice(0, n - 1)).fill_null(False).to_numpy(zero_copy_only=False)
            new[1:] |= ids.slice(1).is_null().to_numpy(zero_copy_only=False) != ids.slice(0, n - 1).is_null().to_numpy(zero_copy_only=False)
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            past = np.arange(n) - start
            wanted = joint.column(4).fill_null(False).to_numpy(zero_copy_only=False) & (np.arange(n) >= head)
            at = np.flatnonzero(wanted if short else wanted & (past >= size))
            flat, none = joint.column(3), None
            if short:  # a row of zeros after the last one stands for what is missing
                none = n
                zero = pa.StructArray.from_arrays([pa.array([0], flat.type.field(i).type) for i in range(flat.type.num_fields)], fields=list(flat.type))
                flat = pa.concat_arrays([flat, zero])
            for lo in range(0, len(at), max(1, CELLS // (8 * size))):
                some = at[lo : lo + max(1, CELLS // (8 * size))]
                index = some[:, None] + np.arange(-size, 0)
                if none is not None:
                    index = np.where(index >= start[some][:, None], index, none)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * size), flat.take(pa.array(index.ravel())))
                taken = pa.array(some)
                yield pa.RecordBatch.from_arrays([ids.take(taken), joint.column(1).take(taken), lists, joint.column(2).take(taken)], names=[entity, period, "x", "y"])
            carry = joint.slice(max(int(start[-1]), n - size))

    return rows.repartition(entity).sortWithinPartitions(entity, period).mapInArrow(run, schema)


def sliding_windows(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    size: int = 24,
    entity: str = "entity",
    period: str = "period",
    target_is_log: bool = True,
) -> DataFrame:
    """(entity, period, x, y): the ``size`` feature rows before each row, oldest first.

    Rows with fewer predecessors or a NULL target give none.  Feature rows are
    structs, so NULL cells keep their place.
    """
    y = F.expm1(target) if target_is_log else F.col(target)
    return _windows(df, features, y, size, entity, period, False, y.isNotNull())


def sliding_windows_padded(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    size: int = 24,
    start: str | None = None,
    end: str | None = None,
    entity: str = "entity",
    period: str = "period",
    emit_short: bool = False,
) -> DataFrame:
    """Windows whose target lies in [start, end], NULL targets counting as 0.

    A series shorter than ``size`` is left-padded with zero rows to exactly
    ``size``; a window needs a row after that, so such a series gives none
    unless ``emit_short`` asks for padded windows of every row.
    """
    keep = F.lit(True)
    if start:
        keep = keep & (F.col(period) >= start)
    if end:
        keep = keep & (F.col(period) <= end)
    return _windows(df, features, F.expm1(F.coalesce(F.col(target), F.lit(0.0))), size, entity, period, emit_short, keep)
