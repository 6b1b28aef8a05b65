"""Exact quantiles and tie-averaged ranks without a global sort in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one
buffer, and an unpartitioned ``rank`` sorts everything in one task.

Quantiles: one aggregation with Spark's mergeable sketch gives, for each wanted rank, two values that
bracket it.  A second one counts: values between brackets collapse to one row per gap on
the map side, so only values inside a bracket, a few in ten thousand rows, are shuffled as they are.  The wanted
ranks fall inside brackets by the sketch's error bound; should one fall into a gap, that
column is counted in full.  Columns with few rows need no bracket.

Ranks: rows travel once, through an exchange by ranges of (column, value, keys) that splits even a value that
fills a third of all rows.  Each task numbers its rows and their ties; ties that cross a partition
border are settled from the border values, two a partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.session import stored

# Up to this many rows a column's values fit the buffer of the exact percentile.
DIRECT_LIMIT = 100_000
# Distinct values of a bucket when those inside brackets are ordered.
VALUES_PER_BUCKET = 250_000
# Ranks are bracketed within MARGIN / ACCURACY of the rows on both sides.
ACCURACY = 10_000
MARGIN = 2


def long_values(df: DataFrame, columns: Sequence[str], *rest: Column) -> Column:
    """One struct (feature, value, rest...) per column, to be inlined."""
    return F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), *rest) for c in columns])


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, n, gap) of the non-null values of numeric columns, stored."""
    long = df.select(F.inline(long_values(df, columns))).where(F.col("value").isNotNull())
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return stored(df.sparkSession, counts.withColumn("gap", F.lit(False)), "counts")


Bracket = tuple[float, float]


def brackets(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], accuracy: int = ACCURACY
) -> dict[str, tuple[int, list[Bracket]]]:
    """For each column its number of values, and disjoint ascending intervals that hold its wanted ranks."""
    margin = MARGIN / accuracy
    ends = [min(max(p + s * margin, 0.0), 1.0) for p in probabilities for s in (-1, 1)]
    values = {c: F.col(c).cast("double") for c in columns}
    row = df.agg(  # one row
        F.struct(*[F.count(v).alias(c) for c, v in values.items()]).alias("n"),
        F.struct(*[F.percentile_approx(v, [float(e) for e in ends], accuracy).alias(c) for c, v in values.items()]).alias("ends"),
    ).first()
    out = {}
    for c in columns:
        joint: list[Bracket] = []
        found = row["ends"][c] or []
        for low, high in sorted(zip(found[::2], found[1::2])):
            if joint and low <= joint[-1][1]:
                joint[-1] = (joint[-1][0], max(high, joint[-1][1]))
            else:
                joint.append((low, high))
        out[c] = (row["n"][c], joint)
    return out


def bracketed_counts(df: DataFrame, found: Mapping[str, tuple[int, list[Bracket]]]) -> DataFrame:
    """(feature, value, n, gap): counts of the values inside brackets, and one row for each gap under its largest value."""
    parts = []
    for c, (_, joint) in found.items():
        v = F.col(c).cast("double")
        inside, slot = F.lit(False), F.lit(0)
        for low, high in joint:
            inside = inside | v.between(low, high)
            slot = slot + (v > high).cast("int")
        parts.append(F.struct(F.lit(c).alias("feature"), slot.alias("slot"), F.when(inside, v).alias("kept"), v.alias("value")))
    long = df.select(F.inline(F.array(*parts))).where(F.col("value").isNotNull())
    grouped = long.groupBy("feature", "slot", "kept").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    rows = grouped.select("feature", F.coalesce("kept", "top").alias("value"), "n", F.col("kept").isNull().alias("gap"))
    return stored(df.sparkSession, rows, "brackets")


def cumulative_counts(counts: DataFrame, per_bucket: int = VALUES_PER_BUCKET) -> DataFrame:
    """(feature, value, n, gap, below, total): rows of the feature below each value, and in all."""
    # One row per feature.
    sizes = [r["d"] for r in counts.groupBy("feature").agg(F.count(F.lit(1)).alias("d")).collect()]
    within = (
        W.partitionBy("feature", "bucket").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    if max(sizes, default=0) <= per_bucket:
        counts = counts.withColumn("bucket", F.lit(0))
        total = F.sum("n").over(W.partitionBy("feature", "bucket"))
        return counts.select(
            "feature", "value", "n", "gap", (F.sum("n").over(within) - F.col("n")).alias("below"), total.alias("total")
        )
    ranged = counts.repartitionByRange(max(2, sum(sizes) // per_bucket + 1), "feature", "value")
    # Stored, so that every later pass and retry sees the same buckets.
    bucketed = stored(counts.sparkSession, ranged.withColumn("bucket", F.spark_partition_id()), "buckets")
    totals = bucketed.groupBy("feature", "bucket").agg(F.sum("n").alias("m"))
    ordered = W.partitionBy("feature").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = totals.select(
        "feature",
        "bucket",
        (F.sum("m").over(ordered) - F.col("m")).alias("offset"),
        F.sum("m").over(W.partitionBy("feature")).alias("total"),
    )
    return bucketed.join(offsets, ["feature", "bucket"]).select(
        "feature",
        "value",
        "n",
        "gap",
        (F.col("offset") + F.sum("n").over(within) - F.col("n")).alias("below"),
        "total",
    )


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Mapping[str, float],
    direct_limit: int = DIRECT_LIMIT,
    per_bucket: int = VALUES_PER_BUCKET,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """(feature, <name>...): exact, linearly interpolated quantiles of each column with values.

    Reads ``df`` two times, a third time only if a sketch misses its bound.
    """
    found = brackets(df, columns, list(probabilities.values()), accuracy)
    direct = [c for c, (n, _) in found.items() if n <= direct_limit]
    parts = []
    if direct or not columns:
        parts.append(_direct_quantiles(df, direct, probabilities))
    large = {c: f for c, f in found.items() if c not in direct}
    if large:
        cumulative = cumulative_counts(bracketed_counts(df, large), per_bucket)
        picked = _picked(cumulative, probabilities)
        missed = [r["feature"] for r in picked.where("missed").select("feature").collect()]  # names of columns
        if missed:
            whole = cumulative_counts(value_counts(df, missed), per_bucket)
            picked = picked.where(~F.col("feature").isin(missed)).unionByName(_picked(whole, probabilities))
        parts.append(_interpolated(picked, probabilities))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _direct_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Mapping[str, float]) -> DataFrame:
    ps = F.array(*[F.lit(float(p)) for p in probabilities.values()])
    structs = []
    for c in columns:
        cuts = F.percentile(F.col(c).cast("double"), ps)
        structs.append(F.struct(F.lit(c).alias("feature"), *[F.get(cuts, F.lit(i)).alias(n) for i, n in enumerate(probabilities)]))
    if not structs:
        schema = ", ".join(["feature string", *[f"`{n}` double" for n in probabilities]])
        return df.sparkSession.createDataFrame([], schema)
    rows = df.agg(F.array(*structs).alias("_all")).select(F.inline("_all"))
    return rows.where(F.col(next(iter(probabilities))).isNotNull())


def _picked(cumulative: DataFrame, probabilities: Mapping[str, float]) -> DataFrame:
    """The two values around each position with their weight, and whether one of them lies in a gap."""
    holds = lambda i: (F.col("below") <= i) & (i < F.col("below") + F.col("n"))
    aggs, missed = [], F.lit(False)
    for name, p in probabilities.items():
        position = (F.col("total") - 1) * F.lit(float(p))
        low = F.floor(position)
        high = F.least(low + 1, F.col("total") - 1)
        missed = missed | holds(low) | holds(high)
        aggs += [
            F.max(F.when(holds(low), F.col("value"))).alias(f"{name}__l"),
            F.max(F.when(holds(high), F.col("value"))).alias(f"{name}__h"),
            F.max(position - low).alias(f"{name}__w"),
        ]
    return cumulative.groupBy("feature").agg(*aggs, F.bool_or(F.col("gap") & missed).alias("missed"))


def _interpolated(picked: DataFrame, probabilities: Mapping[str, float]) -> DataFrame:
    return picked.select(
        "feature",
        *[
            (F.col(f"{n}__l") + (F.col(f"{n}__h") - F.col(f"{n}__l")) * F.col(f"{n}__w")).alias(n)
            for n in probabilities
        ],
    )


def tie_runs(k: int):
    """Arrow function over rows sorted by (feature, value): keys..., feature, value -> the same with the partition's number,
    rows of the feature before the run of equal values, its length, and whether it is the first or last one here.

    Only the run at the end of what was read is held back, until it ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        last = None  # feature and value of the held run
        below, first = 0, True

        def out(batch: pa.RecordBatch, under: np.ndarray, n: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(under), pa.array(n), pa.array(edge)],
                names=[*batch.schema.names, "part", "under", "n", "edge"],
            )

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            total = sum(b.num_rows for b in held)
            for b in held:
                yield out(b, np.full(b.num_rows, below), np.full(b.num_rows, total), np.full(b.num_rows, first or final))

        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            feature = batch.column(k).to_numpy(zero_copy_only=False)
            value = batch.column(k + 1).to_numpy(zero_copy_only=False)
            new = np.ones(m, dtype=bool)
            # NaN equals NaN, as in Spark's order.
            new[1:] = (feature[1:] != feature[:-1]) | ~((value[1:] == value[:-1]) | (np.isnan(value[1:]) & np.isnan(value[:-1])))
            same = held and feature[0] == last[0] and (value[0] == last[1] or (np.isnan(value[0]) and np.isnan(last[1])))
            starts = np.flatnonzero(new)
            if same:
                starts = starts[1:]
                head = int(starts[0]) if len(starts) else m
                held.append(batch.slice(0, head))
                if head == m:
                    continue
            if held:
                yield from flush(False)
                below = below + sum(b.num_rows for b in held) if feature[starts[0]] == last[0] else 0
                first, held = False, []
            ends = np.append(starts[1:], m)
            size, kind = ends - starts, feature[starts]
            # Rows of the same feature before each run.
            under = np.cumsum(size) - size + below
            fresh = np.ones(len(starts), dtype=bool)
            fresh[1:] = kind[1:] != kind[:-1]
            fresh[0] = False
            base = np.maximum.accumulate(np.where(fresh, under, 0))
            under = np.where(np.cumsum(fresh) > 0, under - base, under)
            lo, hi = int(starts[0]), int(starts[-1])
            if hi > lo:
                edge = np.zeros(len(starts) - 1, dtype=bool)
                edge[0] = first
                yield out(batch.slice(lo, hi - lo), np.repeat(under[:-1], size[:-1]), np.repeat(size[:-1], size[:-1]), np.repeat(edge, size[:-1]))
                first = False
            held, below, last = [batch.slice(hi)], int(under[-1]), (feature[-1], value[-1])
        yield from flush(True)

    return run


def ranked_rows(df: DataFrame, keys: Sequence[str], columns: Sequence[str], partitions: int | None = None) -> tuple[DataFrame, list[int]]:
    """(keys..., feature, rank): mean ranks of the non-null values, ``feature`` being the column's place; and the values per column."""
    spark = df.sparkSession
    plain = lambda c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c).cast("double"))  # noqa: E731  -0.0 is 0.0
    structs = [F.struct(F.lit(i).alias("_f"), plain(c).alias("_v")) for i, c in enumerate(columns)]
    long = df.select(*keys, F.inline(F.array(*structs))).where(F.col("_v").isNotNull())
    by = ["_f", "_v", *keys]
    ranged = long.repartitionByRange(partitions, *by) if partitions else long.repartitionByRange(*by)
    runs = T.StructType([*long.schema.fields, *T._parse_datatype_string("part int, under bigint, n bigint, edge boolean").fields])
    rows = stored(spark, ranged.sortWithinPartitions("_f", "_v").mapInArrow(tie_runs(len(keys)), runs), "runs")
    # At most one row per partition and column.
    sizes = rows.groupBy("part", "_f").agg(F.count(F.lit(1)).alias("m"))
    before = W.partitionBy("_f").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("part", "_f", "m", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    # At most two values per partition.
    edges = rows.where("edge").groupBy("part", "_f", "_v").agg(F.max("n").alias("n"), F.min("under").alias("under"))
    borders = edges.join(F.broadcast(offsets), ["part", "_f"]).groupBy("_f", "_v").agg(
        F.sum("n").alias("all"), F.min(F.col("offset") + F.col("under")).alias("first")
    )
    met = rows.join(F.broadcast(offsets.drop("m")), ["part", "_f"]).join(
        F.broadcast(borders.withColumn("edge", F.lit(True))), ["_f", "_v", "edge"], "left"
    )
    rank = F.coalesce("first", F.col("offset") + F.col("under")) + (F.coalesce("all", "n") + 1) / 2
    counts = {r["_f"]: r["m"] for r in sizes.groupBy("_f").agg(F.sum("m").alias("m")).collect()}  # one row per column
    return met.select(*keys, F.col("_f").alias("feature"), rank.alias("rank")), [counts.get(i, 0) for i in range(len(columns))]


def average_ranks(df: DataFrame, keys: Sequence[str], columns: Sequence[str], partitions: int | None = None) -> DataFrame:
    """The columns replaced by their ranks (ties share the mean rank, NULL stays NULL); ``keys`` identify a row."""
    return _wide(ranked_rows(df, keys, columns, partitions)[0], keys, columns)


def _wide(ranks: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    picks = [F.max(F.when(F.col("feature") == i, F.col("rank"))).alias(c) for i, c in enumerate(columns)]
    return ranks.groupBy(*keys).agg(*picks)


def centred_ranks(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, list[float]]:
    """``average_ranks`` and the mean rank of every column, which its number of values gives."""
    ranks, counts = ranked_rows(df, keys, columns)
    return _wide(ranks, keys, columns), [(n + 1) / 2 for n in counts]
