"""From a merged panel to a model-ready table.

Which columns are transformed or dropped depends on the data, so one row of
statistics over all columns comes to the driver; everything after it is a
row-local projection with those numbers as literals.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Collection, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions import draws, moments, scalar
from panelloom.operators import keys as key_ops
from panelloom.operators import profile

CONSTANT_STD = 1e-10
CLIP_SIGMAS = 10.0
LOG1P_MIN_MAX = 100.0
LOG1P_MIN_SKEW = 3.0


def _stats_row(df: DataFrame, aggs: dict[str, Column]) -> dict[str, float | None]:
    """One aggregated row as a dict; its width is the number of columns, not of rows."""
    if not aggs:
        return {}
    return df.agg(*[v.alias(k) for k, v in aggs.items()]).first().asDict()


def log1p_candidate_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, min, max, skewness, is_candidate): non-negative, far-reaching and skewed."""
    stats = profile.per_column(
        df.select(*[F.col(c).cast("double").alias(c) for c in columns]),
        columns,
        {"min": F.min, "max": F.max, "skewness": moments.skew},
    )
    test = (F.col("min") >= 0) & (F.col("max") > LOG1P_MIN_MAX) & (F.col("skewness") > LOG1P_MIN_SKEW)
    return stats.withColumn("is_candidate", F.coalesce(test, F.lit(False)))


def log1p_candidates(df: DataFrame, columns: Sequence[str], already: Collection[str] = ()) -> list[str]:
    """Names of the columns to transform, in the given order."""
    rest = [c for c in columns if c not in already]
    if not rest:
        return []
    chosen = {r["feature"] for r in log1p_candidate_stats(df, rest).filter("is_candidate").collect()}
    return [c for c in rest if c in chosen]


@dataclass
class Scaling:
    """Means and standard deviations of the training rows."""

    mean: dict[str, float | None]
    std: dict[str, float | None]

    @property
    def constant(self) -> list[str]:
        return [c for c, s in self.std.items() if s is not None and s < CONSTANT_STD]


def fit_scaling(df: DataFrame, columns: Sequence[str], train_end: str, period: str = "period") -> Scaling:
    train = df.filter(F.col(period) <= train_end)
    aggs = {}
    for i, c in enumerate(columns):
        aggs[f"m{i}"], aggs[f"s{i}"] = F.avg(c), F.stddev_samp(c)
    row = _stats_row(train, aggs)
    return Scaling({c: row[f"m{i}"] for i, c in enumerate(columns)}, {c: row[f"s{i}"] for i, c in enumerate(columns)})


def scaled(column: str, scaling: Scaling) -> Column:
    """(x - mean) / std; NULL when the training rows give no spread."""
    mean, std = scaling.mean[column], scaling.std[column]
    if mean is None or std is None:
        return F.lit(None).cast("double")
    return F.try_divide(F.col(column) - F.lit(mean), F.lit(std))


def zscore_train(df: DataFrame, columns: Sequence[str], train_end: str, period: str = "period") -> DataFrame:
    """Standardise columns with the statistics of the rows up to ``train_end``."""
    scaling = fit_scaling(df, columns, train_end, period)
    return df.withColumns({c: scaled(c, scaling) for c in columns})


def drop_constant(df: DataFrame, columns: Sequence[str], train_end: str, period: str = "period") -> DataFrame:
    """Drop columns without spread in the training rows."""
    return df.drop(*fit_scaling(df, columns, train_end, period).constant)


def clip_sigma(df: DataFrame, columns: Sequence[str], limit: float = CLIP_SIGMAS) -> DataFrame:
    return df.withColumns({c: scalar.clip(F.col(c), -limit, limit) for c in columns})


def count_beyond(df: DataFrame, columns: Sequence[str], limit: float = CLIP_SIGMAS) -> DataFrame:
    """(n_clipped): cells outside [-limit, limit] over all columns."""
    total = sum((F.count_if(F.abs(F.col(c)) > limit) for c in columns), F.lit(0))
    return df.agg(total.cast("long").alias("n_clipped"))


def count_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(n_missing, n_cells) over all columns."""
    total = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0))
    return df.agg(total.cast("long").alias("n_missing"), (F.count(F.lit(1)) * len(columns)).alias("n_cells"))


def fill_mean_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """0, the training mean, for the missing cells of standardised columns."""
    return df.fillna(0.0, subset=list(columns))


@dataclass
class Preprocessed:
    """A model-ready panel and what was decided on the way."""

    panel: DataFrame
    features: list[str]
    log1p: list[str] = field(default_factory=list)
    redundant: list[str] = field(default_factory=list)
    constant: list[str] = field(default_factory=list)


def preprocess_panel(
    df: DataFrame,
    target: str,
    train_end: str,
    exclude: Collection[str] = (),
    already_log1p: Collection[str] = (),
    redundant: Collection[str] = (),
    entity: str = "entity",
    period: str = "period",
    candidates_on_train: bool = False,
) -> Preprocessed:
    """log1p of heavy-tailed columns, redundant ones out, training z-scores, clip, fill.

    Two passes over the panel (candidates; means and spreads) and one
    projection.  Give it a stored stage rather than a long lazy plan.  The
    candidate test sees all rows unless ``candidates_on_train``.
    """
    left_out = {entity, period, target, *exclude}
    columns = key_ops.feature_columns(df, left_out, suffixes=())
    basis = df.filter(F.col(period) <= train_end) if candidates_on_train else df
    log1p = log1p_candidates(basis, columns, already_log1p)
    dropped = [c for c in columns if c in redundant]
    columns = [c for c in columns if c not in redundant]
    logged = df.select(
        entity,
        period,
        *[(F.log1p(c) if c in log1p else F.col(c).cast("double")).alias(c) for c in columns],
        target,
    )
    scaling = fit_scaling(logged, columns, train_end, period)
    constant = scaling.constant
    features = [c for c in columns if c not in constant]
    cells = [
        F.coalesce(scalar.clip(scaled(c, scaling), -CLIP_SIGMAS, CLIP_SIGMAS), F.lit(0.0)).alias(c) for c in features
    ]
    return Preprocessed(logged.select(entity, period, *cells, target), features, log1p, dropped, constant)


def redundancy_prune(
    df: DataFrame, columns: Sequence[str], target: str, threshold: float = 0.9
) -> tuple[list[str], list[tuple[str, str, float]]]:
    """Kept columns, and (dropped, kept partner, r) for each dropped one.

    Of two columns with |r| above the threshold the one closer to the target
    stays.  Correlations are computed on Spark; the walk runs over the k * k
    results.
    """
    strength = {r["feature"]: r["abs_r"] or 0.0 for r in profile.target_correlation(df, columns, target).collect()}
    place = {c: i for i, c in enumerate(columns)}
    strong = profile.pearson_pairs(df, columns).filter(F.abs("r") > threshold).collect()
    edges = sorted(strong, key=lambda e: (place[e.feature_a], place[e.feature_b]))
    gone: dict[str, tuple[str, float]] = {}
    # All strong pairs of one column are settled together: it takes no part if it
    # was dropped before, but keeps its place until they are through.
    for column, own in groupby(edges, key=lambda e: e.feature_a):
        if column not in gone:
            for pair in [e for e in own if e.feature_b not in gone]:
                ends = sorted((pair.feature_a, pair.feature_b), key=lambda c: (-strength[c], place[c]))
                gone.setdefault(ends[1], (ends[0], pair.r))
    return [c for c in columns if c not in gone], [(c, w, r) for c, (w, r) in sorted(gone.items())]


def time_split(df: DataFrame, train_end: str, val_end: str, period: str = "period") -> DataFrame:
    """Add ``split``: train, val or test by period; the three are disjoint."""
    label = F.when(F.col(period) <= train_end, "train").when(F.col(period) <= val_end, "val").otherwise("test")
    return df.withColumn("split", label)


# Fixed values: (target above, weight), first match wins; others weigh 1.
STRATA = ((500.0, 10.0), (50.0, 5.0), (0.0, 3.0))


def strata_weight(y: Column, strata: Sequence[tuple[float, float]] = STRATA) -> Column:
    weight = None
    for bound, value in strata:
        weight = F.when(y > bound, value) if weight is None else weight.when(y > bound, value)
    return weight.otherwise(1.0)


DIRECT_DRAWS = 1 << 20


def weighted_resample(
    df: DataFrame, weight: str, keys: Sequence[str], n: int | None = None, seed: int = 42, direct: int = DIRECT_DRAWS
) -> DataFrame:
    """Exactly n rows (by default as many as there are) drawn independently with replacement, in proportion to a weight.

    Multinomial splitting down a tree of two levels, about sqrt(rows) buckets by the key's digest and the rows of
    each: the n draws are split over the buckets by weight, each bucket's draws over its rows.  So a row's
    copies are a multinomial count, no draw is shuffled, and no order of rows is global.  Counters name
    the draws: a retried task draws the same.  Beyond ``direct`` draws a node is split by conditional binomials
    instead, so a heavy row costs no more than a light one.  ``keys`` identify a row; NULL and negative weights count as 0; without
    any weight nothing is drawn.
    """
    spark = df.sparkSession
    safe = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = df.count()
    size = rows if n is None else n
    digits = max(1, math.ceil(math.log(max(rows, 1), 16) / 2))
    digest = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), *[F.col(k).cast("string") for k in keys]))
    placed = df.withColumns({"_order": digest, "_bucket": F.substring(digest, 1, digits), "_w": safe})
    # At most 16 * sqrt(rows) buckets go through the driver.
    held = sorted(placed.groupBy("_bucket").agg(F.sum("_w").alias("w")).collect())
    weights = np.array([r["w"] for r in held], dtype=float)
    copies = _bucket_draws(spark, size, weights, seed, direct)
    shared = spark.sparkContext.broadcast({r["_bucket"]: int(c) for r, c in zip(held, copies) if c})
    schema = T.StructType([*placed.schema.fields, T.StructField("_copies", T.LongType())])

    def draw(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        table = table.take(pc.sort_indices(table, sort_keys=[("_order", "ascending"), *[(k, "ascending") for k in keys]]))
        bucket = table.column("_bucket")[0].as_py()
        drawn = draws.split_draws(shared.value.get(bucket, 0), table.column("_w").to_numpy(), *words_of(f"{seed}|{bucket}"), direct=direct)
        return table.append_column("_copies", pa.array(drawn.astype(np.int64))).filter(pa.array(drawn > 0))

    out = placed.groupBy("_bucket").applyInArrow(draw, schema)
    out = out.withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return out.select(*df.columns, "draw")


def words_of(text: str) -> tuple[int, int]:
    """Two 32-bit words that name a stream of random numbers."""
    digest = hashlib.md5(text.encode()).hexdigest()
    return int(digest[:8], 16), int(digest[8:16], 16)


def _bucket_draws(spark: SparkSession, size: int, weights: np.ndarray, seed: int, direct: int) -> np.ndarray:
    """The first level of the tree: up to a number the draws are made in tasks, beyond it the split is one pass over the buckets."""
    key = words_of(f"{seed}|buckets")
    if not size or not weights.sum() > 0:
        return np.zeros(len(weights), dtype=np.int64)
    if size > 100 * direct:
        return draws.split_draws(size, weights, *key, direct=0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(weights), dtype=np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if len(ids):  # consecutive numbers
                total += draws.split_draws(len(ids), weights, *key, first=int(ids[0]), direct=len(ids))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])

    counted = spark.range(size).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(len(weights), dtype=np.int64)
    for r in counted.collect():  # at most one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def uniform_of(keys: Sequence[Column], *salt: Column) -> Column:
    """A number in (0, 1) from the MD5 digest of the keys.

    A digest that every SQL engine has, so a draw can be repeated elsewhere.
    """
    text = F.concat_ws("|", *[c.cast("string") for c in (*salt, *keys)])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))
