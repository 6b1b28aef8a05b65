"""Scores of sample-based forecasts.

A forecast table has (entity, period, y, samples ARRAY<DOUBLE>).  Scores are
computed row by row; summaries are small mergeable aggregates over them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions import samples as draws
from panelloom.functions.batch import score_batch
from panelloom.functions.special import chi2_sf
from panelloom.operators import quantiles
from panelloom.operators.ordering import top_rows
from panelloom.operators.windows import frame

SPIKE_THRESHOLD = 500.0
ALERT_QUANTILE = 0.9
SUMMARY_QUANTILES = {"p05": 0.05, "p10": 0.10, "p25": 0.25, "p75": 0.75, "p90": 0.90, "p95": 0.95}


def with_sorted(df: DataFrame, samples: str = "samples") -> DataFrame:
    return df.withColumn("_sorted", draws.ordered(F.col(samples)))


def crps_rows(df: DataFrame, samples: str = "samples", y: str = "y", exact: bool = False) -> DataFrame:
    """Add ``crps``."""
    score = draws.crps(F.col(samples), F.col("_sorted"), F.col(y), exact)
    return with_sorted(df, samples).withColumn("crps", score).drop("_sorted")


def crps_mean(df: DataFrame, samples: str = "samples", y: str = "y") -> DataFrame:
    return crps_rows(df, samples, y).agg(F.avg("crps").alias("crps"))


def ignorance_rows(df: DataFrame, samples: str = "samples", y: str = "y") -> DataFrame:
    """Add ``ign``."""
    return df.withColumn("ign", draws.ignorance(F.col(samples), F.col(y)))


def interval_rows(df: DataFrame, alpha: float, name: str = "interval_score", samples: str = "samples", y: str = "y") -> DataFrame:
    """Add the interval score of the central 1 - alpha sample interval."""
    low = draws.quantile(F.col("_sorted"), alpha / 2)
    high = draws.quantile(F.col("_sorted"), 1 - alpha / 2)
    score = draws.interval_score(F.col(y), low, high, alpha)
    return with_sorted(df, samples).withColumn(name, score).drop("_sorted")


def mean_interval_scores(df: DataFrame, alphas: Sequence[float] = (0.1, 0.5), samples: str = "samples", y: str = "y") -> DataFrame:
    """(mis_90, mis_50, ...): mean interval scores."""
    ordered = with_sorted(df, samples)
    aggs = []
    for alpha in alphas:
        low = draws.quantile(F.col("_sorted"), alpha / 2)
        high = draws.quantile(F.col("_sorted"), 1 - alpha / 2)
        name = f"mis_{round(100 * (1 - alpha))}"
        aggs.append(F.avg(draws.interval_score(F.col(y), low, high, alpha)).alias(name))
    return ordered.agg(*aggs)


def pit_rows(df: DataFrame, samples: str = "samples", y: str = "y") -> DataFrame:
    """Add ``pit``."""
    return df.withColumn("pit", draws.pit(F.col(samples), F.col(y)))


def _pit_bin(pit: Column, bins: int) -> Column:
    return F.least(F.floor(pit * bins).cast("int"), F.lit(bins - 1))


def pit_histogram(df: DataFrame, bins: int = 10, samples: str = "samples", y: str = "y") -> DataFrame:
    """(bin, low, high, n, observed_freq, expected_freq), empty bins included.

    One aggregation gives all bin counts as columns of one row.
    """
    scored = pit_rows(df, samples, y).select(_pit_bin(F.col("pit"), bins).alias("_b"))
    row = scored.agg(
        F.array(*[F.count_if(F.col("_b") == i) for i in range(bins)]).alias("_n"), F.count(F.lit(1)).alias("_total")
    )
    return row.select(F.posexplode("_n").alias("bin", "n"), "_total").select(
        "bin",
        (F.col("bin") / bins).alias("low"),
        ((F.col("bin") + 1) / bins).alias("high"),
        "n",
        F.try_divide(F.col("n"), F.col("_total")).alias("observed_freq"),
        F.lit(1.0 / bins).alias("expected_freq"),
    )


def pit_chi2(histogram: DataFrame) -> DataFrame:
    """(chi2_stat, chi2_pval): test of a PIT histogram against uniformity.

    The p-value is the upper tail of the chi-squared distribution with bins - 1
    degrees of freedom, which for an odd number of them is a finite sum.
    """
    expected = F.sum("n").cast("double") / F.count(F.lit(1))
    stats = histogram.agg(
        F.sum(F.col("n").cast("double") * F.col("n")).alias("_ss"),
        expected.alias("_e"),
        F.sum("n").alias("_total"),
        (F.count(F.lit(1)) - 1).cast("int").alias("_df"),
    )
    chi2 = F.try_divide(F.col("_ss"), F.col("_e")) - F.col("_total")
    return stats.select(chi2.alias("chi2_stat"), "_df").select(
        "chi2_stat", chi2_tail(F.col("chi2_stat"), F.col("_df")).alias("chi2_pval")
    )


@F.pandas_udf(T.DoubleType())
def chi2_tail(stat: pd.Series, df: pd.Series) -> pd.Series:
    return chi2_sf(stat, df)


def _spike_aggs(threshold: float, upper: Column, y: Column) -> dict[str, Column]:
    spike, alert = y > threshold, upper > threshold
    return {
        "n_spikes": F.count_if(spike),
        "n_alerts": F.count_if(alert),
        "_hits": F.count_if(spike & alert),
    }


def _spike_rates(df: DataFrame) -> DataFrame:
    recall = F.try_divide(F.col("_hits"), F.col("n_spikes"))
    precision = F.try_divide(F.col("_hits"), F.col("n_alerts"))
    rated = df.withColumns({"recall": recall, "precision": precision})
    f1 = F.try_divide(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision"))
    return rated.withColumn("f1", f1).drop("_hits")


def spike_metrics(
    df: DataFrame,
    threshold: float = SPIKE_THRESHOLD,
    alert_quantile: float = ALERT_QUANTILE,
    samples: str = "samples",
    y: str = "y",
) -> DataFrame:
    """(n_spikes, n_alerts, recall, precision, f1); a rate without a base is NULL."""
    upper = draws.quantile(F.col("_sorted"), alert_quantile)
    aggs = _spike_aggs(threshold, F.col("_upper"), F.col(y))
    row = with_sorted(df, samples).select(y, upper.alias("_upper")).agg(*[v.alias(k) for k, v in aggs.items()])
    return _spike_rates(row)


SCORE_SCHEMA = T.StructType(
    [
        *[T.StructField(n, T.DoubleType()) for n in ("crps", "ign", "is_90", "is_50", "pit", "upper", "predicted")],
        T.StructField("n_draws", T.IntegerType()),
    ]
)


@F.arrow_udf(SCORE_SCHEMA)
def _all_scores(samples: pa.Array, y: pa.Array) -> pa.Array:
    return score_batch(samples, y, ALERT_QUANTILE)


def score_rows(df: DataFrame, samples: str = "samples", y: str = "y") -> DataFrame:
    """All row-level scores of a forecast table in one projection; drops the samples.

    One Arrow batch function sorts each forecast once and derives every score
    from it in numpy.  With a thousand draws per row that is several times as
    fast as the higher-order functions behind the single scores above, which
    sort and walk the array once per score.
    """
    kept = [c for c in df.columns if c != samples]
    scored = df.select(*kept, _all_scores(F.col(samples), F.col(y)).alias("_s"))
    return scored.select(*kept, *[F.col(f"_s.{f.name}").alias(f.name) for f in SCORE_SCHEMA.fields])


def full_evaluation(
    scored: DataFrame, by: Sequence[str] = (), threshold: float = SPIKE_THRESHOLD, bins: int = 10, y: str = "y"
) -> DataFrame:
    """One row of all metrics per group of scored rows (see :func:`score_rows`)."""
    spikes = _spike_aggs(threshold, F.col("upper"), F.col(y))
    counts = F.array(*[F.count_if(_pit_bin(F.col("pit"), bins) == i) for i in range(bins)])
    aggs = [
        F.avg("crps").alias("crps"),
        F.avg("ign").alias("ign"),
        F.avg("is_90").alias("mis_90"),
        F.avg("is_50").alias("mis_50"),
        *[v.alias(k) for k, v in spikes.items()],
        counts.alias("_bins"),
        F.count(F.lit(1)).alias("n_observations"),
        F.try_divide(F.sum(F.col("predicted") * F.col("n_draws")), F.sum("n_draws")).alias("mean_predicted"),
        F.avg(y).alias("mean_observed"),
    ]
    row = _spike_rates((scored.groupBy(*by) if by else scored).agg(*aggs))
    expected = F.col("n_observations") / bins
    squares = F.aggregate("_bins", F.lit(0.0), lambda acc, n: acc + n.cast("double") * n)
    chi2 = F.try_divide(squares, expected) - F.col("n_observations")
    row = row.withColumn("chi2_stat", chi2)
    return row.withColumn("chi2_pval", chi2_tail(F.col("chi2_stat"), F.lit(bins - 1))).drop("_bins")


def usable_periods(df: DataFrame, y: str = "y", period: str = "period") -> DataFrame:
    """(period, usable): whether some entity has a positive observation."""
    return df.groupBy(period).agg(F.coalesce(F.max(F.col(y) > 0), F.lit(False)).alias("usable"))


COMPARISON_COLUMNS = (
    "model", "crps", "ign", "mis_90", "mis_50", "spike_recall", "spike_precision", "spike_f1",
    "calib_chi2_p", "n",
)


def compare_models(evaluations: DataFrame, benchmarks: DataFrame, label: str = "[views] ") -> DataFrame:
    """Own models and published benchmarks in one table by CRPS.

    ``evaluations`` is :func:`full_evaluation` by model; benchmark rows know
    three scores, the rest is NULL.
    """
    own = evaluations.select(
        "model", "crps", "ign", "mis_90", "mis_50",
        F.col("recall").alias("spike_recall"), F.col("precision").alias("spike_precision"),
        F.col("f1").alias("spike_f1"), F.col("chi2_pval").alias("calib_chi2_p"),
        F.col("n_observations").alias("n"),
    )
    published = benchmarks.select(
        F.concat(F.lit(label), F.col("model")).alias("model"), "crps", "ign", F.col("mis").alias("mis_90")
    )
    return own.unionByName(published, allowMissingColumns=True).select(*COMPARISON_COLUMNS).orderBy("crps", "model")


# Published models shown next to the own one.
TOP_REFERENCES = (
    "VIEWS_bm_ph_conflictology_country12",
    "ConflictForecast",
    "Randahl_Vegelius_markov_omm",
    "CCEW_tft",
)


def per_month(
    scored: DataFrame, published: DataFrame, references: Sequence[str] = TOP_REFERENCES, period: str = "period"
) -> DataFrame:
    """(period, own, <reference>...): mean CRPS per month, and an ``AVG`` row.

    The average row is the plain mean over months of each column.
    """
    own = scored.groupBy(period).agg(F.avg("crps").alias("own"))
    picks = [F.max(F.when(F.col("model") == m, F.col("crps"))).alias(m) for m in references]
    others = published.filter(F.col("model").isin(*references)).groupBy(period).agg(*picks)
    months = own.join(others, period, "left")
    average = months.agg(*[F.avg(c).alias(c) for c in ("own", *references)]).withColumn(period, F.lit("AVG"))
    return months.unionByName(average)


def segment_scores(scored: DataFrame, threshold: float = SPIKE_THRESHOLD, y: str = "y") -> DataFrame:
    """(segment, crps, n) for no, some and extreme events."""
    segment = (
        F.when(F.col(y) > threshold, F.lit(f"y > {threshold:g}"))
        .when(F.col(y) > 0, F.lit(f"0 < y <= {threshold:g}"))
        .otherwise(F.lit("y = 0"))
    )
    return scored.groupBy(segment.alias("segment")).agg(F.avg("crps").alias("crps"), F.count(F.lit(1)).alias("n"))


def calibration_summary(df: DataFrame, samples: str = "samples", y: str = "y") -> DataFrame:
    """Mean predicted zero share and mean/median of predicted means against the observed."""
    rows = df.select(
        draws.zero_share(F.col(samples)).alias("pzero"), draws.mean(F.col(samples)).alias("predicted"), F.col(y).alias("observed")
    )
    means = rows.agg(
        F.avg("pzero").alias("mean_pzero"),
        F.avg((F.col("observed") == 0).cast("double")).alias("zero_rate"),
        F.avg("predicted").alias("mean_predicted"),
        F.avg("observed").alias("mean_observed"),
    )
    medians = quantiles.quantiles(rows, ["predicted", "observed"], {"m": 0.5})
    picks = [
        F.max(F.when(F.col("feature") == c, F.col("m"))).alias(f"median_{c}") for c in ("predicted", "observed")
    ]
    # One row each: the medians are attached as scalar subqueries.
    one = medians.agg(F.struct(*picks).alias("s")).scalar()
    return means.select("*", one["median_predicted"].alias("median_predicted"), one["median_observed"].alias("median_observed"))


def sample_summary(df: DataFrame, samples: str = "samples") -> DataFrame:
    """Mean, lower-middle median, quantiles and zero share per forecast; drops the samples."""
    o = F.col("_sorted")
    stats = {"mean": draws.mean(F.col(samples)), "median": draws.lower_median(o)}
    stats |= {name: draws.quantile(o, q) for name, q in SUMMARY_QUANTILES.items()}
    stats["zero_share"] = draws.zero_share(F.col(samples))
    return with_sorted(df, samples).withColumns(stats).drop("_sorted", samples)


def top_models(comparison: DataFrame, k: int = 15) -> DataFrame:
    return top_rows(comparison.select("model", "crps"), [F.col("crps").asc_nulls_last(), "model"], k)


def history_forecast(
    df: DataFrame, value: str, size: int = 12, entity: str = "entity", period: str = "period"
) -> DataFrame:
    """Forecast table whose samples are the entity's previous ``size`` values.

    The naive historical forecast that published leaderboards use as benchmark.
    """
    past = F.collect_list(value).over(frame(-size, -1, entity, period))
    rows = df.select(entity, period, F.col(value).alias("y"), past.alias("samples"))
    return rows.filter(F.col("y").isNotNull() & (F.size("samples") == size))


def union_models(forecasts: dict[str, DataFrame]) -> DataFrame:
    """Forecast tables of several models with a ``model`` column."""
    return reduce(DataFrame.unionByName, (df.withColumn("model", F.lit(name)) for name, df in forecasts.items()))
