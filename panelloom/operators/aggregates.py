"""Events to (entity, period) rows, and month-level summaries.

All aggregates here are mergeable, so Spark combines them on the map side: an
entity with a third of all events sends one partial row per task and period.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelloom.functions import scalar
from panelloom.operators import keys


class Measure(NamedTuple):
    """One output column: ``how`` is count, sum, min, max, mean, std or count_if."""

    name: str
    how: str
    value: Column


_DIRECT = {
    "count": lambda v: F.count(v),
    "sum": lambda v: F.coalesce(F.sum(v), F.lit(0.0)),
    "min": lambda v: F.min(v),
    "max": lambda v: F.max(v),
    "mean": lambda v: F.avg(v),
    "std": lambda v: F.stddev_samp(v),
    "count_if": lambda v: F.count_if(F.coalesce(v, F.lit(False))),
}


def aggregate(df: DataFrame, by: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """One row per key; all measures in one pass."""
    return df.groupBy(*by).agg(*[_DIRECT[m.how](m.value).alias(m.name) for m in measures])


def by_entity(
    df: DataFrame,
    code: str,
    measures: Sequence[Measure],
    crosswalk: DataFrame,
    entity: str = "entity",
    period: str = "period",
    small: bool | None = None,
) -> DataFrame:
    """Aggregate events whose entity is found through a code.

    A crosswalk that is ``small`` (checked unless stated) is broadcast to the
    events, which are then aggregated once.  Beyond that the events are
    aggregated by (code, period) first, recoded, and merged: the join sees one
    row per code and period, so a hot code costs no more than any other.
    """
    if keys.is_small(crosswalk) if small is None else small:
        return aggregate(keys.recode(df, code, F.broadcast(crosswalk), entity), [entity, period], measures)
    partial, final = [], []
    for m in measures:
        if m.how == "mean":
            partial += [F.sum(m.value).alias(f"{m.name}__s"), F.count(m.value).alias(f"{m.name}__n")]
            final.append(F.try_divide(F.sum(f"{m.name}__s"), F.sum(f"{m.name}__n")).alias(m.name))
        elif m.how == "std":
            n, mean, centred = (f"{m.name}__{x}" for x in "nmc")
            partial += [F.count(m.value).alias(n), F.avg(m.value).alias(mean), (F.var_pop(m.value) * F.count(m.value)).alias(centred)]
            final.append(_merged_std(F.col(n), F.col(mean), F.col(centred)).alias(m.name))
        else:
            partial.append(_DIRECT[m.how](m.value).alias(m.name))
            merge = {"min": F.min, "max": F.max}.get(m.how, F.sum)
            final.append(merge(m.name).alias(m.name))
    per_code = df.groupBy(code, period).agg(*partial)
    return keys.recode(per_code, code, crosswalk, entity).groupBy(entity, period).agg(*final)


def _merged_std(n: Column, mean: Column, centred: Column) -> Column:
    """Sample deviation from the count, mean and centred sum of squares of the parts."""
    total = F.sum(n)
    between = F.sum(n * mean * mean) - F.try_divide(F.sum(n * mean) * F.sum(n * mean), total)
    inside = F.coalesce(F.sum(centred), F.lit(0.0)) + F.greatest(between, F.lit(0.0))
    return F.when(total > 1, F.sqrt(inside / (total - 1)))


def conflict_measures(
    best: str, high: str, low: str, civilian: str, kind: str, prefix: str = "ucdp_", kinds=(1, 2, 3)
) -> list[Measure]:
    """Counts, sums, peak, uncertainty and type counts of conflict events."""
    spread = scalar.clip(F.col(high) - F.col(low), low=0.0)
    state, non_state, one_sided = kinds
    return [
        Measure(f"{prefix}event_count", "count", F.lit(1)),
        Measure(f"{prefix}fatalities_best", "sum", F.col(best)),
        Measure(f"{prefix}fatalities_high", "sum", F.col(high)),
        Measure(f"{prefix}civilian_deaths", "sum", F.col(civilian)),
        Measure(f"{prefix}peak_event_fatalities", "max", F.col(best)),
        Measure(f"{prefix}fatality_uncertainty", "mean", spread),
        Measure(f"{prefix}state_based_events", "count_if", F.col(kind) == state),
        Measure(f"{prefix}non_state_events", "count_if", F.col(kind) == non_state),
        Measure(f"{prefix}one_sided_events", "count_if", F.col(kind) == one_sided),
    ]


# Output suffix -> label in the event files.
EVENT_LABELS = {
    "battle_count": "Battles",
    "explosion_count": "Explosions/Remote violence",
    "violence_count": "Violence against civilians",
    "protest_count": "Protests",
    "riot_count": "Riots",
}
SUB_EVENT_LABELS = {"airstrike_count": "Air/drone strike", "armed_clash_count": "Armed clash"}
DISORDER_TEXTS = {"political_violence_count": "political violence", "demonstration_count": "demonstration"}


def label_measures(column: str, labels: dict[str, str], prefix: str = "acled_") -> list[Measure]:
    return [Measure(prefix + n, "count_if", F.col(column) == label) for n, label in labels.items()]


def text_measures(column: str, texts: dict[str, str], prefix: str = "acled_") -> list[Measure]:
    return [Measure(prefix + n, "count_if", scalar.contains_text(F.col(column), t)) for n, t in texts.items()]


def protest_measures(df: DataFrame, prefix: str = "acled_") -> list[Measure]:
    """Event, fatality and category counts; categories the files lack count 0."""
    measures = [
        Measure(f"{prefix}event_count", "count", F.col("event_type")),
        Measure(f"{prefix}fatalities", "sum", F.col("fatalities")),
        Measure(f"{prefix}peak_fatalities", "max", F.col("fatalities")),
        *label_measures("event_type", EVENT_LABELS, prefix),
    ]
    never = F.lit(False)
    if "sub_event_type" in df.columns:
        measures += label_measures("sub_event_type", SUB_EVENT_LABELS, prefix)
    else:
        measures += [Measure(prefix + n, "count_if", never) for n in SUB_EVENT_LABELS]
    if "disorder_type" in df.columns:
        measures += text_measures("disorder_type", DISORDER_TEXTS, prefix)
    else:
        measures += [Measure(prefix + n, "count_if", never) for n in DISORDER_TEXTS]
    return measures


def news_conflict(
    df: DataFrame,
    code: str = "ActionGeo_CountryCode",
    root: str = "EventRootCode",
    score: str = "GoldsteinScale",
    date: str = "SQLDATE",
    conflict_roots: Sequence[str] = ("18", "19", "20"),
    protest_roots: Sequence[str] = ("14",),
    first_day: int = 19850101,
    last_day: int = 20251231,
) -> DataFrame:
    """Conflict and protest event counts and mean score per code and month.

    Both range and category filters apply to plain columns and reach the scan.
    """
    roots = [*protest_roots, *conflict_roots]
    kept = df.filter(
        F.col(root).isin(*roots) & F.col(code).isNotNull() & F.col(date).between(first_day, last_day)
    )
    kept = keys.with_period_from_yyyymmdd(kept, date)
    return aggregate(
        kept.withColumnRenamed(code, "code"),
        ["code", "period"],
        [
            Measure("gdelt_conflict_event_count", "count_if", F.col(root).isin(*conflict_roots)),
            Measure("gdelt_protest_event_count", "count_if", F.col(root).isin(*protest_roots)),
            Measure("gdelt_goldstein_mean", "mean", F.col(score)),
        ],
    )


def regroup(
    df: DataFrame,
    sums: Sequence[str],
    means: Sequence[str],
    entity: str = "entity",
    period: str = "period",
) -> DataFrame:
    """Merge rows that share an entity after recoding: sums, and unweighted means of means."""
    return aggregate(
        df,
        [entity, period],
        [*[Measure(c, "sum", F.col(c)) for c in sums], *[Measure(c, "mean", F.col(c)) for c in means]],
    )


def union_eras(old: DataFrame, new: DataFrame, year: str, first_new_year: int) -> DataFrame:
    """Rows of the old table before the boundary year and of the new one from it on."""
    return old.filter(F.col(year) < first_new_year).unionByName(new.filter(F.col(year) >= first_new_year))


def tone_by_month(
    df: DataFrame, code: str, tone: str, weight: str, score: str, period: str = "period"
) -> DataFrame:
    """Weighted mean, extremes and spread of tone, volumes and score counts per code and month."""
    present = df.filter(F.col(code).isNotNull() & (F.col(code).cast("string") != ""))
    grouped = present.groupBy(F.col(code).alias("code"), F.col(period).alias("period"))
    return grouped.agg(
        F.try_divide(F.sum(F.col(tone) * F.col(weight)), F.sum(weight)).alias("tone_mean"),
        F.min(tone).alias("tone_min"),
        F.max(tone).alias("tone_max"),
        F.stddev_samp(tone).alias("tone_std"),
        F.count(F.lit(1)).alias("event_count"),
        F.sum(weight).alias("total_articles"),
        F.count_if(F.col(score) < -5).alias("hostile_event_count"),
        F.count_if(F.col(score) > 5).alias("cooperative_event_count"),
        F.avg(score).alias("goldstein_mean"),
        F.min(score).alias("goldstein_min"),
    )


def daily_tone(df: DataFrame, code: str, date: str, tone: str) -> DataFrame:
    """Daily tone to monthly mean, extremes, spread and number of days."""
    dated = keys.with_period(df, date)
    return aggregate(
        dated.withColumnRenamed(code, "code"),
        ["code", "period"],
        [
            Measure("tone_mean", "mean", F.col(tone)),
            Measure("tone_min", "min", F.col(tone)),
            Measure("tone_max", "max", F.col(tone)),
            Measure("tone_std", "std", F.col(tone)),
            Measure("days_with_data", "count", F.col(tone)),
        ],
    )


def daily_to_monthly(df: DataFrame, series: str, date: str, close: str) -> DataFrame:
    """Daily closes to (series, period, mean, vol, close, pct_chg).

    Months without data inside a series' span appear with NULL measures; the
    percentage change compares with the last known close before them.
    """
    dated = keys.with_period(df.filter(F.col(date).isNotNull()), date)
    known = F.when(F.col(close).isNotNull(), F.col(date))
    monthly = dated.groupBy(F.col(series).alias("series"), "period").agg(
        F.avg(close).alias("mean"),
        F.stddev_samp(close).alias("vol"),
        F.max_by(close, known).alias("close"),
    )
    span = monthly.groupBy("series").agg(F.min("period").alias("_from"), F.max("period").alias("_to"))
    months = F.sequence(
        scalar.period_start(F.col("_from")), scalar.period_start(F.col("_to")), F.expr("interval 1 month")
    )
    grid = span.select("series", F.explode(months).alias("_m")).select(
        "series", F.date_format("_m", "yyyy-MM").alias("period")
    )
    full = grid.join(monthly, ["series", "period"], "left")
    w = W.partitionBy("series").orderBy("period")
    padded = full.withColumn("_pad", F.last("close", ignorenulls=True).over(w))
    change = scalar.ratio_change(F.col("_pad"), F.lag("_pad").over(w)) * 100
    return padded.withColumn("pct_chg", change).drop("_pad")


SERIES_MEASURES = {"mean": "mean", "vol": "vol", "close": "close", "pct_chg": "pct_chg"}


def series_to_columns(monthly: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per month with ``<series>_<measure>`` columns, in one aggregation."""
    columns = [
        F.max(F.when(F.col("series") == name, F.col(measure))).alias(f"{name}_{suffix}")
        for name in names
        for measure, suffix in SERIES_MEASURES.items()
    ]
    return monthly.filter(F.col("series").isin(*names)).groupBy("period").agg(*columns)


def coup_months(
    df: DataFrame,
    code: str = "coup_code",
    source: str | None = None,
    crosswalk: DataFrame | None = None,
    entity: str = "entity",
    period: str = "period",
    small: bool | None = None,
) -> DataFrame:
    """Event rows (1 failed, 2 successful) to monthly flags and count.

    Rows still keyed by a ``source`` code are recoded through the crosswalk
    after a first aggregation.
    """
    c = F.col(code)
    measures = [
        Measure("pt_coup_successful", "max", scalar.flag(c == 2)),
        Measure("pt_coup_failed", "max", scalar.flag(c == 1)),
        Measure("pt_coup_count", "count", c),
    ]
    if crosswalk is None:
        grouped = aggregate(df, [entity, period], measures)
    else:
        grouped = by_entity(df, source, measures, crosswalk, entity, period, small)
    either = (F.col("pt_coup_successful") == 1) | (F.col("pt_coup_failed") == 1)
    return grouped.withColumn("pt_coup_event", scalar.flag(either))


def monthly_totals(df: DataFrame, columns: Sequence[str], period: str = "period") -> DataFrame:
    """Sum of features over all entities per month."""
    return aggregate(df, [period], [Measure(c, "sum", F.col(c)) for c in columns])


def prevalence(df: DataFrame, flag: str, period: str = "period") -> DataFrame:
    """Share of entities with the flag per month."""
    return df.groupBy(period).agg(F.avg(flag).alias("prevalence"))


def dimensions(df: DataFrame, entity: str = "entity", period: str = "period") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(entity).alias("n_entities"),
        F.count_distinct(period).alias("n_periods"),
        F.min(period).alias("first_period"),
        F.max(period).alias("last_period"),
    )


def benchmark_means(scores: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """Mean scores per model over the usable periods (all without ``periods``)."""
    if periods is not None:
        scores = keys.keep_periods(scores, periods)
    return scores.groupBy("model").agg(
        F.avg("crps").alias("crps"), F.avg("ign").alias("ign"), F.avg("mis").alias("mis")
    )
