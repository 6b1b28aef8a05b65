"""Evaluation of forecast tables against published scores."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.operators import aggregates as agg
from panelloom.operators import keys, ordering, scoring


class Report(NamedTuple):
    """Tables of one evaluation; each is small and lazy."""

    usable: DataFrame
    comparison: DataFrame
    per_month: DataFrame
    segments: DataFrame
    calibration: DataFrame
    pit: DataFrame
    leaderboard: DataFrame


WINDOW_START, WINDOW_END = "2024-07", "2025-06"


def evaluate(
    forecasts: DataFrame,
    published: DataFrame,
    model: str = "ours",
    start: str = WINDOW_START,
    end: str = WINDOW_END,
    references: Sequence[str] = scoring.TOP_REFERENCES,
    threshold: float = scoring.SPIKE_THRESHOLD,
) -> Report:
    """Score a forecast table in a window of months, on the months that have events.

    ``forecasts``: entity, period, y, samples.  ``published``: period, model,
    crps, ign, mis.
    """
    window = keys.in_range(forecasts, start, end)
    usable = scoring.usable_periods(window)
    months = usable.filter("usable")
    kept = keys.keep_periods(window, months)
    scored = scoring.score_rows(kept)
    bench = agg.benchmark_means(published, months)
    own = scoring.full_evaluation(scored.withColumn("model", F.lit(model)), ["model"], threshold)
    return Report(
        usable=usable,
        comparison=scoring.compare_models(own, bench),
        per_month=scoring.per_month(scored, keys.keep_periods(published, months), references),
        segments=scoring.segment_scores(scored, threshold),
        calibration=scoring.calibration_summary(kept),
        pit=scoring.pit_histogram(kept),
        leaderboard=ordering.leaderboard(bench),
    )
