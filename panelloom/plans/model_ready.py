"""Autoregressive features and the model-ready table."""

from __future__ import annotations

import math
from collections.abc import Collection

from pyspark.sql import DataFrame

from panelloom.operators import preprocess, windows
from panelloom.plans.conflict import TARGET

SPIKE_FATALITIES = 500
WIDTHS = (3, 6, 12)

# Columns on the log scale before preprocessing, columns that are
# no features, and columns that repeat others.
ALREADY_LOG1P = frozenset({
    "ucdp_event_count", "ucdp_fatalities_best", "ucdp_fatalities_high", "ucdp_civilian_deaths",
    "ucdp_peak_event_fatalities", "ucdp_fatality_uncertainty", "gdelt_conflict_event_count",
    "gdelt_goldstein_mean", "acled_fatalities", "acled_event_count", "acled_peak_fatalities",
    "acled_battle_count", "acled_explosion_count", "acled_violence_count", "acled_protest_count",
    "acled_riot_count", "acled_airstrike_count", "acled_armed_clash_count",
    "acled_political_violence_count", "acled_demonstration_count", "gpr_global", "gpr_acts",
    "event_count", "tone_std",
})
NOT_FEATURES = frozenset({
    "year", "month", "region", "vdem_stale_flag", "vdem_available", "reign_available", "fx_available",
    "food_available", "gdp_available", "coup_event",
})
REDUNDANT = frozenset({
    "fx_volatility_log", "food_price_anomaly", "pt_coup_event", "governance_deficit", "repression_index",
    "ucdp_peak_event_fatalities", "v2x_civlib", "v2x_clpol", "v2xnp_regcorr", "v2x_corr",
})
TRAIN_END, VAL_END = "2024-03", "2024-06"


def autoregressive(df: DataFrame, target: str = TARGET, spike: float = SPIKE_FATALITIES) -> DataFrame:
    """Lags, rolling statistics, z-scores and time since the last spike of a log1p target.

    All windows share one partitioning and order: a single exchange and sort.
    """
    df = windows.target_lags(df, target)
    df = windows.rolling_target_stats(df, target, WIDTHS)
    df = windows.rolling_target_zscores(df, WIDTHS)
    return windows.periods_since_spike(df, target, math.log1p(spike))


def build(
    merged: DataFrame,
    target: str = TARGET,
    train_end: str = TRAIN_END,
    with_history: bool = True,
    already_log1p: Collection[str] = ALREADY_LOG1P,
    exclude: Collection[str] = NOT_FEATURES,
    redundant: Collection[str] = REDUNDANT,
) -> preprocess.Preprocessed:
    """Merged panel (a stored stage, as it is read twice) to the model-ready panel."""
    df = autoregressive(merged, target) if with_history else merged
    return preprocess.preprocess_panel(df, target, train_end, exclude, already_log1p, redundant)
