"""Volatility panel: risk indices, media tone and market series aligned by month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.operators import aggregates as agg
from panelloom.operators import features, joins, keys, windows

PANEL_START, PANEL_END = "1985-01", "2025-12"

# Series names, redundant columns and columns on the log scale.
MARKET_SERIES = (
    "vix", "brent_oil", "wti_oil", "gold", "dxy", "us_10y_yield", "wheat", "copper", "us_13w_tbill",
)
REDUNDANT = (
    "total_articles", "hostile_event_count", "cooperative_event_count", "gpr_threats", "goldstein_min",
    "brent_oil_mean", "brent_oil_vol", "brent_oil_close", "brent_oil_pct_chg",
    "vix_close", "wti_oil_close", "gold_close", "dxy_close", "us_10y_yield_close", "wheat_close",
    "copper_close", "us_13w_tbill_close",
)
LOG1P_FEATURES = ("gpr_global", "gpr_acts", "gpr_country", "event_count", "tone_std")
TONE_COLUMNS = ("tone_mean", "tone_min", "tone_max", "tone_std", "event_count", "goldstein_mean")
RISK_COLUMNS = ("gpr_global", "gpr_threats", "gpr_acts")


def market_months(daily: DataFrame, series: str = "series", date: str = "date", close: str = "close") -> DataFrame:
    """Daily closes to one row per month with mean, volatility, close and change of each series."""
    return agg.series_to_columns(agg.daily_to_monthly(daily, series, date, close), list(MARKET_SERIES))


def tone_months(old: DataFrame, new: DataFrame, boundary: int = 2015) -> DataFrame:
    """News events of two eras to tone measures per FIPS code and month."""
    both = agg.union_eras(old, new, "Year", boundary)
    dated = keys.with_period_from_yyyymmdd(both, "SQLDATE")
    return agg.tone_by_month(dated, "ActionGeo_CountryCode", "AvgTone", "NumArticles", "GoldsteinScale")


def tone_for_entities(tone: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Tone of every code that reaches an entity, lagged by a month.

    Codes that share an entity are merged, so the lookup key stays unique.
    """
    recoded = keys.recode_chain(tone, "code", first, second)
    columns = [c for c in TONE_COLUMNS if c in recoded.columns]
    measures = [agg.Measure(c, {"event_count": "sum", "tone_min": "min", "tone_max": "max"}.get(c, "mean"), F.col(c)) for c in columns]
    return windows.lag_columns(agg.aggregate(recoded, list(keys.KEYS), measures), columns)


def align(
    risk: DataFrame,
    risk_global: DataFrame | None = None,
    tone: DataFrame | None = None,
    crosswalk: DataFrame | None = None,
    market: DataFrame | None = None,
    start: str = PANEL_START,
    end: str = PANEL_END,
) -> DataFrame:
    """All sources in range, lagged by a month and joined to the entity-level risk index.

    ``tone`` is by FIPS ``code`` and needs ``crosswalk`` (entity, code).  Rows
    without a lagged risk index go; redundant columns are dropped and
    heavy-tailed ones logged.
    """
    panel = windows.lag_columns(keys.in_range(risk, start, end).select("entity", "period", "gpr_country"), ["gpr_country"])
    if risk_global is not None:
        series = keys.in_range(risk_global, start, end).select("period", *RISK_COLUMNS)
        panel = joins.attach_monthly(panel, windows.lag_series(series, list(RISK_COLUMNS)))
    if tone is not None:
        measures = [c for c in tone.columns if c not in ("code", "period")]
        lagged = windows.lag_columns(keys.in_range(tone, start, end), measures, entity="code")
        panel = joins.join_through_crosswalk(panel, lagged, crosswalk, "code")
    if market is not None:
        measures = [c for c in market.columns if c != "period"]
        panel = joins.attach_monthly(panel, windows.lag_series(keys.in_range(market, start, end), measures))
    panel = panel.filter(F.col("gpr_country").isNotNull())
    return features.log1p_plain(keys.drop_listed(panel, REDUNDANT), LOG1P_FEATURES)
