"""Structural panel: governance, leaders, exchange rates, growth, food prices and coups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions import scalar
from panelloom.operators import aggregates as agg
from panelloom.operators import features, joins, keys, windows
from panelloom.sources import tables

PANEL_START, PANEL_END = "1985-01", "2025-12"
LEADER_CUTOFF = "2021-08"

# Source columns and output columns.
GOVERNANCE = (
    "v2x_libdem", "v2x_polyarchy", "v2x_civlib", "v2x_rule", "v2x_corr", "v2x_clphy", "v2x_clpol",
    "v2x_freexp_altinf", "v2xcs_ccsi", "v2x_regime", "v2x_partipdem", "v2xnp_regcorr", "v2x_execorr",
    "v2x_frassoc_thick",
)
LEADER_FEATURES = (
    "tenure_months", "age", "male", "militarycareer", "elected", "leader_age_risk", "months_since_election",
    "regime_change", "coup_event", "prev_conflict", "precip", "months_since_structural_break",
)
COUP_COLUMNS = ("pt_coup_event", "pt_coup_successful", "pt_coup_failed", "pt_coup_count")
AVAILABILITY = {
    "vdem_available": "v2x_libdem",
    "reign_available": "tenure_months",
    "fx_available": "fx_volatility",
    "food_available": "food_price_anomaly",
    "gdp_available": "gdp_growth",
}


def _year(period: str) -> int:
    return int(period[:4])


def _known(code: Column, known: Sequence[str] | None) -> Column:
    return F.lit(True) if known is None else code.isin(list(known))


def governance(
    df: DataFrame, known: Sequence[str] | None = None, start: str = PANEL_START, end: str = PANEL_END
) -> DataFrame:
    """Annual governance indices (country_text_id, year, v2*) to months with composites.

    One year before the start gives the first year-on-year change its history.
    """
    columns = [c for c in GOVERNANCE if c in df.columns]
    entity = scalar.clean_code(F.col("country_text_id"))
    rows = df.select(entity.alias("entity"), F.col("year").cast("int").alias("year"), *columns)
    rows = rows.filter(F.col("year").between(_year(start) - 1, _year(end)) & _known(F.col("entity"), known))
    monthly = joins.annual_to_monthly(rows).drop("year")
    filled = windows.ffill(monthly, columns)
    coded = features.one_hot_fixed(filled, "v2x_regime", range(4), "regime_type")
    derived = coded.withColumns(
        {
            "governance_deficit": features.governance_deficit("v2x_libdem", "v2x_polyarchy", "v2x_rule"),
            "repression_index": features.repression_index(["v2x_corr", "v2x_execorr"], "v2x_clphy"),
            "libdem_yoy_change": windows.diff("v2x_libdem", 12),
        }
    )
    return derived.filter(F.col("period") >= start)


def leaders(
    df: DataFrame,
    crosswalk: DataFrame,
    order: Sequence[str] = (),
    labels: Sequence[str] | None = None,
    start: str = PANEL_START,
    cutoff: str = LEADER_CUTOFF,
) -> DataFrame:
    """Leader-month records (ccode, year, month, government, ...) to leader and regime features.

    A country-month may have several records.  ``order`` names the columns that
    order them (all columns by default): changes are taken along that order and
    the last record is kept.  ``labels`` fixes the regime categories.
    """
    dated = keys.with_period_from_parts(df, "year", "month")
    dated = keys.in_range(dated, start, cutoff)
    rows = keys.recode(dated, "ccode", crosswalk).drop("ccode", "year", "month")
    tie = [c for c in (order or sorted(c for c in rows.columns if c not in keys.KEYS))]
    # One sortable position per record: the period, then the tie-break columns.
    rows = rows.withColumn("_at", F.struct("period", *tie))
    made: list[str] = []
    if "age" in rows.columns:
        rows = features.age_risk(rows, "age", "leader_age_risk")
    if "lastelection" in rows.columns:
        rows = features.months_since_date(rows, "lastelection", "months_since_election")
    if "government" in rows.columns:
        rows = rows.withColumn("regime_change", windows.change_flag("government", period="_at"))
        made.append("regime_change")
    if "irregular" in rows.columns:
        rows = rows.withColumn("coup_event", F.col("irregular").cast("double"))
        made.append("coup_event")
    if "government" in rows.columns:
        rows = features.one_hot_open(rows, "government", "reign_regime", labels)
    rows = rows.withColumn("_break", windows.structural_break(*made))
    rows = windows.periods_since(rows, F.col("_break") == 1, "months_since_structural_break", period="_at")
    regimes = [c for c in rows.columns if c.startswith("reign_regime_")]
    out = [c for c in LEADER_FEATURES if c in rows.columns] + regimes
    kept = keys.keep_one(rows.select(*keys.KEYS, "_at", *out), keys.KEYS, ["_at"], keep="last")
    return kept.drop("_at")


def exchange_rates(
    df: DataFrame,
    known: Sequence[str] | None = None,
    imf: DataFrame | None = None,
    start: str = PANEL_START,
    end: str = PANEL_END,
    look_ahead: bool = True,
) -> DataFrame:
    """(iso3 or imf_code, year, month, exchange_rate) to change, volatility and depreciation features.

    Shifts count the months a series has.  The depreciation threshold uses the
    whole history of an entity unless ``look_ahead`` is off.
    """
    named = tables.normalise_columns(df, tables.FX_SYNONYMS, required=["year", "month", "exchange_rate"])
    if "iso3" in named.columns:
        rows = named.withColumn("entity", F.when(_known(F.col("iso3"), known), F.col("iso3")))
    elif imf is not None and "imf_code" in named.columns:
        rows = keys.recode(named, "imf_code", imf)
    else:
        raise ValueError("exchange rates need iso3, or imf_code with a crosswalk")
    rows = keys.coerce_numeric(rows, ["exchange_rate"])
    rows = rows.filter(F.col("entity").isNotNull() & F.col("exchange_rate").isNotNull())
    rows = keys.with_period_from_parts(rows, "year", "month")
    rows = rows.filter(F.substring("period", 1, 4).cast("int").between(_year(start), _year(end)))
    rows = rows.select("entity", "period", "exchange_rate")
    rows = rows.withColumn("fx_pct_change", windows.pct_change("exchange_rate"))
    rows = rows.withColumns(
        {
            "fx_volatility": windows.rolling_std("fx_pct_change", 3, 2),
            "fx_depreciation_flag": windows.entity_outlier_flag("fx_pct_change", 2.0, expanding=not look_ahead),
            "fx_pct_change_zscore": windows.expanding_zscore("fx_pct_change", 6, 1e-8),
        }
    )
    rows = rows.withColumn("fx_volatility_log", F.log1p("fx_volatility"))
    filled = windows.ffill_limit(rows, ["fx_pct_change", "fx_volatility", "fx_volatility_log", "fx_pct_change_zscore"], 3)
    return filled.select(
        "entity", "period", "fx_pct_change", "fx_volatility", "fx_volatility_log", "fx_depreciation_flag",
        "fx_pct_change_zscore",
    )


def growth(
    df: DataFrame, known: Sequence[str] | None = None, start: str = PANEL_START, end: str = PANEL_END
) -> DataFrame:
    """Annual growth (iso3, year, gdp_growth) to months with deviation and shock flag.

    Five years before the start give the first deviations their history.
    """
    named = tables.normalise_columns(df, tables.GDP_SYNONYMS, required=["iso3", "gdp_growth"])
    rows = named.select(
        F.col("iso3").alias("entity"), F.col("year").cast("int").alias("year"), scalar.numeric(F.col("gdp_growth")).alias("gdp_growth")
    ).filter(F.col("iso3").isNotNull() & _known(F.col("iso3"), known) & (F.col("year") >= _year(start) - 5))
    deviation = windows.rolling_deviation("gdp_growth", 5, 3, 0.01, period="year")
    rows = rows.withColumn("gdp_growth_deviation", deviation)
    rows = rows.withColumn("gdp_negative_shock", scalar.flag(F.col("gdp_growth_deviation") < -1.0))
    monthly = joins.annual_to_monthly(rows.filter(F.col("year") >= _year(start))).drop("year")
    return windows.ffill(monthly, ["gdp_growth", "gdp_growth_deviation", "gdp_negative_shock"]).select(
        "entity", "period", "gdp_growth", "gdp_growth_deviation", "gdp_negative_shock"
    )


def food_prices(
    df: DataFrame, known: Sequence[str] | None = None, m49: DataFrame | None = None, start: str = PANEL_START
) -> DataFrame:
    """(iso3 or m49, year, month, food_cpi) to price anomaly, acceleration and spike features.

    The anomaly already uses the month before; the panel lags it once more.
    """
    if "m49" in df.columns:
        if m49 is None:
            raise ValueError("m49 codes need a crosswalk")
        rows = keys.recode(df, "m49", m49)
    else:
        rows = tables.normalise_columns(df, tables.FOOD_SYNONYMS, required=["iso3", "year", "month", "food_cpi"])
        rows = rows.withColumnRenamed("iso3", "entity")
    rows = keys.coerce_numeric(rows, ["food_cpi"])
    rows = rows.filter(_known(F.col("entity"), known) & F.col("entity").isNotNull() & F.col("food_cpi").isNotNull())
    rows = keys.with_period_from_parts(rows, "year", "month")
    rows = rows.filter(F.substring("period", 1, 4).cast("int") >= _year(start) - 1).select("entity", "period", "food_cpi")
    rows = windows.lag_columns(rows, ["food_cpi"], suffix="_lagged")
    anomaly = F.try_divide(F.col("food_cpi_lagged"), windows.rolling_mean("food_cpi_lagged", 12, 6))
    rows = rows.withColumns({"food_price_anomaly": anomaly, "food_cpi_yoy": windows.pct_change("food_cpi", 12)})
    rows = rows.withColumns(
        {
            "food_cpi_acceleration": windows.diff("food_cpi_yoy"),
            "food_price_anomaly_log": F.log(scalar.clip(F.col("food_price_anomaly"), low=1e-6)),
            "food_price_spike": scalar.flag(F.col("food_price_anomaly") > 1.15),
        }
    )
    return rows.filter(F.col("period") >= start).select(
        "entity", "period", "food_price_anomaly", "food_price_anomaly_log", "food_cpi_acceleration", "food_price_spike"
    )


def coups(df: DataFrame, crosswalk: DataFrame, start: str = PANEL_START, end: str = PANEL_END) -> DataFrame:
    """Coup records (ccode, year, month, coup) to monthly flags and counts."""
    named = tables.normalise_columns(df, tables.COUP_SYNONYMS, required=["gwcode", "coup_code"])
    rows = keys.coerce_numeric(named, ["gwcode", "coup_code"]).filter(F.col("gwcode").isNotNull())
    rows = keys.with_period_from_parts(rows.withColumn("gwcode", F.col("gwcode").cast("int")), "year", "month")
    rows = rows.filter(F.substring("period", 1, 4).cast("int").between(_year(start), _year(end)))
    return agg.coup_months(rows, source="gwcode", crosswalk=crosswalk)


def assemble(
    sources: Mapping[str, DataFrame],
    coup_months: DataFrame | None = None,
    start: str = PANEL_START,
    end: str = PANEL_END,
    lag: int = 1,
    partitions: int | None = None,
) -> DataFrame:
    """All sources on the complete grid, coup history, stale flag, lag, availability.

    The sources are merged by entity in one shuffle; the grid and every window
    after it, including the one by entity and year, reuse that partitioning.
    A source without an upper bound may bring entities all of whose rows lie outside [start, end]; they are
    on the grid as well.
    """
    everything = [*sources.values(), *([coup_months] if coup_months is not None else [])]
    panel = joins.complete_grid(joins.merge_panels(everything, partitions=partitions), start, end, outside=True)
    if coup_months is not None:
        panel = panel.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in COUP_COLUMNS})
        panel = windows.cumulative_events(panel, "pt_coup_event", "pt_cumulative_coups")
        panel = windows.periods_since(panel, F.col("pt_coup_event") == 1, "pt_months_since_coup")
    panel = stale_governance(panel)
    shifted = [c for c in panel.columns if c not in keys.KEYS]
    return features.availability(windows.lag_columns(panel, shifted, lag), AVAILABILITY)


def stale_governance(panel: DataFrame) -> DataFrame:
    """Flag months of a year after its first regime change or coup; annual indices miss those."""
    marks = [c for c in ("regime_change", "pt_coup_event") if c in panel.columns]
    if not marks or "v2x_libdem" not in panel.columns:
        return panel.withColumn("vdem_stale_flag", F.lit(0))
    return windows.stale_flag(panel, windows.structural_break(*marks) == 1, "vdem_stale_flag")
