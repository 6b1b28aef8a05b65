"""Merged panel: conflict, structural and volatility panels on one key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from panelloom.operators import joins, keys
from panelloom.plans.volatility import TONE_COLUMNS

# Columns with one value per month for all entities, and a column
# that exists for a biased set of entities only.
GLOBAL_COLUMNS = (
    "gpr_global", "gpr_acts", "vix_mean", "vix_vol", "vix_pct_chg", "wti_oil_mean", "wti_oil_vol",
    "wti_oil_pct_chg", "gold_mean", "gold_vol", "gold_pct_chg", "dxy_mean", "dxy_vol", "dxy_pct_chg",
    "us_10y_yield_mean", "us_10y_yield_vol", "us_10y_yield_pct_chg", "wheat_mean", "wheat_vol",
    "wheat_pct_chg", "copper_mean", "copper_vol", "copper_pct_chg", "us_13w_tbill_mean",
    "us_13w_tbill_vol", "us_13w_tbill_pct_chg",
)
PARTIAL_COLUMNS = ("gpr_country",)


def build(
    conflict: DataFrame,
    structural: DataFrame,
    volatility: DataFrame,
    regions: DataFrame | None = None,
    tone: DataFrame | None = None,
    global_columns=GLOBAL_COLUMNS,
    tone_columns=TONE_COLUMNS,
    store: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Outer merge, region, month-level columns for everyone, tone backfill, year and month.

    The month-level values are taken from the merged panel and joined back to
    it, so it is read twice.  ``store`` writes a frame and returns it as read
    from storage; with it the merge runs once.
    """
    panels = [conflict, structural, keys.drop_listed(volatility, PARTIAL_COLUMNS)]
    merged = joins.merge_panels(panels)
    if store is not None:
        merged = store(merged)
    if regions is not None:
        merged = keys.assign_region(merged, regions)
    merged = joins.spread_globals(merged, global_columns)
    if tone is not None:
        merged = joins.backfill(merged, tone, tone_columns)
    return keys.calendar_columns(merged)
