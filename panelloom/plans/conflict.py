"""Conflict panel: event sources to one lagged (entity, period) panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.operators import aggregates as agg
from panelloom.operators import features, joins, keys, windows

PANEL_START, PANEL_END = "1985-01", "2024-12"

# Names of the output columns and what is done to them.
LOG1P_FEATURES = (
    "ucdp_fatalities_best", "ucdp_fatalities_high", "ucdp_event_count", "ucdp_peak_event_fatalities",
    "ucdp_civilian_deaths", "acled_fatalities", "acled_event_count", "acled_peak_fatalities",
    "acled_battle_count", "acled_explosion_count", "acled_violence_count", "acled_protest_count",
    "acled_riot_count", "acled_airstrike_count", "acled_armed_clash_count",
    "acled_political_violence_count", "acled_demonstration_count", "gdelt_conflict_event_count",
)
TARGET = "ucdp_fatalities_best"
MODEL_DROPS = ("gdelt_protest_event_count",)
MODEL_CHANGES = (
    "ucdp_fatalities_best", "ucdp_event_count", "gdelt_conflict_event_count", "acled_fatalities",
    "acled_event_count", "acled_political_violence_count",
)
NEVER_FILLED = "gdelt_goldstein_mean"
ACTIVITY = "ucdp_has_conflict"


def conflict_months(
    events: DataFrame, names: DataFrame, start: str = PANEL_START, end: str = PANEL_END, small: bool | None = None
) -> DataFrame:
    """Georeferenced conflict events to counts and fatalities of the months with events.

    ``events``: country, date_start, best, high, low, deaths_civilians,
    type_of_violence.  ``names`` maps country names to entities; ``small`` as in ``by_entity``.
    """
    dated = keys.with_period(events, "date_start", start=start, end=end)
    measures = agg.conflict_measures("best", "high", "low", "deaths_civilians", "type_of_violence")
    return agg.by_entity(dated, "country", measures, names, small=small)


def conflict_events(events: DataFrame, names: DataFrame, start: str = PANEL_START, end: str = PANEL_END) -> DataFrame:
    """The same on the complete grid, zero-filled, with a 0/1 activity flag."""
    monthly = conflict_months(events, names, start, end)
    fill = [c for c in monthly.columns if c not in ("entity", "period")]
    return joins.onto_skeleton(monthly, start, end, fill, activity=ACTIVITY)


def protest_months(
    events: DataFrame, names: DataFrame, start: str = PANEL_START, end: str = PANEL_END, small: bool | None = None
) -> DataFrame:
    """Protest and violence events to counts by category of the months with events.

    ``events``: country, event_date, event_type, fatalities (text) and, where
    available, sub_event_type and disorder_type.
    """
    dated = keys.with_period(events, "event_date", start=start, end=end)
    dated = keys.coerce_numeric(dated, ["fatalities"], fill=0.0)
    return agg.by_entity(dated, "country", agg.protest_measures(dated), names, small=small)


def news_months(events: DataFrame, first: DataFrame, second: DataFrame, **options) -> DataFrame:
    """News events to counts and mean score of the months with events; codes reach entities in two hops and may merge."""
    per_code = agg.news_conflict(events, **options)
    counts = ["gdelt_conflict_event_count", "gdelt_protest_event_count"]
    return agg.regroup(keys.recode_chain(per_code, "code", first, second), counts, [NEVER_FILLED])


def merge_sources(
    conflict: DataFrame,
    protest: DataFrame | None = None,
    news: DataFrame | None = None,
    start: str = PANEL_START,
    end: str = PANEL_END,
) -> DataFrame:
    """The sources' months on the complete grid of all their entities.

    Counts of an entity a source does not know are 0, its score and the conflict columns
    stay NULL.  The sources are stacked, folded and gridded behind a single shuffle by
    entity, whose partitioning later windows reuse.
    """
    marked = conflict if ACTIVITY in conflict.columns else conflict.withColumn(ACTIVITY, F.lit(1))
    sources = [marked, *[s for s in (protest, news) if s is not None]]
    grid = joins.complete_grid(joins.merge_panels(sources), start, end)
    known = F.max(ACTIVITY).over(windows.W.partitionBy("entity")).isNotNull()
    grid = grid.withColumn("_known", known)
    own = [c for c in marked.columns if c not in ("entity", "period")]
    rest = [c for c in grid.columns if c not in ("entity", "period", "_known", NEVER_FILLED, *own)]
    filled = {c: F.when(F.col("_known"), F.coalesce(F.col(c), F.lit(0))) for c in own}
    return grid.withColumns(filled | {c: F.coalesce(F.col(c), F.lit(0)) for c in rest}).drop("_known")


def finish(panel: DataFrame, lag: int = 1, target: str = TARGET) -> DataFrame:
    """log1p of heavy-tailed counts, then every feature but the target shifted."""
    logged = features.log1p_clip(panel, LOG1P_FEATURES)
    shifted = [c for c in logged.columns if c not in ("entity", "period", target)]
    return windows.lag_columns(logged, shifted, lag)


def model_features(final: DataFrame) -> DataFrame:
    """Drop overlapping columns, zero-fill all but the score, add log differences."""
    kept = keys.drop_listed(final, MODEL_DROPS)
    changes = [c for c in kept.columns if c.endswith("_ld")]
    filled = joins.zero_fill_except(kept, ["entity", "period", NEVER_FILLED, *changes])
    return windows.log_diff(filled, [c for c in MODEL_CHANGES if c in filled.columns])


def build(
    conflict: DataFrame,
    protest: DataFrame | None = None,
    news: DataFrame | None = None,
    start: str = PANEL_START,
    end: str = PANEL_END,
) -> DataFrame:
    """Monthly aggregates of the sources (or the conflict grid) to the final conflict panel."""
    return finish(merge_sources(conflict, protest, news, start, end))


