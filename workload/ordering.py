"""Sorts, top-k and samples."""

from __future__ import annotations



from panelloom.operators import aggregates as agg
from panelloom.operators import ordering, profile, scoring
from workload.base import CAGG, PANEL, conflict_agg, conflict_panel, query
from workload.merges import MERGED, merged
from workload.scans import PUBLISHED, published


@query(f"WITH {CAGG} SELECT entity, period, event_count FROM cagg ORDER BY entity, period")
def panel_sort(spark, sf):
    return ordering.panel_sort(conflict_agg(spark, sf).select("entity", "period", "event_count"))


TOP = f"""{PANEL},
means AS (SELECT entity, avg(fatalities_best) AS mean FROM panel GROUP BY entity),
top AS (SELECT entity, CAST(row_number() OVER (ORDER BY mean DESC, entity) AS INTEGER) AS position FROM means
        QUALIFY position <= 20)"""


@query(
    f"""WITH {TOP} SELECT position, entity, period, avg(fatalities_best) AS value FROM panel JOIN top USING (entity) GROUP BY ALL""",
    doubles="value",
)
def topk_entities(spark, sf):
    """Month matrix, in long form, of the twenty entities with the highest mean."""
    return ordering.top_entity_matrix(conflict_panel(spark, sf), "fatalities_best", 20)


@query(f"WITH {PUBLISHED} SELECT model, avg(crps) AS crps FROM published GROUP BY model ORDER BY crps, model LIMIT 2", doubles="crps")
def topk_models(spark, sf):
    return scoring.top_models(agg.benchmark_means(published(spark, sf)), 2)


@query(
    f"""WITH {PUBLISHED}, m AS (SELECT model, avg(crps) AS crps, avg(ign) AS ign, avg(mis) AS mis FROM published GROUP BY model)
    SELECT CAST(row_number() OVER (ORDER BY crps, model) AS INTEGER) AS rank, model, crps, ign, mis, model LIKE 'history_1%' AS is_benchmark FROM m""",
    doubles="crps ign mis",
)
def leaderboard_rank(spark, sf):
    return ordering.leaderboard(agg.benchmark_means(published(spark, sf)), "history_1")


MISSING_COLUMNS = ["rate", "index_mean", "returned_value", "event_count", "mean_tone", "one_sided_events"]


@query(
    f"WITH {MERGED}, r AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg(CASE WHEN {c} IS NULL THEN 100.0 ELSE 0 END) AS missing_pct FROM merged" for c in MISSING_COLUMNS
    )
    + ") SELECT feature, missing_pct, missing_pct > 40 AS above_limit FROM r WHERE missing_pct > 0 ORDER BY missing_pct DESC, feature LIMIT 4",
    doubles="missing_pct",
)
def topk_missing(spark, sf):
    return profile.top_missing(merged(spark, sf), MISSING_COLUMNS, 4)


@query(
    f"WITH {PANEL} SELECT entity, period, event_count, fatalities_best FROM panel ORDER BY md5('42|' || entity || '|' || period) LIMIT 500",
    doubles="fatalities_best",
)
def seeded_sample(spark, sf):
    """500 rows in the order of a key digest."""
    return ordering.seeded_sample(conflict_panel(spark, sf), ["entity", "period"], 500).select(
        "entity", "period", "event_count", "fatalities_best"
    )


