"""Skeletons, merges and merge reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators import aggregates as agg
from panelloom.operators import joins, windows
from workload import base
from workload.base import (
    ANNUAL, CAGG, CONFLICT_COLUMNS, COUPS, END, INDICES, PANEL, RATE, RETURNS, START, annual, conflict_agg,
    conflict_panel, coup_months, indices, months_cte, query, rate_series, returns_panel, rounded, table,
)

SPARSE = "entity LIKE 'NATION_1%'"


@query(f"WITH {months_cte()} SELECT n_name AS entity, period FROM nation CROSS JOIN months")
def panel_skeleton(spark, sf):
    return joins.skeleton(table(spark, sf, "nation").select(F.col("n_name").alias("entity")), START, END)


@query(f"WITH {PANEL} SELECT * FROM panel", doubles=base.CONFLICT_DOUBLES)
def skeleton_zero_fill(spark, sf):
    return conflict_panel(spark, sf)


@query(
    f"""WITH {PANEL}, {RETURNS}, {RATE.replace(base.EV + ',', '')}
    SELECT p.entity, p.period, p.event_count, r.returned_quantity, r.mean_tone, q.rate FROM panel p
    LEFT JOIN returns r ON r.entity = p.entity AND r.period = p.period
    LEFT JOIN rate q ON q.entity = p.entity AND q.period = p.period""",
    doubles="returned_quantity mean_tone rate",
)
def panel_left_chain(spark, sf):
    skeleton = conflict_panel(spark, sf).select("entity", "period", "event_count")
    sources = [returns_panel(spark, sf).select("entity", "period", "returned_quantity", "mean_tone"), rate_series(spark, sf)]
    return joins.left_chain(skeleton, sources)


def merged_sources(spark, sf):
    """Three panels with different entities and months; two share a column name."""
    c = indices(spark, sf)
    sparse = rate_series(spark, sf).join(c, "period").select("entity", "period", "rate", "index_mean", "index_vol")
    return {"a": conflict_agg(spark, sf), "b": returns_panel(spark, sf), "c": sparse}


MERGE_SOURCES = f"""{CAGG}, {RETURNS}, {RATE.replace(base.EV + ',', '')},
indices AS (SELECT period, avg(price) AS index_mean, stddev_samp(price) AS index_vol
            FROM ship WHERE l_linestatus = 'O' GROUP BY period),
sparse AS (SELECT entity, period, rate, index_mean, index_vol FROM rate JOIN indices USING (period))"""
MERGED = (
    MERGE_SOURCES
    + """,
merged AS (SELECT * FROM cagg FULL JOIN (SELECT * EXCLUDE (peak_event_fatalities) FROM returns) USING (entity, period)
           FULL JOIN sparse USING (entity, period))"""
)


@query(
    f"""WITH {MERGED} SELECT * REPLACE (coalesce(returned_quantity, 0) AS returned_quantity,
    coalesce(returned_value, 0) AS returned_value) FROM merged""",
    doubles=base.CONFLICT_DOUBLES + " returned_quantity returned_value mean_tone rate index_mean index_vol",
)
def panel_outer_merge(spark, sf):
    """Full outer merge; the shared column keeps the left version, one prefix is zero-filled."""
    return joins.zero_fill(merged(spark, sf), ["returned_quantity", "returned_value"])


def merged(spark, sf):
    return joins.merge_panels(list(merged_sources(spark, sf).values()))


def stored_merge(spark, sf):
    """The merged panel as a stored stage, for consumers that read it more than once."""
    return base.stored(spark, merged(spark, sf), "merged")


GLOBALS = (
    MERGED
    + """,
monthly AS (SELECT period, arg_min(index_mean, entity) FILTER (index_mean IS NOT NULL) AS index_mean,
                   arg_min(index_vol, entity) FILTER (index_vol IS NOT NULL) AS index_vol FROM merged GROUP BY period)"""
)


@query(
    f"""WITH {GLOBALS} SELECT m.entity, m.period, m.event_count, m.rate, g.index_mean, g.index_vol FROM merged m
    LEFT JOIN monthly g ON g.period = m.period""",
    doubles="rate index_mean index_vol",
)
def broadcast_globals(spark, sf):
    full = joins.spread_globals(stored_merge(spark, sf), ["index_mean", "index_vol", "not_there"])
    return full.select("entity", "period", "event_count", "rate", "index_mean", "index_vol")


@query(
    f"""WITH {PANEL}, {INDICES}, lagged AS (SELECT period, lag(index_mean) OVER (ORDER BY period) AS index_mean,
       lag(index_vol) OVER (ORDER BY period) AS index_vol FROM indices)
    SELECT p.entity, p.period, p.event_count, l.index_mean, l.index_vol FROM panel p LEFT JOIN lagged l USING (period)""",
    doubles="index_mean index_vol",
)
def global_series_join(spark, sf):
    """Month-level series lagged by a month and attached to every entity."""
    lagged = windows.lag_series(indices(spark, sf), ["index_mean", "index_vol"])
    return joins.attach_monthly(conflict_panel(spark, sf).select("entity", "period", "event_count"), lagged)


@query(
    f"""WITH {PANEL}, {base.SHIP}, tone AS (SELECT s_nationkey AS code, period, round(avg(tone), 6) AS tone_mean
       FROM ship JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
    SELECT p.entity, p.period, p.event_count, t.tone_mean FROM panel p JOIN nation ON n_name = p.entity
    LEFT JOIN tone t ON t.code = CASE WHEN n_regionkey < 3 THEN n_nationkey END AND t.period = p.period"""
)
def crosswalk_join(spark, sf):
    """Panel by nation name joined to tone by nation number; some nations have no number."""
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("entity"))
    tone = agg.by_entity(
        base.shipments(spark, sf), "l_suppkey", [agg.Measure("tone_mean", "mean", F.col("tone"))], supplier, entity="fips"
    )
    nation = table(spark, sf, "nation").filter(F.col("n_regionkey") < 3)
    crosswalk = nation.select(F.col("n_name").alias("entity"), F.col("n_nationkey").alias("code"))
    panel = conflict_panel(spark, sf).select("entity", "period", "event_count")
    return joins.join_through_crosswalk(panel, rounded(tone), crosswalk, "fips")


@query(
    f"""WITH {ANNUAL} SELECT entity, printf('%d-%02d', year, m) AS period, year, growth, open_share FROM annual
    CROSS JOIN (SELECT unnest(generate_series(1, 12)) AS m)""",
    doubles="growth open_share",
)
def annual_to_monthly(spark, sf):
    return joins.annual_to_monthly(annual(spark, sf).select("entity", "year", "growth", "open_share"))


@query(
    f"""WITH {base.RATE_GRID}, {RETURNS} SELECT g.entity, g.period, coalesce(g.rate, r.returned_value) AS rate FROM grid g
    LEFT JOIN returns r ON r.entity = g.entity AND r.period = g.period""",
    doubles="rate",
)
def backfill_join(spark, sf):
    """Gaps of one series filled from another source with unique keys."""
    lookup = returns_panel(spark, sf).select("entity", "period", F.col("returned_value").alias("rate"))
    return joins.backfill(base.rate_grid(spark, sf), lookup, ["rate", "not_there"])


COUP_COLUMNS = ["pt_coup_event", "pt_coup_successful", "pt_coup_failed", "pt_coup_count"]


def coup_panel(spark, sf):
    monthly = coup_months(spark, sf)
    grid = joins.skeleton(table(spark, sf, "nation").select(F.col("n_name").alias("entity")), START, END)
    return joins.integrate_events(
        grid, monthly, "pt_coup_event", COUP_COLUMNS, "pt_cumulative_coups", "pt_months_since_coup"
    )


COUP_PANEL = f"""{COUPS}, {months_cte()},
cj AS (SELECT n_name AS entity, m.period, {', '.join(f'CAST(coalesce(c.{x}, 0) AS INTEGER) AS {x}' for x in COUP_COLUMNS)},
       row_number() OVER (PARTITION BY n_name ORDER BY m.period) AS rn
       FROM nation CROSS JOIN months m LEFT JOIN coups c ON c.entity = n_name AND c.period = m.period),
coup_panel AS (SELECT * EXCLUDE (rn), CAST(sum(pt_coup_event) OVER w AS BIGINT) AS pt_cumulative_coups,
       CAST(rn - max(CASE WHEN pt_coup_event = 1 THEN rn END) OVER w AS DOUBLE) AS pt_months_since_coup
       FROM cj WINDOW w AS (PARTITION BY entity ORDER BY period ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {COUP_PANEL} SELECT * FROM coup_panel")
def coup_integrate(spark, sf):
    return coup_panel(spark, sf)


def overlap_panels(spark, sf):
    parts = merged_sources(spark, sf)
    dated = base.order_events(spark, sf).filter(F.col("o_orderpriority") == "1-URGENT")
    doubled = dated.select(F.col("o_orderstatus").alias("entity"), "period")
    parts["d"] = doubled.unionByName(parts["a"].filter(F.col("entity").like("NATION_1%")).select("entity", "period"))
    return {k: parts[k] for k in ("a", "b", "d")}


@query(
    f"""WITH {MERGE_SOURCES}, d AS (SELECT o_orderstatus AS entity, period FROM ev WHERE o_orderpriority = '1-URGENT'
       UNION ALL SELECT entity, period FROM cagg WHERE {SPARSE}),
    ea AS (SELECT DISTINCT entity FROM cagg), eb AS (SELECT DISTINCT entity FROM returns), ed AS (SELECT DISTINCT entity FROM d)
    SELECT 'shared_a_b' AS metric, count(*) AS n FROM ea JOIN eb USING (entity)
    UNION ALL SELECT 'shared_a_d', count(*) FROM ea JOIN ed USING (entity)
    UNION ALL SELECT 'shared_b_d', count(*) FROM eb JOIN ed USING (entity)
    UNION ALL SELECT 'shared_all', count(*) FROM ea JOIN eb USING (entity) JOIN ed USING (entity)
    UNION ALL SELECT 'only_a', count(*) FROM ea WHERE entity NOT IN (FROM eb) AND entity NOT IN (FROM ed)
    UNION ALL SELECT 'only_b', count(*) FROM eb WHERE entity NOT IN (FROM ea) AND entity NOT IN (FROM ed)
    UNION ALL SELECT 'only_d', count(*) FROM ed WHERE entity NOT IN (FROM ea) AND entity NOT IN (FROM eb)
    UNION ALL SELECT 'duplicates_a', count(*) - count(DISTINCT (entity, period)) FROM cagg
    UNION ALL SELECT 'duplicates_b', count(*) - count(DISTINCT (entity, period)) FROM returns
    UNION ALL SELECT 'duplicates_d', count(*) - count(DISTINCT (entity, period)) FROM d"""
)
def key_overlap_report(spark, sf):
    return joins.key_overlap(overlap_panels(spark, sf))


@query(
    f"""WITH {MERGED}, m AS (SELECT * FROM merged)
    SELECT 'merged_rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM m
    UNION ALL SELECT 'entities', count(DISTINCT entity) FROM m UNION ALL SELECT 'periods', count(DISTINCT period) FROM m
    UNION ALL SELECT 'max_rows', count(DISTINCT entity) * count(DISTINCT period) FROM m
    UNION ALL SELECT 'non_null_a', count(event_count) FROM m UNION ALL SELECT 'non_null_b', count(returned_quantity) FROM m
    UNION ALL SELECT 'non_null_c', count(rate) FROM m
    UNION ALL SELECT 'missing_pct_a', round(100 * ({' + '.join(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END)' for c in CONFLICT_COLUMNS)}) / {len(CONFLICT_COLUMNS)}, 6) FROM m
    UNION ALL SELECT 'missing_pct_b', round(100 * ({' + '.join(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END)' for c in ('returned_quantity', 'returned_value', 'mean_tone', 'peak_event_fatalities'))}) / 4, 6) FROM m
    UNION ALL SELECT 'missing_pct_c', round(100 * ({' + '.join(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END)' for c in ('rate', 'index_mean', 'index_vol'))}) / 3, 6) FROM m
    UNION ALL SELECT 'rows_a', count(*) FROM cagg UNION ALL SELECT 'rows_b', count(*) FROM returns
    UNION ALL SELECT 'rows_c', count(*) FROM sparse
    UNION ALL SELECT 'union_keys', count(*) FROM (SELECT entity, period FROM cagg UNION SELECT entity, period FROM returns UNION SELECT entity, period FROM sparse)"""
)
def merge_validation(spark, sf):
    parts = {n: base.stored(spark, p, f"source-{n}") for n, p in merged_sources(spark, sf).items()}
    return joins.merge_validation(joins.merge_panels(list(parts.values()), unique=False), parts)


@query(
    f"""WITH {RATE} SELECT entity, period, rate, round(avg(rate) OVER w, 6) AS rate_mean,
    round(stddev_samp(rate) OVER w, 6) AS rate_std FROM rate WINDOW w AS (PARTITION BY entity)""",
    doubles="rate",
)
def stats_join_back(spark, sf):
    return windows.entity_stats(rate_series(spark, sf), "rate")

