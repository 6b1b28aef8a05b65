"""Aggregations over events and panels, and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators import aggregates as agg
from panelloom.operators import keys, registry, monthsets, sets
from panelloom.operators.aggregates import Measure
from workload import base
from workload.base import (
    CAGG, COUPS, EV, PANEL, PRICES, RETURNS, conflict_agg, conflict_panel, coup_months,
    daily_prices, order_events, query, returns_panel, table,
)
from workload.scans import PUBLISHED, published


@query(f"WITH {CAGG} SELECT * FROM cagg", doubles=base.CONFLICT_DOUBLES)
def event_month_agg(spark, sf):
    return conflict_agg(spark, sf)


LABELS = {"urgent_count": "1-URGENT", "high_count": "2-HIGH", "medium_count": "3-MEDIUM", "unspecified_count": "4-NOT SPECIFIED", "low_count": "5-LOW"}


@query(
    f"""WITH {EV} SELECT entity, period, count(o_orderpriority) AS acled_event_count, round(sum(best), 6) AS acled_fatalities,
    round(max(best), 6) AS acled_peak_fatalities,
    {', '.join(f"count(*) FILTER (o_orderpriority = '{v}') AS acled_{k}" for k, v in LABELS.items())}
    FROM ev GROUP BY entity, period"""
)
def category_counts(spark, sf):
    """Five category counts with sum and peak, in one pass."""
    measures = [
        Measure("acled_event_count", "count", F.col("o_orderpriority")),
        Measure("acled_fatalities", "sum", F.col("best")),
        Measure("acled_peak_fatalities", "max", F.col("best")),
        *agg.label_measures("o_orderpriority", LABELS),
    ]
    return base.by_customer(spark, sf, order_events(spark, sf), measures)


@query(
    f"""WITH {EV} SELECT entity, period, count(*) FILTER (o_orderstatus = 'F') AS acled_airstrike_count,
    count(*) FILTER (o_orderstatus = 'P') AS acled_armed_clash_count FROM ev GROUP BY entity, period"""
)
def subcategory_counts(spark, sf):
    measures = agg.label_measures("o_orderstatus", {"airstrike_count": "F", "armed_clash_count": "P"})
    return base.by_customer(spark, sf, order_events(spark, sf), measures)


@query(
    f"""WITH {EV}, t AS (SELECT *, CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_orderpriority END AS txt FROM ev)
    SELECT entity, period, count(*) FILTER (lower(txt) LIKE '%urgent%') AS acled_political_violence_count,
    count(*) FILTER (lower(txt) LIKE '%i%') AS acled_demonstration_count FROM t GROUP BY entity, period"""
)
def substring_counts(spark, sf):
    """Case-insensitive substring counts; NULL counts as no match."""
    text = F.when(~F.col("o_orderpriority").startswith("5"), F.col("o_orderpriority"))
    events = order_events(spark, sf).withColumn("txt", text)
    measures = agg.text_measures("txt", {"political_violence_count": "Urgent", "demonstration_count": "I"})
    return base.by_customer(spark, sf, events, measures)


def news(spark, sf):
    """Line items as news events: supplier code, yyyymmdd number, root code from the line number."""
    root = F.element_at(F.array(*[F.lit(x) for x in ("14", "18", "19", "20", "03", "04", "05")]), F.col("l_linenumber"))
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("ActionGeo_CountryCode"),
        root.alias("EventRootCode"),
        (F.col("l_discount") * 100 / 7 - F.col("l_tax") * 100 / 11).alias("GoldsteinScale"),
        F.date_format("l_shipdate", "yyyyMMdd").cast("int").alias("SQLDATE"),
        F.year("l_shipdate").alias("Year"),
        (F.col("l_discount") * 100 / 7).alias("AvgTone"),
        F.col("l_quantity").alias("NumArticles"),
    )


NEWS = """
news AS (SELECT CAST(l_suppkey AS VARCHAR) AS code, ['14','18','19','20','03','04','05'][l_linenumber] AS root,
  l_discount * 100 / 7 - l_tax * 100 / 11 AS g, strftime(l_shipdate, '%Y-%m') AS period, year(l_shipdate) AS yr,
  l_discount * 100 / 7 AS tone, l_quantity AS w FROM lineitem)"""
NEWS_AGG = (
    NEWS
    + """,
news_agg AS (SELECT code, period, count(*) FILTER (root IN ('18','19','20')) AS gdelt_conflict_event_count,
  count(*) FILTER (root = '14') AS gdelt_protest_event_count, avg(g) AS gdelt_goldstein_mean
  FROM news WHERE root IN ('14','18','19','20') AND period BETWEEN '1996-01' AND '2001-06' GROUP BY code, period)"""
)


def news_conflict(spark, sf):
    return agg.news_conflict(news(spark, sf), first_day=19960101, last_day=20010630)


@query(f"WITH {NEWS_AGG} SELECT * FROM news_agg", doubles="gdelt_goldstein_mean")
def gdelt_conflict_sql(spark, sf):
    return news_conflict(spark, sf)


@query(
    f"""WITH {NEWS_AGG} SELECT n_name AS entity, period, CAST(sum(gdelt_conflict_event_count) AS BIGINT) AS gdelt_conflict_event_count,
    CAST(sum(gdelt_protest_event_count) AS BIGINT) AS gdelt_protest_event_count,
    round(avg(gdelt_goldstein_mean), 6) AS gdelt_goldstein_mean
    FROM news_agg JOIN supplier ON code = CAST(s_suppkey AS VARCHAR) JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL"""
)
def remap_reagg(spark, sf):
    """Codes that share an entity are merged: sums, and the unweighted mean of means."""
    recoded = keys.recode(news_conflict(spark, sf), "code", base.supplier_entities(spark, sf))
    counts = ["gdelt_conflict_event_count", "gdelt_protest_event_count"]
    merged = agg.regroup(recoded, counts, ["gdelt_goldstein_mean"])
    return base.longs(merged, *counts)


@query(
    f"""WITH {NEWS}, u AS (SELECT * FROM news WHERE yr < 1998 AND root <> '05' UNION ALL SELECT * FROM news WHERE yr >= 1998 AND root <> '14')
    SELECT code, period, round(sum(tone * w) / sum(w), 6) AS tone_mean, round(min(tone), 6) AS tone_min,
    round(max(tone), 6) AS tone_max, round(stddev_samp(tone), 6) AS tone_std, count(*) AS event_count,
    round(sum(w), 6) AS total_articles, count(*) FILTER (g < -5) AS hostile_event_count,
    count(*) FILTER (g > 5) AS cooperative_event_count, round(avg(g), 6) AS goldstein_mean, round(min(g), 6) AS goldstein_min
    FROM u GROUP BY code, period"""
)
def gdelt_tone_sql(spark, sf):
    """Two eras, article-weighted tone, extremes, spread and score counts."""
    rows = news(spark, sf)
    both = agg.union_eras(
        rows.filter(F.col("EventRootCode") != "05"), rows.filter(F.col("EventRootCode") != "14"), "Year", 1998
    )
    dated = keys.with_period_from_yyyymmdd(both, "SQLDATE")
    return agg.tone_by_month(dated, "ActionGeo_CountryCode", "AvgTone", "NumArticles", "GoldsteinScale")


@query(
    f"""WITH {NEWS} SELECT CASE WHEN yr < 1998 THEN 'old' ELSE 'new' END AS era, yr AS "Year", count(*) AS n, round(sum(tone), 6) AS tone
    FROM news WHERE (yr < 1998 AND root <> '05') OR (yr >= 1998 AND root <> '14') GROUP BY ALL"""
)
def union_all_eras(spark, sf):
    rows = news(spark, sf)
    old = rows.filter(F.col("EventRootCode") != "05").withColumn("era", F.lit("old"))
    new = rows.filter(F.col("EventRootCode") != "14").withColumn("era", F.lit("new"))
    both = agg.union_eras(old, new, "Year", 1998)
    return base.longs(
        both.groupBy("era", "Year").agg(F.count(F.lit(1)).alias("n"), F.sum("AvgTone").alias("tone")), "Year"
    )


@query(
    """WITH d AS (SELECT event_type AS code, CAST(ts AS DATE) AS day, avg(value / 7) AS tone FROM events GROUP BY ALL)
    SELECT code, strftime(day, '%Y-%m') AS period, round(avg(tone), 6) AS tone_mean, round(min(tone), 6) AS tone_min,
    round(max(tone), 6) AS tone_max, round(stddev_samp(tone), 6) AS tone_std, count(tone) AS days_with_data FROM d GROUP BY ALL"""
)
def tone_daily_agg(spark, sf):
    daily = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(
        F.avg(F.col("value") / 7).alias("tone")
    )
    return agg.daily_tone(daily, "event_type", "day", "tone")


MONTHLY_SERIES = (
    PRICES
    + """,
pm AS (SELECT series, strftime(date, '%Y-%m') AS period, avg(close) AS mean, stddev_samp(close) AS vol,
              arg_max(close, date) FILTER (close IS NOT NULL) AS close FROM prices GROUP BY ALL),
span AS (SELECT series, min(period) AS lo, max(period) AS hi FROM pm GROUP BY series),
pg AS (SELECT series, strftime(unnest(generate_series(CAST(lo || '-01' AS TIMESTAMP), CAST(hi || '-01' AS TIMESTAMP), INTERVAL 1 MONTH)), '%Y-%m') AS period FROM span),
pf AS (SELECT pg.series, pg.period, mean, vol, close FROM pg LEFT JOIN pm ON pm.series = pg.series AND pm.period = pg.period),
pp AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY series ORDER BY period ROWS UNBOUNDED PRECEDING) AS pad FROM pf),
monthly AS (SELECT series, period, mean, vol, close,
   (pad / lag(pad) OVER (PARTITION BY series ORDER BY period) - 1) * 100 AS pct_chg FROM pp)"""
)


def monthly_series(spark, sf):
    return agg.daily_to_monthly(daily_prices(spark, sf), "series", "date", "close")


@query(f"WITH {MONTHLY_SERIES} SELECT * FROM monthly", doubles="mean vol close pct_chg")
def daily_to_monthly_series(spark, sf):
    return monthly_series(spark, sf)


@query(
    f"""WITH {MONTHLY_SERIES} SELECT period, {', '.join(f"max({m}) FILTER (series = '{s}') AS {s}_{m}" for s in 'ANR' for m in ('mean', 'vol', 'close', 'pct_chg'))}
    FROM monthly GROUP BY period""",
    doubles=" ".join(f"{s}_{m}" for s in "ANR" for m in ("mean", "vol", "close", "pct_chg")),
)
def series_wide(spark, sf):
    return agg.series_to_columns(monthly_series(spark, sf), ["A", "N", "R"])


@query(f"WITH {COUPS} SELECT * FROM coups")
def coup_month_agg(spark, sf):
    return coup_months(spark, sf)


@query(
    f"""WITH {PANEL} SELECT period, round(sum(fatalities_best), 6) AS fatalities_best, round(sum(civilian_deaths), 6) AS civilian_deaths,
    CAST(sum(event_count) AS DOUBLE) AS event_count FROM panel GROUP BY period"""
)
def global_monthly_totals(spark, sf):
    totals = agg.monthly_totals(conflict_panel(spark, sf), ["fatalities_best", "civilian_deaths", "event_count"])
    return totals.withColumn("event_count", F.col("event_count").cast("double"))


@query(f"WITH {PANEL} SELECT period, round(avg(has_conflict), 6) AS prevalence FROM panel GROUP BY period")
def prevalence_by_month(spark, sf):
    return agg.prevalence(conflict_panel(spark, sf), "has_conflict")


@query(
    f"""WITH {CAGG} SELECT count(*) AS n_rows, count(DISTINCT entity) AS n_entities, count(DISTINCT period) AS n_periods,
    min(period) AS first_period, max(period) AS last_period FROM cagg"""
)
def panel_dimensions(spark, sf):
    return agg.dimensions(conflict_agg(spark, sf))


@query(
    f"""WITH {PUBLISHED}, usable AS (SELECT DISTINCT period FROM cagg WHERE civilian_deaths > 0 AND period >= '1998-01')
    SELECT model, round(avg(crps), 6) AS crps, round(avg(ign), 6) AS ign, round(avg(mis), 6) AS mis FROM published
    WHERE period IN (FROM usable) GROUP BY model"""
)
def benchmark_means(spark, sf):
    """Mean scores per model over usable months."""
    busy = conflict_agg(spark, sf).filter((F.col("civilian_deaths") > 0) & (F.col("period") >= "1998-01"))
    return agg.benchmark_means(published(spark, sf), busy.select("period").distinct())


# --- set operations ------------------------------------------------------------


@query(f"WITH {CAGG}, {RETURNS} SELECT entity, period FROM cagg UNION SELECT entity, period FROM returns")
def union_distinct_keys(spark, sf):
    return monthsets.union_keys([conflict_agg(spark, sf), returns_panel(spark, sf)])


@query(
    f"""WITH {CAGG}, {RETURNS}, a AS (SELECT entity, period FROM cagg), b AS (SELECT entity, period FROM returns)
    SELECT 'both' AS side, * FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'only_a', * FROM (FROM a EXCEPT FROM b)
    UNION ALL SELECT 'only_b', * FROM (FROM b EXCEPT FROM a)"""
)
def intersect_except_keys(spark, sf):
    return monthsets.compared_keys(conflict_agg(spark, sf), returns_panel(spark, sf))


@query(
    f"""WITH {PANEL}, {RETURNS} SELECT 'event_count' AS feature_name, 'kept' AS status, round(avg(event_count), 4) AS mean, CAST(NULL AS VARCHAR) AS reason FROM panel
    UNION ALL SELECT 'fatalities_best', 'kept', round(avg(fatalities_best), 4), NULL FROM panel
    UNION ALL SELECT 'returned_value', 'dropped_redundant', NULL, 'redundant' FROM returns HAVING count(*) > 0"""
)
def registry_union(spark, sf):
    """Kept and dropped feature rows in one table; columns one side lacks are NULL."""
    kept = registry.panel_registry(conflict_panel(spark, sf), ["event_count", "fatalities_best"], [], "orders")
    kept = kept.select("feature_name", F.lit("kept").alias("status"), "mean")
    dropped = registry.panel_registry(returns_panel(spark, sf), ["returned_value"], [], "lineitem").select(
        "feature_name", F.lit("dropped_redundant").alias("status"), F.lit("redundant").alias("reason")
    )
    return sets.registry_union(kept, dropped)

