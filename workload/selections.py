"""Period keys, filters, recoding and column selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.functions import scalar
from panelloom.operators import aggregates as agg
from panelloom.operators import keys
from workload import base
from workload.base import EV, PANEL, conflict_panel, customer_entities, order_events, query, rounded, table


@query(
    """SELECT strftime(o_orderdate, '%Y-%m') AS by_date, count(*) AS n,
       strftime(o_orderdate, '%Y-%m') AS by_parts, strftime(o_orderdate, '%Y-%m') AS by_number,
       CAST(NULL AS VARCHAR) AS invalid_text, CAST(NULL AS VARCHAR) AS invalid_number
       FROM orders GROUP BY strftime(o_orderdate, '%Y-%m')"""
)
def period_key(spark, sf):
    """Periods from dates, from year and month, and from yyyymmdd; invalid input gives NULL."""
    d = F.col("o_orderdate")
    o = table(spark, sf, "orders").select(
        scalar.period_of(F.date_format(d, "yyyy-MM-dd")).alias("by_date"),
        scalar.period_of_parts(F.year(d), F.month(d)).alias("by_parts"),
        scalar.period_of_yyyymmdd(F.date_format(d, "yyyyMMdd").cast("int")).alias("by_number"),
        scalar.period_of(F.concat(F.date_format(d, "yyyy"), F.lit("-02-30"))).alias("invalid_text"),
        scalar.period_of_yyyymmdd(F.concat(F.date_format(d, "yyyy"), F.lit("0230")).cast("int")).alias("invalid_number"),
    )
    return o.groupBy(*o.columns).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {EV} SELECT period, count(*) AS n, min(o_orderkey) AS first_key FROM ev
    WHERE period BETWEEN '1996-01' AND '2000-12' GROUP BY period"""
)
def panel_range_filter(spark, sf):
    """Inclusive bounds with twelve months of history before the start."""
    kept = keys.in_range(order_events(spark, sf), "1997-01", "2000-12", lead_months=12)
    return kept.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


@query(
    """SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k,
       CASE WHEN event_type = 'error' THEN 0.0 ELSE round(value, 2) END AS value FROM events"""
)
def numeric_coerce(spark, sf):
    """Text to numbers: unparseable to NULL or to a fill value."""
    e = table(spark, sf, "events").select(
        "event_id",
        F.regexp_extract("props", "([0-9]+)", 1).alias("k"),
        F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string")).alias("value"),
    )
    return rounded(keys.coerce_numeric(keys.coerce_numeric(e, ["k"]), ["value"], fill=0.0), 2)


@query(f"WITH {EV} SELECT o_orderkey, o_custkey, entity FROM ev WHERE c_mktsegment <> 'MACHINERY'")
def code_recode(spark, sf):
    """Customer numbers to nations through a crosswalk that lacks one segment."""
    customer = table(spark, sf, "customer").filter(F.col("c_mktsegment") != "MACHINERY").select(F.col("c_custkey").alias("code"))
    known = customer_entities(spark, sf).join(customer, "code", "left_semi")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return keys.recode_rows(orders, "o_custkey", known, small=base.small(spark, sf, "customer"))


@query(
    """SELECT c_custkey, r_name AS entity FROM customer JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'
       UNION ALL SELECT c_custkey, 'ASIA (override)' FROM customer JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"""
)
def code_recode_chain(spark, sf):
    """Nation number to region number to region name, one name overridden."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    first = nation.select(F.col("n_nationkey").alias("code"), F.col("n_regionkey").alias("entity"))
    name = F.when(F.col("r_name") == "ASIA", "ASIA (override)").otherwise(F.col("r_name"))
    second = region.select(F.col("r_regionkey").alias("code"), name.alias("entity"))
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return keys.recode_chain(customer, "c_nationkey", first, second).select("c_custkey", "entity")


@query(
    """SELECT o_custkey AS code, count(*) AS n_rows FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE c_mktsegment = 'MACHINERY' GROUP BY o_custkey"""
)
def unmapped_report(spark, sf):
    customer = table(spark, sf, "customer").filter(F.col("c_mktsegment") != "MACHINERY")
    known = customer.select(F.col("c_custkey").alias("code"))
    return keys.unmapped_codes(table(spark, sf, "orders"), "o_custkey", known)


@query(
    f"""WITH {PANEL} SELECT p.entity, p.period, CASE WHEN r_name <> 'EUROPE' THEN r_name END AS region FROM panel p
    JOIN nation ON n_name = p.entity JOIN region ON n_regionkey = r_regionkey"""
)
def region_assign(spark, sf):
    """Region of each entity, NULL for entities outside the list."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    regions = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).filter(F.col("r_name") != "EUROPE")
    lookup = regions.select(F.col("n_name").alias("entity"), F.col("r_name").alias("region"))
    return keys.assign_region(conflict_panel(spark, sf).select("entity", "period"), lookup)


@query(
    f"""WITH {PANEL} SELECT entity, period, CAST(period[1:4] AS INTEGER) AS year,
    CAST(period[6:7] AS INTEGER) AS month FROM panel"""
)
def temporal_columns(spark, sf):
    return keys.calendar_columns(conflict_panel(spark, sf).select("entity", "period"))


@query(
    """SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n_events,
       count(*) FILTER (o_orderpriority = '1-URGENT') AS n_urgent, CAST(0 AS BIGINT) AS acled_airstrike_count,
       CAST(0 AS BIGINT) AS acled_armed_clash_count, CAST(0 AS BIGINT) AS acled_political_violence_count,
       CAST(0 AS BIGINT) AS acled_demonstration_count, 0 AS added FROM orders GROUP BY 1"""
)
def optional_columns(spark, sf):
    """Counts over category columns the source lacks are 0; absent columns are added."""
    o = keys.with_period(table(spark, sf, "orders"), "o_orderdate").select(
        "period", F.col("o_orderpriority").alias("event_type"), F.col("o_totalprice").alias("fatalities")
    )
    measures = [m for m in agg.protest_measures(o) if m.name.endswith(("airstrike_count", "clash_count", "political_violence_count", "demonstration_count"))]
    measures += [
        agg.Measure("n_events", "count", F.lit(1)),
        agg.Measure("n_urgent", "count_if", F.col("event_type") == "1-URGENT"),
    ]
    return keys.ensure_columns(agg.aggregate(o, ["period"], measures), {"added": 0, "n_events": 0})


SELECTED = sorted(c for c in base.CONFLICT_COLUMNS if c != "fatalities_best")


@query(f"WITH {PANEL} SELECT entity, period, {', '.join(SELECTED)} FROM panel", doubles="fatalities_high civilian_deaths peak_event_fatalities fatality_uncertainty")
def feature_select(spark, sf):
    """Numeric columns without keys, target and metadata suffixes, sorted."""
    df = conflict_panel(spark, sf).withColumns(
        {"vdem_available": F.lit(1), "vdem_stale_flag": F.lit(0), "x_missing": F.lit(0.0), "region": F.lit("x")}
    )
    names = keys.feature_columns(df, {"entity", "period", "fatalities_best", "has_conflict"})
    return df.select("entity", "period", *names)


@query(f"WITH {PANEL} SELECT * EXCLUDE (peak_event_fatalities, one_sided_events) FROM panel", doubles="fatalities_best fatalities_high civilian_deaths fatality_uncertainty")
def drop_listed(spark, sf):
    return keys.drop_listed(conflict_panel(spark, sf), ["peak_event_fatalities", "one_sided_events", "not_there"])


@query(
    """SELECT o_custkey, last_date, last_key, first_key FROM (
         SELECT o_custkey, strftime(max({'d': o_orderdate, 'k': o_orderkey}).d, '%Y-%m-%d') AS last_date,
                max({'d': o_orderdate, 'k': o_orderkey}).k AS last_key,
                min({'d': o_orderdate, 'k': o_orderkey}).k AS first_key FROM orders GROUP BY o_custkey)"""
)
def dedup_keep(spark, sf):
    """First and last order of each customer."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    last = keys.keep_one(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], keep="last")
    first = keys.keep_one(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return last.join(first.select("o_custkey", F.col("o_orderkey").alias("first_key")), "o_custkey").select(
        "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_date"), F.col("o_orderkey").alias("last_key"), "first_key"
    )


@query(
    f"""WITH {EV}, busy AS (SELECT period FROM ev GROUP BY period HAVING avg(best) > (SELECT avg(best) FROM ev))
    SELECT period, count(*) AS n FROM ev WHERE period IN (SELECT period FROM busy) GROUP BY period"""
)
def isin_filter(spark, sf):
    """Orders of the months whose mean price is above the overall mean."""
    events = order_events(spark, sf)
    overall = events.agg(F.avg("best")).scalar()
    busy = events.groupBy("period").agg(F.avg("best").alias("m")).filter(F.col("m") > overall)
    return keys.keep_periods(events, busy).groupBy("period").agg(F.count(F.lit(1)).alias("n"))

