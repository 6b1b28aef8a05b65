"""Row-local transforms, encodings and the presence matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.functions import scalar
from panelloom.operators import features, joins, profile, windows
from workload import base
from workload.base import (
    ANNUAL, CATEGORIES, END, PANEL, RATE, START, annual, categories, conflict_panel, query, rate_series,
    table,
)
from workload.history import TARGET, target
from workload.merges import MERGED, merged


@query(
    f"WITH {PANEL} SELECT entity, period, {', '.join(f'ln(1 + greatest({c} - 5, 0)) AS {c}' for c in base.LOGGED)} FROM panel",
    doubles=" ".join(base.LOGGED),
)
def log1p_clip(spark, sf):
    """log1p of values clipped at 0 (shifted so that some are negative)."""
    shifted = conflict_panel(spark, sf).select("entity", "period", *[(F.col(c) - 5).alias(c) for c in base.LOGGED])
    return features.log1p_clip(shifted, [*base.LOGGED, "not_there"])


@query(f"WITH {TARGET} SELECT entity, period, exp(y) - 1 AS y FROM target", doubles="y")
def expm1_target(spark, sf):
    return features.expm1_target(target(spark, sf), "y")


GAPS = """
g AS (SELECT entity, year, CASE WHEN year % 3 = 0 THEN NULL ELSE open_share END AS libdem, done_share AS polyarchy,
             CASE WHEN year % 2 = 0 THEN NULL ELSE urgent_share END AS rule FROM annual)"""


@query(
    f"""WITH {ANNUAL}, {GAPS} SELECT entity, year, 1 - list_avg([libdem, polyarchy, rule]) AS governance_deficit,
    (list_avg([libdem, polyarchy]) + (1 - rule)) / 2 AS repression_index FROM g""",
    doubles="governance_deficit repression_index",
)
def rowwise_mean_composite(spark, sf):
    """Row means that skip missing indices, and the composites built on them."""
    g = annual(spark, sf).select(
        "entity", "year", F.when(F.col("year") % 3 != 0, F.col("open_share")).alias("libdem"),
        F.col("done_share").alias("polyarchy"), F.when(F.col("year") % 2 != 0, F.col("urgent_share")).alias("rule"),
    )
    return g.select(
        "entity", "year", features.governance_deficit("libdem", "polyarchy", "rule").alias("governance_deficit"),
        features.repression_index(["libdem", "polyarchy"], "rule").alias("repression_index"),
    )


@query(
    f"""WITH {CATEGORIES} SELECT entity, period, {', '.join(f"CASE WHEN irregular = {v} THEN 1 ELSE 0 END AS regime_type_{v}" for v in range(4))} FROM cat"""
)
def one_hot_fixed(spark, sf):
    """Closed category with two values that never occur."""
    df = features.one_hot_fixed(categories(spark, sf), "irregular", range(4), "regime_type")
    return df.select("entity", "period", *[f"regime_type_{v}" for v in range(4)])


LABELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "SELECT o_orderkey, "
    + ", ".join(f"""CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END AS "reign_regime_{v}" """ for v in LABELS)
    + " FROM orders"
)
def one_hot_open(spark, sf):
    """One column per label found in the data."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return features.one_hot_open(orders, "o_orderpriority", "reign_regime").drop("o_orderpriority")


@query(
    f"""WITH {CATEGORIES} SELECT entity, period, CAST(CASE WHEN age IS NULL THEN NULL WHEN age < 40 OR age > 75 THEN 1 ELSE 0 END AS DOUBLE) AS leader_age_risk FROM cat"""
)
def band_flag(spark, sf):
    return features.age_risk(categories(spark, sf), "age", "leader_age_risk").select("entity", "period", "leader_age_risk")


@query(
    f"""WITH {CATEGORIES}, l AS (SELECT entity, period, event_date, CAST(period || '-01' AS DATE) AS d FROM cat)
    SELECT entity, period, CASE WHEN d >= event_date THEN (d - event_date) / 30.44 END AS months FROM
    (SELECT entity, period, d, lag(event_date, 2) OVER (PARTITION BY entity ORDER BY period) AS event_date FROM l WHERE period <= '1998-06'
     UNION ALL SELECT entity, period, d, event_date FROM l WHERE period > '1998-06')""",
    doubles="months",
)
def months_between_3044(spark, sf):
    """Months since an earlier date in the first half; dates inside the month are in the future."""


    df = windows.lag_columns(categories(spark, sf).select("entity", "period", "event_date"), ["event_date"], 2, suffix="_2")
    date = F.when(F.col("period") <= "1998-06", F.col("event_date_2")).otherwise(F.col("event_date"))
    text = df.withColumn("d", date.cast("string"))
    return features.months_since_date(text, "d", "months").select("entity", "period", "months")


@query(
    f"""WITH {MERGED} SELECT entity, period, CASE WHEN event_count IS NULL THEN 0 ELSE 1 END AS orders_available,
    CASE WHEN returned_value IS NULL THEN 0 ELSE 1 END AS returns_available, CASE WHEN rate IS NULL THEN 0 ELSE 1 END AS fx_available,
    0 AS gdp_available FROM merged"""
)
def availability_flags(spark, sf):
    markers = {
        "orders_available": "event_count", "returns_available": "returned_value", "fx_available": "rate",
        "gdp_available": "gdp_growth",
    }
    return features.availability(merged(spark, sf), markers).select("entity", "period", *markers)


@query(
    f"""WITH {MERGED} SELECT entity, period, coalesce(event_count, 0) AS event_count, coalesce(returned_value, 0) AS returned_value,
    coalesce(rate, 0) AS rate, mean_tone FROM merged""",
    doubles="returned_value rate mean_tone",
)
def zero_fill_except(spark, sf):
    df = merged(spark, sf).select("entity", "period", "event_count", "returned_value", "rate", "mean_tone")
    return joins.zero_fill_except(df, ["entity", "period", "mean_tone"])


@query(
    """SELECT s_suppkey, upper(trim(' ' || s_name || ' ')) AS cleaned, printf('%03d', s_nationkey) AS code,
    substr(s_name, 1, 8) AS head, regexp_matches(s_name, '^Supplier#[0-9]+$') AS is_code, replace(s_name, 'Supplier#', '') AS bare,
    s_name LIKE '%9%' AS has_nine FROM supplier"""
)
def string_clean(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(
        "s_suppkey",
        scalar.clean_code(F.concat(F.lit(" "), F.col("s_name"), F.lit("' "))).alias("cleaned"),
        scalar.clean_code(F.concat(F.lit("'"), F.col("s_nationkey").cast("string")), width=3).alias("code"),
        F.substring("s_name", 1, 8).alias("head"),
        F.col("s_name").rlike(r"^Supplier#[0-9]+$").alias("is_code"),
        F.regexp_replace("s_name", "^Supplier#", "").alias("bare"),
        F.col("s_name").contains("9").alias("has_nine"),
    )


@query(
    f"""WITH {RATE}, {base.months_cte()} SELECT e.entity, m.period, CASE WHEN r.rate IS NULL THEN 0 ELSE 1 END AS present
    FROM (SELECT DISTINCT entity FROM rate) e CROSS JOIN months m LEFT JOIN rate r ON r.entity = e.entity AND r.period = m.period"""
)
def presence_matrix(spark, sf):
    return profile.presence(rate_series(spark, sf), "rate", START, END)


