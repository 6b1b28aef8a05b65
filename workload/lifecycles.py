"""Complete lifecycles: the plans of the package run over the star-schema tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from panelloom.functions import scalar
from panelloom.operators import aggregates as agg
from panelloom.operators import keys, preprocess, windows
from panelloom.plans import conflict, forecast, merged, model_ready, structural, volatility
from panelloom.session import fresh_path
from panelloom.sources import sinks
from workload import base
from workload.base import (
    ANNUAL, CATEGORIES, COUPS, END, RATE, RETURNS, START, annual, coup_months, forecasts, months_cte,
    order_events, query, rate_series, returns_panel, table,
)
from workload.scans import CRPS_SQL, PUBLISHED, published, scored_models
from workload.summaries import NEWS, news

# --- conflict panel -----------------------------------------------------------


def _names(spark, sf):
    """Crosswalk of event 'country names' (customer names) to nations."""
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    joined = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    return joined.select(F.col("c_name").alias("code"), F.col("n_name").alias("entity"))


def _customer_name():
    return F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))


def conflict_final(spark, sf):
    e = order_events(spark, sf)
    ged = e.select(
        _customer_name().alias("country"), F.col("o_orderdate").alias("date_start"), "best", "high", "low",
        F.col("civilian").alias("deaths_civilians"), F.col("kind").alias("type_of_violence"),
    )
    labels = F.create_map(*[F.lit(x) for pair in zip(
        ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), agg.EVENT_LABELS.values()
    ) for x in pair])
    urgent = F.col("o_orderstatus") != "O"
    acled = e.filter(urgent).select(
        _customer_name().alias("country"), F.col("o_orderdate").alias("event_date"),
        F.element_at(labels, F.col("o_orderpriority")).alias("event_type"), F.col("best").cast("string").alias("fatalities"),
        F.when(F.col("o_orderstatus") == "F", "Armed clash").alias("sub_event_type"),
        F.when(F.col("o_orderstatus") == "P", "Political Violence; Demonstrations").alias("disorder_type"),
    )
    supplier = table(spark, sf, "supplier")
    first = supplier.select(F.col("s_suppkey").cast("string").alias("code"), F.col("s_nationkey").cast("string").alias("entity"))
    second = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("entity"))
    names = _names(spark, sf)
    return conflict.build(
        conflict.conflict_months(ged, names, START, END, small=base.small(spark, sf, "customer")),
        conflict.protest_months(acled, names, START, END, small=base.small(spark, sf, "customer")),
        conflict.news_months(news(spark, sf), first, second, first_day=19950101, last_day=20010831),
        START,
        END,
    )


_PRIORITIES = dict(zip(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), agg.EVENT_LABELS))
_UCDP = [f"ucdp_{c}" for c in base.CONFLICT_COLUMNS]
_ACLED = ["event_count", "fatalities", "peak_fatalities", *_PRIORITIES.values(), "airstrike_count", "armed_clash_count", "political_violence_count", "demonstration_count"]
_COLUMNS = [*_UCDP, "ucdp_has_conflict", *[f"acled_{c}" for c in _ACLED], "gdelt_conflict_event_count", "gdelt_protest_event_count", "gdelt_goldstein_mean"]


def _final(column: str) -> str:
    value = f"ln(1 + greatest({column}, 0))" if column in conflict.LOG1P_FEATURES else column
    return f"{value} AS {column}" if column == conflict.TARGET else f"lag({value}) OVER (PARTITION BY entity ORDER BY period) AS {column}"


FINAL = f"""{base.CAGG}, {months_cte()}, {NEWS},
acled AS (SELECT entity, period, count(*) AS event_count, sum(best) AS fatalities, max(best) AS peak_fatalities,
  {', '.join(f"count(*) FILTER (o_orderpriority = '{p}') AS {c}" for p, c in _PRIORITIES.items())},
  0 AS airstrike_count, count(*) FILTER (o_orderstatus = 'F') AS armed_clash_count,
  count(*) FILTER (o_orderstatus = 'P') AS political_violence_count, count(*) FILTER (o_orderstatus = 'P') AS demonstration_count
  FROM ev WHERE o_orderstatus <> 'O' GROUP BY entity, period),
per_code AS (SELECT code, period, count(*) FILTER (root IN ('18','19','20')) AS c, count(*) FILTER (root = '14') AS p, avg(g) AS g
  FROM news WHERE root IN ('14','18','19','20') AND period <= '{END}' GROUP BY code, period),
gdelt AS (SELECT n_name AS entity, period, sum(c) AS c, sum(p) AS p, avg(g) AS g FROM per_code
  JOIN supplier ON code = CAST(s_suppkey AS VARCHAR) JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL),
ents AS (SELECT DISTINCT entity FROM cagg UNION SELECT DISTINCT entity FROM acled UNION SELECT DISTINCT entity FROM gdelt),
full_panel AS (SELECT e.entity, m.period,
  {', '.join(f'CASE WHEN e.entity IN (SELECT entity FROM cagg) THEN coalesce(u.{c}, 0) END AS ucdp_{c}' for c in base.CONFLICT_COLUMNS)},
  CASE WHEN e.entity IN (SELECT entity FROM cagg) THEN CASE WHEN u.entity IS NULL THEN 0 ELSE 1 END END AS ucdp_has_conflict,
  {', '.join(f'coalesce(a.{c}, 0) AS acled_{c}' for c in _ACLED)},
  coalesce(g.c, 0) AS gdelt_conflict_event_count, coalesce(g.p, 0) AS gdelt_protest_event_count, g.g AS gdelt_goldstein_mean
  FROM ents e CROSS JOIN months m LEFT JOIN cagg u ON u.entity = e.entity AND u.period = m.period
  LEFT JOIN acled a ON a.entity = e.entity AND a.period = m.period LEFT JOIN gdelt g ON g.entity = e.entity AND g.period = m.period),
final AS (SELECT entity, period, {', '.join(_final(c) for c in _COLUMNS)} FROM full_panel)"""
FINAL_SQL = f"WITH {FINAL} SELECT entity, period, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _COLUMNS)} FROM final"


@query(FINAL_SQL, doubles=" ".join(_COLUMNS))
def conflict_lifecycle(spark, sf):
    """Three event sources to one grid, merged, on the log scale, lagged."""
    final = conflict_final(spark, sf)
    return final.select("entity", "period", *[F.col(c).cast("double").alias(c) for c in _COLUMNS])


_MODEL = [c for c in _COLUMNS if c != "gdelt_protest_event_count"]
_FILLED = {c: c if c == conflict.NEVER_FILLED else f"coalesce({c}, 0)" for c in _MODEL}


@query(
    f"""WITH {FINAL}, filled AS (SELECT entity, period, {', '.join(f'CAST({v} AS DOUBLE) AS {c}' for c, v in _FILLED.items())} FROM final)
    SELECT *, {', '.join(f'{c} - lag({c}) OVER (PARTITION BY entity ORDER BY period) AS {c}_ld' for c in conflict.MODEL_CHANGES)} FROM filled""",
    doubles=" ".join([*_MODEL, *[f"{c}_ld" for c in conflict.MODEL_CHANGES]]),
)
def conflict_model_features(spark, sf):
    """Overlapping column out, zero-fill, log differences."""
    out = conflict.model_features(conflict_final(spark, sf))
    names = [*_MODEL, *[f"{c}_ld" for c in conflict.MODEL_CHANGES]]
    return out.select("entity", "period", *[F.col(c).cast("double").alias(c) for c in names])


# --- structural panel ------------------------------------------------------------


def structural_final(spark, sf):
    a = annual(spark, sf)
    regime = F.least(F.floor(F.col("open_share") * 4), F.lit(3)).cast("int")
    vdem = a.select(
        F.concat(F.lower("entity"), F.lit(" ")).alias("country_text_id"), "year", F.col("open_share").alias("v2x_libdem"),
        F.col("done_share").alias("v2x_polyarchy"), F.col("urgent_share").alias("v2x_rule"), F.col("done_share").alias("v2x_corr"),
        F.col("urgent_share").alias("v2x_execorr"), F.col("open_share").alias("v2x_clphy"), regime.alias("v2x_regime"),
    )
    fx = rate_series(spark, sf).select(
        F.col("entity").alias("iso3"), F.substring("period", 1, 4).cast("int").alias("year"),
        F.substring("period", 6, 2).cast("int").alias("month"), F.col("rate").alias("exchange_rate"),
    )
    food = returns_panel(spark, sf).select(
        F.col("entity").alias("iso3"), F.substring("period", 1, 4).cast("int").alias("year"),
        F.substring("period", 6, 2).cast("int").alias("month"), F.col("returned_quantity").alias("food_cpi"),
    )
    gdp = a.select(F.col("entity").alias("iso3"), "year", F.col("growth").alias("gdp_growth"))
    # Entities known to one source only, and after the end of the range.
    gdp = gdp.unionByName(gdp.select(F.concat(F.lit("LATE "), "iso3").alias("iso3"), (F.col("year") + 20).alias("year"), "gdp_growth"))
    sources = {
        "vdem": structural.governance(vdem, start=START, end=END),
        "fx": structural.exchange_rates(fx, start=START, end=END),
        "gdp": structural.growth(gdp, start=START, end=END),
        "food": structural.food_prices(food, start=START),
    }
    return structural.assemble(sources, coup_months(spark, sf), START, END)


_OVER = "(PARTITION BY entity ORDER BY period)"
_S_COLUMNS = [
    "v2x_libdem", "v2x_regime", "regime_type_0", "regime_type_1", "regime_type_2", "regime_type_3", "governance_deficit",
    "repression_index", "libdem_yoy_change", "fx_pct_change", "fx_volatility", "fx_volatility_log", "fx_depreciation_flag",
    "fx_pct_change_zscore", "gdp_growth", "gdp_growth_deviation", "gdp_negative_shock", "food_price_anomaly",
    "food_price_anomaly_log", "food_cpi_acceleration", "food_price_spike", "pt_coup_event", "pt_coup_successful",
    "pt_coup_failed", "pt_coup_count", "pt_cumulative_coups", "pt_months_since_coup", "vdem_stale_flag",
]
_FLAGS = {"vdem_available": "v2x_libdem", "fx_available": "fx_volatility", "food_available": "food_price_anomaly", "gdp_available": "gdp_growth"}
_FF3 = "last_value({c} IGNORE NULLS) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS {c}"
STRUCTURAL = f"""{ANNUAL}, {RATE.replace(base.EV + ',', '')}, {RETURNS}, {COUPS.replace(base.EV + ',', '')}, {months_cte()},
gov0 AS (SELECT entity, printf('%d-%02d', year, m) AS period, open_share AS v2x_libdem, CAST(least(floor(open_share * 4), 3) AS INTEGER) AS v2x_regime,
  1 - (open_share + done_share + urgent_share) / 3 AS governance_deficit, ((done_share + urgent_share) / 2 + 1 - open_share) / 2 AS repression_index
  FROM annual CROSS JOIN (SELECT unnest(generate_series(1, 12)) AS m)),
gov AS (SELECT *, {', '.join(f'CASE WHEN v2x_regime = {v} THEN 1 ELSE 0 END AS regime_type_{v}' for v in range(4))},
  v2x_libdem - lag(v2x_libdem, 12) OVER {_OVER} AS libdem_yoy_change FROM gov0),
fx0 AS (SELECT entity, period, rate / lag(rate) OVER {_OVER} - 1 AS fx_pct_change FROM rate),
fx1 AS (SELECT *, CASE WHEN count(fx_pct_change) OVER r3 >= 2 THEN stddev_samp(fx_pct_change) OVER r3 END AS fx_volatility,
  CASE WHEN stddev_samp(fx_pct_change) OVER e > 0 AND fx_pct_change > avg(fx_pct_change) OVER e + 2 * stddev_samp(fx_pct_change) OVER e THEN 1 ELSE 0 END AS fx_depreciation_flag,
  CASE WHEN count(fx_pct_change) OVER x >= 6 THEN (fx_pct_change - avg(fx_pct_change) OVER x) / greatest(stddev_samp(fx_pct_change) OVER x, 1e-8) END AS fx_pct_change_zscore
  FROM fx0 WINDOW r3 AS (PARTITION BY entity ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), e AS (PARTITION BY entity),
  x AS (PARTITION BY entity ORDER BY period ROWS UNBOUNDED PRECEDING)),
fx2 AS (SELECT *, ln(1 + fx_volatility) AS fx_volatility_log FROM fx1),
fx AS (SELECT entity, period, fx_depreciation_flag, {', '.join(_FF3.replace('{c}', c) for c in ('fx_pct_change', 'fx_volatility', 'fx_volatility_log', 'fx_pct_change_zscore'))} FROM fx2),
gdp0 AS (SELECT entity, year, growth, CASE WHEN count(growth) OVER w >= 3 THEN (growth - avg(growth) OVER w) / greatest(stddev_samp(growth) OVER w, 0.01) END AS dev
  FROM annual WINDOW w AS (PARTITION BY entity ORDER BY year ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
gdp AS (SELECT entity, printf('%d-%02d', year, m) AS period, growth AS gdp_growth, last_value(dev IGNORE NULLS) OVER (PARTITION BY entity ORDER BY year, m ROWS UNBOUNDED PRECEDING) AS gdp_growth_deviation,
  CASE WHEN dev < -1 THEN 1 ELSE 0 END AS gdp_negative_shock FROM gdp0 CROSS JOIN (SELECT unnest(generate_series(1, 12)) AS m)),
food0 AS (SELECT entity, period, returned_quantity AS v, lag(returned_quantity) OVER {_OVER} AS l, returned_quantity / lag(returned_quantity, 12) OVER {_OVER} - 1 AS yoy FROM returns),
food1 AS (SELECT *, CASE WHEN count(l) OVER w >= 6 THEN l / avg(l) OVER w END AS an, yoy - lag(yoy) OVER {_OVER} AS acc
  FROM food0 WINDOW w AS (PARTITION BY entity ORDER BY period ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
food AS (SELECT entity, period, an AS food_price_anomaly, CASE WHEN an IS NOT NULL THEN ln(greatest(an, 1e-6)) END AS food_price_anomaly_log,
  acc AS food_cpi_acceleration, CASE WHEN an > 1.15 THEN 1 ELSE 0 END AS food_price_spike FROM food1),
sents AS (SELECT entity FROM annual UNION SELECT 'LATE ' || entity FROM annual UNION SELECT entity FROM rate UNION SELECT entity FROM returns UNION SELECT entity FROM coups),
sj AS (SELECT e.entity, m.period, gov.* EXCLUDE (entity, period), fx.* EXCLUDE (entity, period), gdp.* EXCLUDE (entity, period), food.* EXCLUDE (entity, period),
  {', '.join(f'coalesce(k.{c}, 0) AS {c}' for c in structural.COUP_COLUMNS)}, row_number() OVER (PARTITION BY e.entity ORDER BY m.period) AS rn
  FROM sents e CROSS JOIN months m LEFT JOIN gov ON gov.entity = e.entity AND gov.period = m.period LEFT JOIN fx ON fx.entity = e.entity AND fx.period = m.period
  LEFT JOIN gdp ON gdp.entity = e.entity AND gdp.period = m.period LEFT JOIN food ON food.entity = e.entity AND food.period = m.period
  LEFT JOIN coups k ON k.entity = e.entity AND k.period = m.period),
sk AS (SELECT *, sum(pt_coup_event) OVER w AS pt_cumulative_coups, rn - max(CASE WHEN pt_coup_event = 1 THEN rn END) OVER w AS pt_months_since_coup,
  CASE WHEN period > min(CASE WHEN pt_coup_event = 1 THEN period END) OVER (PARTITION BY entity, period[1:4]) THEN 1 ELSE 0 END AS vdem_stale_flag
  FROM sj WINDOW w AS (PARTITION BY entity ORDER BY period ROWS UNBOUNDED PRECEDING)),
sl AS (SELECT entity, period, {', '.join(f'CAST(lag({c}) OVER {_OVER} AS DOUBLE) AS {c}' for c in _S_COLUMNS)} FROM sk),
structural AS (SELECT *, {', '.join(f'CASE WHEN {c} IS NULL THEN 0 ELSE 1 END AS {f}' for f, c in _FLAGS.items())}, 0 AS reign_available FROM sl)"""


@query(f"WITH {STRUCTURAL} SELECT * FROM structural", doubles=" ".join(_S_COLUMNS))
def structural_lifecycle(spark, sf):
    """Five sources on one skeleton with coup history, stale flag, lag and availability."""
    out = structural_final(spark, sf)
    return out.select("entity", "period", *[F.col(c).cast("double").alias(c) for c in _S_COLUMNS], *_FLAGS, "reign_available")


LEADERS = f"""{CATEGORIES}, r AS (SELECT *, lag(event_date, 3) OVER {_OVER} AS lastelection FROM cat),
c AS (SELECT *, CASE WHEN government IS NULL THEN NULL WHEN row_number() OVER {_OVER} = 1 THEN 0.0
  WHEN lag(government) OVER {_OVER} IS DISTINCT FROM government THEN 1.0 ELSE 0.0 END AS regime_change FROM r),
b AS (SELECT *, CASE WHEN regime_change = 1 OR irregular = 1 THEN 1 END AS brk, row_number() OVER {_OVER} AS rn FROM c)"""


@query(
    f"""WITH {LEADERS} SELECT n_nationkey + 100 AS code, b.period, age, CAST(CASE WHEN age IS NULL THEN NULL WHEN age < 40 OR age > 75 THEN 1 ELSE 0 END AS DOUBLE) AS leader_age_risk,
    CASE WHEN CAST(b.period || '-01' AS DATE) >= lastelection THEN (CAST(b.period || '-01' AS DATE) - lastelection) / 30.44 END AS months_since_election,
    CAST(regime_change AS DOUBLE) AS regime_change, CAST(irregular AS DOUBLE) AS coup_event,
    CAST(rn - max(CASE WHEN brk = 1 THEN rn END) OVER (PARTITION BY b.entity ORDER BY b.period ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS months_since_structural_break,
    {', '.join(f"CASE WHEN government = '{v}' THEN 1 ELSE 0 END AS n_{i}" for i, v in enumerate(('1-URGENT', '5-LOW')))}
    FROM b JOIN nation ON n_name = b.entity""",
    doubles="age months_since_election",
)
def leader_lifecycle(spark, sf):
    """Leader-month records by number code to change, break and regime features."""


    nation = table(spark, sf, "nation").select(F.col("n_name").alias("entity"), (F.col("n_nationkey") + 100).alias("ccode"))
    cat = windows.lag_columns(base.categories(spark, sf), ["event_date"], 3).join(nation, "entity")
    raw = cat.select(
        "ccode", F.substring("period", 1, 4).cast("int").alias("year"), F.substring("period", 6, 2).cast("int").alias("month"),
        "government", "age", "irregular", F.col("event_date").cast("string").alias("lastelection"),
    )
    crosswalk = nation.select(F.col("ccode").alias("code"), F.col("ccode").alias("entity"))
    out = structural.leaders(raw, crosswalk, start=START, cutoff=END)
    return out.select(
        F.col("entity").alias("code"), "period", "age", "leader_age_risk", "months_since_election", "regime_change", "coup_event",
        "months_since_structural_break", F.col("`reign_regime_1-URGENT`").alias("n_0"), F.col("`reign_regime_5-LOW`").alias("n_1"),
    )


# --- volatility panel ---------------------------------------------------------------


def volatility_final(spark, sf):
    risk = rate_series(spark, sf).select("entity", "period", F.col("rate").alias("gpr_country"))
    risk_global = base.indices(spark, sf).select(
        "period", F.col("index_mean").alias("gpr_global"), (F.col("index_mean") * 2).alias("gpr_threats"), F.col("index_vol").alias("gpr_acts")
    )
    n = news(spark, sf).withColumnRenamed("ActionGeo_CountryCode", "_supplier")
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("code"), F.col("s_nationkey").cast("string").alias("entity"))


    coded = keys.recode_rows(n, "_supplier", supplier, "ActionGeo_CountryCode", small=base.small(spark, sf, "supplier"))
    tone = volatility.tone_months(coded, coded, 1998)
    nation = table(spark, sf, "nation").select(F.col("n_name").alias("entity"), F.col("n_nationkey").cast("string").alias("code"))
    names = F.create_map(F.lit("A"), F.lit("vix"), F.lit("N"), F.lit("gold"), F.lit("R"), F.lit("brent_oil"))
    market = volatility.market_months(base.daily_prices(spark, sf).withColumn("series", F.element_at(names, F.col("series"))))
    return volatility.align(risk, risk_global, tone, nation, market, START, END)


_V_COLUMNS = ["gpr_country", "gpr_global", "gpr_acts", "tone_mean", "tone_std", "event_count", "goldstein_mean", "vix_mean", "vix_vol", "vix_pct_chg", "gold_mean", "gold_pct_chg"]


def _volatility_sql() -> str:
    from workload.summaries import MONTHLY_SERIES

    market = ", ".join(f"max({m}) FILTER (series = '{s}') AS {n}_{m}" for s, n in (("A", "vix"), ("N", "gold")) for m in ("mean", "vol", "pct_chg"))
    return f"""WITH {RATE}, {MONTHLY_SERIES}, {NEWS},
    ix AS (SELECT period, lag(m) OVER (ORDER BY period) AS gpr_global, lag(v) OVER (ORDER BY period) AS gpr_acts FROM
      (SELECT period, avg(price) AS m, stddev_samp(price) AS v FROM ship WHERE l_linestatus = 'O' AND period <= '{END}' GROUP BY period)),
    mk0 AS (SELECT period, {market} FROM monthly WHERE period <= '{END}' GROUP BY period),
    mk AS (SELECT period, {', '.join(f'lag({c}) OVER (ORDER BY period) AS {c}' for c in _V_COLUMNS[7:])} FROM mk0),
    tn0 AS (SELECT n_name AS entity, period, sum(tone * w) / sum(w) AS tone_mean, stddev_samp(tone) AS tone_std, count(*) AS event_count, avg(g) AS goldstein_mean
      FROM news JOIN supplier ON code = CAST(s_suppkey AS VARCHAR) JOIN nation ON n_nationkey = s_nationkey WHERE period <= '{END}' GROUP BY n_name, period),
    tn AS (SELECT entity, period, {', '.join(f'lag({c}) OVER {_OVER} AS {c}' for c in _V_COLUMNS[3:7])} FROM tn0),
    rk AS (SELECT entity, period, lag(rate) OVER {_OVER} AS gpr_country FROM rate)
    SELECT rk.entity, rk.period, ln(1 + gpr_country) AS gpr_country, ln(1 + gpr_global) AS gpr_global, ln(1 + gpr_acts) AS gpr_acts, tone_mean,
    ln(1 + tone_std) AS tone_std, ln(1 + event_count) AS event_count, goldstein_mean, {', '.join(_V_COLUMNS[7:])}
    FROM rk LEFT JOIN ix ON ix.period = rk.period LEFT JOIN tn ON tn.entity = rk.entity AND tn.period = rk.period LEFT JOIN mk ON mk.period = rk.period
    WHERE gpr_country IS NOT NULL"""


@query(_volatility_sql(), doubles=" ".join(_V_COLUMNS))
def volatility_lifecycle(spark, sf):
    """Risk, tone and market series lagged, aligned and on the log scale; redundant columns gone."""
    return volatility_final(spark, sf).select("entity", "period", *_V_COLUMNS)


# --- merged and model-ready -------------------------------------------------------------

M_COLUMNS = ["ucdp_fatalities_best", "ucdp_event_count", "returned_value", "mean_tone", "rate", "index_mean", "index_vol"]


def merged_final(spark, sf):
    """Conflict grid (log1p target), returns panel and a sparse third panel with month-level columns."""
    a = base.conflict_panel(spark, sf).select(
        "entity", "period", scalar.log1p_clipped(F.col("fatalities_best")).alias("ucdp_fatalities_best"),
        F.col("event_count").alias("ucdp_event_count"),
    )
    c = rate_series(spark, sf).join(base.indices(spark, sf), "period").withColumn("gpr_country", F.lit(1.0))
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    regions = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("n_name").alias("entity"), F.col("r_name").alias("region")
    )
    # Read twice, as a panel and as the tone of the backfill.
    b = base.stored(spark, returns_panel(spark, sf).select("entity", "period", "returned_value", "mean_tone"), "returns")
    tone = agg.aggregate(
        b.withColumn("rate", F.col("returned_value") / 10), ["entity", "period"], [agg.Measure("rate", "mean", F.col("rate"))]
    )
    return merged.build(
        a, b, c, regions, tone, ["index_mean", "index_vol"], ["rate"], store=lambda df: base.stored(spark, df, "merged")
    )


MERGED_FINAL = f"""{base.PANEL}, {RETURNS}, {RATE.replace(base.EV + ',', '')},
ix AS (SELECT period, avg(price) AS index_mean, stddev_samp(price) AS index_vol FROM ship WHERE l_linestatus = 'O' GROUP BY period),
ixr AS (SELECT DISTINCT ix.* FROM ix JOIN rate USING (period)),
mf0 AS (SELECT * FROM (SELECT entity, period, ln(1 + fatalities_best) AS ucdp_fatalities_best, event_count AS ucdp_event_count FROM panel)
  FULL JOIN (SELECT entity, period, returned_value, mean_tone FROM returns) USING (entity, period)
  FULL JOIN (SELECT entity, period, rate FROM rate JOIN ix USING (period)) USING (entity, period)),
mf AS (SELECT m.entity, m.period, ucdp_fatalities_best, ucdp_event_count, m.returned_value, mean_tone, coalesce(rate, m.returned_value / 10) AS rate, index_mean, index_vol, r_name AS region,
  CAST(m.period[1:4] AS INTEGER) AS year, CAST(m.period[6:7] AS INTEGER) AS month FROM mf0 m LEFT JOIN ixr ON ixr.period = m.period
  LEFT JOIN nation ON n_name = m.entity LEFT JOIN region ON n_regionkey = r_regionkey)"""


@query(f"WITH {MERGED_FINAL} SELECT * FROM mf", doubles=" ".join(c for c in M_COLUMNS if c != "ucdp_event_count"))
def merged_lifecycle(spark, sf):
    """Outer merge, region, month-level columns for everyone, backfill, calendar columns."""
    return merged_final(spark, sf).select("entity", "period", *M_COLUMNS, "region", "year", "month")


TRAIN_END = "1999-12"
SPIKE_FATALITIES = 2500
_AR = [
    "target_lag1", "target_lag2", "target_lag3", "target_diff1",
    *[f"target_roll{w}_{s}" for w in (3, 6, 12) for s in ("mean", "median", "std", "max", "zscore")],
    "target_months_since_spike",
]
_READY = sorted([*_AR, "ucdp_event_count", "returned_value", "mean_tone", "rate", "index_mean", "index_vol"])


def _rolling(w: int) -> str:
    over = f"(PARTITION BY entity ORDER BY period ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    y = "ucdp_fatalities_best"
    return (
        f"avg({y}) OVER {over} AS target_roll{w}_mean, quantile_cont({y}, 0.5) OVER {over} AS target_roll{w}_median, "
        f"stddev_samp({y}) OVER {over} AS target_roll{w}_std, max({y}) OVER {over} AS target_roll{w}_max"
    )


_LAG = "lag(ucdp_fatalities_best, {n}) OVER " + _OVER
_LOGGED_READY = {c: c for c in _READY}
AR_SQL = f"""ar0 AS (SELECT *, {', '.join(f'{_LAG.replace("{n}", str(n))} AS target_lag{n}' for n in (1, 2, 3))},
  {', '.join(_rolling(w) for w in (3, 6, 12))}, row_number() OVER {_OVER} AS rn FROM mf),
ar AS (SELECT *, target_lag1 - target_lag2 AS target_diff1, {', '.join(f'CASE WHEN target_roll{w}_std <> 0 THEN (target_lag1 - target_roll{w}_mean) / target_roll{w}_std END AS target_roll{w}_zscore' for w in (3, 6, 12))},
  CAST(rn - max(CASE WHEN target_lag1 > {math.log1p(SPIKE_FATALITIES)!r} THEN rn END) OVER (PARTITION BY entity ORDER BY period ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS target_months_since_spike FROM ar0),
rs AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in _READY)} FROM ar WHERE period <= '{TRAIN_END}'),
ready AS (SELECT entity, period, {', '.join(f'CASE WHEN {c} IS NULL THEN 0.0 ELSE greatest(-10, least(10, ({c} - m_{c}) / s_{c})) END AS {c}' for c in _READY)}, ucdp_fatalities_best FROM ar, rs)"""


@query(f"WITH {MERGED_FINAL}, {AR_SQL} SELECT * FROM ready", doubles=" ".join([*_READY, "ucdp_fatalities_best"]))
def model_ready_lifecycle(spark, sf):
    """Merged panel, autoregressive features, preprocessing.  The stage after the windows is stored, as it is read twice."""
    history = model_ready.autoregressive(merged_final(spark, sf), spike=SPIKE_FATALITIES)
    stored = sinks.run_stage(spark, fresh_path(spark, "history"), lambda: history)
    done = preprocess.preprocess_panel(
        stored, conflict.TARGET, TRAIN_END, exclude=model_ready.NOT_FEATURES, already_log1p=_READY, redundant=model_ready.REDUNDANT
    )
    return done.panel


# --- forecast evaluation -----------------------------------------------------------------


@query(
    f"""WITH {PUBLISHED}, win AS (SELECT * FROM fc12 WHERE period BETWEEN '1998-07' AND '1999-06'),
    own AS (SELECT period, avg({CRPS_SQL}) AS own FROM win GROUP BY period HAVING max(y) > 0),
    m AS (SELECT own.period, own, max(p.crps) FILTER (p.model = 'history_6') AS history_6, max(p.crps) FILTER (p.model = 'history_24') AS history_24
          FROM own LEFT JOIN published p ON p.period = own.period GROUP BY own.period, own)
    SELECT * FROM m UNION ALL SELECT 'AVG', avg(own), avg(history_6), avg(history_24) FROM m""",
    doubles="own history_6 history_24",
)
def forecast_lifecycle(spark, sf):
    """Evaluation in a window of months: own scores per month next to reference models."""
    scored = base.stored(spark, scored_models(spark, sf), "scored")
    report = forecast.evaluate(
        base.stored(spark, forecasts(spark, sf), "forecasts"), published(spark, sf, scored), start="1998-07", end="1999-06", references=["history_6", "history_24"],
        threshold=base.SPIKE,
    )
    return report.per_month


