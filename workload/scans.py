"""Readers, reshaping readers and sinks.

Files are written from the given tables into the shared folder first, so the
work grows with the tables.
"""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from panelloom.operators import profile, scoring
from panelloom.session import fresh_path, stored
from panelloom.sources import sinks, tables, wide
from workload import base
from workload.base import (
    ANNUAL, END, PANEL, RATE, RETURNS, START, annual, conflict_panel, query, rate_series,
    returns_panel, rounded, table,
)


def _months(start: str = START, end: str = END) -> list[str]:
    (y0, m0), (y1, m1) = (map(int, p.split("-")) for p in (start, end))
    return [f"{n // 12:04d}-{n % 12 + 1:02d}" for n in range(y0 * 12 + m0 - 1, y1 * 12 + m1)]


@query("SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer")
def scan_csv(spark, sf):
    """Tab-separated latin-1 text with padded strings, read with a schema and four of five columns."""
    path = fresh_path(spark, "customer-tsv")
    padded = table(spark, sf, "customer").withColumn("c_mktsegment", F.concat("c_mktsegment", F.lit("  ")))
    padded.write.csv(path, header=True, sep="\t", encoding="ISO-8859-1", ignoreTrailingWhiteSpace=False)
    schema = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
    df = tables.read_delimited(
        spark, path, schema, sep="\t", encoding="ISO-8859-1", columns=["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]
    )
    return rounded(df, 2)


@query("SELECT o_orderkey, o_custkey, o_orderpriority, round(o_totalprice, 2) AS o_totalprice FROM orders")
def scan_glob_dedup(spark, sf):
    """Two overlapping files read by pattern; orders present in both come out once."""
    path = fresh_path(spark, "orders-csv")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    late = orders.filter(F.col("o_orderpriority") >= "3")
    orders.filter(F.col("o_orderpriority") <= "3-MEDIUM").write.csv(f"{path}/part=a", header=True)
    late.write.csv(f"{path}/part=b", header=True)
    schema = "o_orderkey BIGINT, o_custkey BIGINT, o_orderpriority STRING, o_totalprice DOUBLE"
    df = tables.scan_union(spark, f"{path}/part=*", "o_orderkey", schema)
    return rounded(df.select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"), 2)


@query(f"WITH {ANNUAL} SELECT entity AS iso3, year, growth AS gdp_growth FROM annual", doubles="gdp_growth")
def normalise_columns(spark, sf):
    """Column names in another spelling come back as canonical ones."""
    raw = annual(spark, sf).select(
        F.col("entity").alias(" CountryCode"), F.col("year").alias("DATE"), F.col("growth").alias("NY.GDP.MKTP.KD.ZG")
    )
    return tables.normalise_columns(raw, tables.GDP_SYNONYMS, required=["iso3", "gdp_growth"])


def _fx_wide(spark, sf):
    """Exchange-rate file: three series per nation, months as columns."""
    series = rate_series(spark, sf)
    months = _months()
    wide_rates = series.groupBy("entity").pivot("period", months).agg(F.first("rate"))
    cells = [F.col(f"`{m}`").cast("string").alias(f"{m[:4]}-M{m[5:]}") for m in months]
    kinds = F.explode(
        F.array(*[
            F.struct(F.lit(code).alias("code"), F.lit(indicator).alias("indicator"), F.lit(kind).alias("kind"))
            for code, indicator, kind in (
                (".B_RATE", "Domestic currency per US Dollar", "Period average"),
                (".C_RATE", "Domestic currency per US Dollar", "Period average"),
                (".A_RATE", "Domestic currency per US Dollar", "End of period"),
                (".A_SDR", "Domestic currency per SDR", "Period average"),
            )
        ])
    )
    rows = wide_rates.select("*", kinds.alias("k"))
    return rows.select(
        F.concat(F.lower("entity"), F.col("k.code")).alias("SERIES_CODE"),
        F.col("k.indicator").alias("INDICATOR"),
        F.lit("Monthly").alias("FREQUENCY"),
        F.col("k.kind").alias("TYPE_OF_TRANSFORMATION"),
        *cells,
    )


@query(
    f"""WITH {RATE}, {base.months_cte()}
    SELECT e.entity AS iso3, CAST(m.period[1:4] AS INTEGER) AS year, CAST(m.period[6:7] AS INTEGER) AS month,
           r.rate AS exchange_rate
    FROM (SELECT DISTINCT entity FROM rate) e CROSS JOIN months m
    LEFT JOIN rate r ON r.entity = e.entity AND r.period = m.period""",
    doubles="exchange_rate",
)
def wide_periods_to_long(spark, sf):
    return wide.fx_wide_to_long(_fx_wide(spark, sf))


@query(
    f"""WITH {RATE} SELECT entity AS iso3, CAST(period[1:4] AS INTEGER) AS year,
    CAST(period[6:7] AS INTEGER) AS month, rate AS exchange_rate FROM rate""",
    doubles="exchange_rate",
)
def sdmx_to_long(spark, sf):
    raw = rate_series(spark, sf).select(
        F.concat(F.lower("entity"), F.lit(" ")).alias("REF_AREA"),
        F.col("period").alias("TIME_PERIOD"),
        F.col("rate").cast("string").alias("OBS_VALUE"),
    )
    return wide.fx_sdmx_to_long(raw)


def _price_index(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_name").alias("entity"), F.col("n_nationkey").alias("key"))
    return returns_panel(spark, sf).select("entity", "period", F.col("mean_tone").alias("cpi")).join(nation, "entity")


YEARS = list(range(1995, 2002))
INDEX = RETURNS + """,
idx AS (SELECT n_nationkey AS key, period, mean_tone AS cpi FROM returns JOIN nation ON n_name = entity)"""


@query(
    f"""WITH {INDEX}
    SELECT k.key AS m49, k.month, y.year, i.cpi AS food_cpi
    FROM (SELECT DISTINCT key, CAST(period[6:7] AS INTEGER) AS month FROM idx) k
    CROSS JOIN (SELECT CAST(unnest(generate_series(1995, 2001)) AS INTEGER) AS year) y
    LEFT JOIN idx i ON i.key = k.key AND i.period = printf('%d-%02d', y.year, k.month)""",
    doubles="food_cpi",
)
def faostat_wide_to_long(spark, sf):
    """Bulk layout: a row per area and month code, years as columns, two items."""
    base_rows = _price_index(spark, sf).withColumn("y", F.substring("period", 1, 4).cast("int"))
    cells = base_rows.groupBy("key", (F.substring("period", 6, 2).cast("int") + 7000).alias("Months Code"))
    cells = cells.pivot("y", YEARS).agg(F.first("cpi"))
    raw = cells.select(
        F.concat(F.lit("'"), F.lpad(F.col("key").cast("string"), 3, "0")).alias("Area Code (M49)"),
        F.explode(F.array(F.lit(23013), F.lit(23012))).alias("Item Code"),
        "`Months Code`",
        *[F.col(f"`{y}`").cast("string").alias(f"Y{y}") for y in YEARS],
    )
    return wide.fao_wide_to_long(raw)


@query(
    f"""WITH {INDEX} SELECT key, CAST(period[1:4] AS INTEGER) AS year, CAST(period[6:7] AS INTEGER) AS month,
    cpi AS food_cpi FROM idx""",
    doubles="food_cpi",
)
def faostat_long_months(spark, sf):
    """Month names and month codes in one column."""
    month = F.substring("period", 6, 2).cast("int")
    names = F.element_at(F.array(*[F.lit(m.title()) for m in wide.MONTH_NAMES]), month)
    code = (month + 7000).cast("string")
    raw = _price_index(spark, sf).select(
        "key",
        F.substring("period", 1, 4).cast("int").alias("year"),
        F.when(F.col("key") < 12, names).otherwise(code).alias("Months"),
        F.col("cpi").cast("string").alias("Value"),
    )
    return wide.fao_long_months(raw)


@query(
    f"""WITH {ANNUAL} SELECT 'N' || printf('%02d', n_nationkey) AS iso3, year, growth AS gdp_growth
    FROM annual JOIN nation ON n_name = entity""",
    doubles="gdp_growth",
)
def wb_wide_to_long(spark, sf):
    """Years as columns; aggregates with longer codes are left out."""
    nation = table(spark, sf, "nation").select(F.col("n_name").alias("entity"), F.col("n_nationkey").alias("key"))
    rows = annual(spark, sf).join(nation, "entity").groupBy("key").pivot("year", YEARS).agg(F.first("growth"))
    code = F.concat(F.lit("N"), F.lpad(F.col("key").cast("string"), 2, "0"))
    codes = F.explode(F.array(code, F.concat(code, F.lit("X"))))
    raw = rows.select(codes.alias("Country Code"), *[F.col(f"`{y}`").cast("string").alias(str(y)) for y in YEARS])
    return wide.years_wide_to_long(raw)


@query(
    f"""WITH {RATE}, firsts AS (SELECT period FROM rate WHERE entity = 'NATION_0')
    SELECT n_name AS entity, f.period, r.rate AS gpr_country FROM firsts f CROSS JOIN nation
    LEFT JOIN rate r ON r.entity = n_name AND r.period = f.period""",
    doubles="gpr_country",
)
def gpr_wide_to_long(spark, sf):
    """Months with a value in the first entity column, entity columns to rows."""
    entities = [f"NATION_{i}" for i in range(25)]
    rows = rate_series(spark, sf).groupBy("period").pivot("entity", entities).agg(F.first("rate"))
    raw = rows.select(
        F.to_date(F.concat("period", F.lit("-01"))).alias("month"),
        *[F.col(e).alias(f"GPRC_{e}") for e in entities],
    )
    return wide.risk_by_entity(raw)


def model_forecasts(spark, sf):
    """Three historical forecasts: one panel, stored, read with three window lengths."""
    panel = base.stored(spark, conflict_panel(spark, sf).select("entity", "period", "fatalities_best"), "panel")
    return scoring.union_models({f"history_{n}": scoring.history_forecast(panel, "fatalities_best", n) for n in (6, 12, 24)})


def model_scores(scored):
    """Monthly mean scores in the layout of the published file."""
    monthly = scored.groupBy("model", "period").agg(
        F.avg("crps").alias("crps"), F.avg("ign").alias("ign"), F.avg("is_90").alias("mis")
    )
    first = F.to_date(F.lit("1995-01-01"))
    number = F.months_between(F.to_date(F.concat("period", F.lit("-01"))), first).cast("int") + tables.FIRST_MONTH_ID
    return monthly.select(
        number.alias("Month ID"), F.col("period").alias("Date"), F.col("model").alias("Model"),
        F.col("crps").alias("CRPS"), F.col("ign").alias("ab-Log Score"), F.col("mis").alias("MIS"),
    )


def scored_models(spark, sf):
    return scoring.score_rows(model_forecasts(spark, sf))


def published(spark, sf, scored=None):
    """Published scores of the three models, from scored rows where they exist already."""
    scored = scored_models(spark, sf) if scored is None else scored
    return tables.month_ids_to_periods(model_scores(scored), first_month=START, last_id=None)


CRPS_SQL = """(list_sum(list_transform(samples, lambda v: abs(v - y))) / len(samples)
  - list_sum(list_transform(list_sort(samples), lambda v, i: (2 * (i - 1) - len(samples)) * v)) / (len(samples) * len(samples)))"""
MEAN_SQL = "(list_sum(samples) / len(samples))"
DEV_SQL = f"list_sum(list_transform(samples, lambda v: (v - {MEAN_SQL}) * (v - {MEAN_SQL})))"


def quantile_sql(q: str) -> str:
    return f"list_aggregate(samples, 'quantile_cont', {q})"


def interval_sql(alpha: float) -> str:
    lo, hi = quantile_sql(str(alpha / 2)), quantile_sql(str(1 - alpha / 2))
    return f"({hi} - {lo} + {2 / alpha} * greatest({lo} - y, 0) + {2 / alpha} * greatest(y - {hi}, 0))"


IGN_SQL = f"""CASE WHEN sqrt({DEV_SQL} / len(samples)) < 1e-10
  THEN CASE WHEN abs(y - {MEAN_SQL}) < 1e-6 THEN 0.0 ELSE 50.0 END
  ELSE -ln(greatest(list_sum(list_transform(samples, lambda v:
     exp(-0.5 * pow((y - v) / (pow(len(samples) * 0.75, -0.2) * sqrt({DEV_SQL} / (len(samples) - 1))), 2))))
     / (len(samples) * pow(len(samples) * 0.75, -0.2) * sqrt({DEV_SQL} / (len(samples) - 1)) * sqrt(2 * pi())), 1e-10)) END"""
PIT_SQL = "(len(list_filter(samples, lambda v: v <= y)) / len(samples))"

SCORED = f"""
scored AS (SELECT model, entity, period, y, {CRPS_SQL} AS crps, {IGN_SQL} AS ign, {interval_sql(0.1)} AS is_90,
  {interval_sql(0.5)} AS is_50, {PIT_SQL} AS pit, {quantile_sql('0.9')} AS upper, {MEAN_SQL} AS predicted,
  len(samples) AS n_draws FROM models)"""
MODELS = (
    PANEL
    + "".join("," + base.forecast_cte(f"fc{n}", n) for n in (6, 12, 24))
    + ", models AS ("
    + " UNION ALL ".join(f"SELECT 'history_{n}' AS model, * FROM fc{n}" for n in (6, 12, 24))
    + "), "
    + SCORED
)
PUBLISHED = (
    MODELS
    + """,
published AS (SELECT period, model, avg(crps) AS crps, avg(ign) AS ign, avg(is_90) AS mis
  FROM scored GROUP BY period, model)"""
)


@query(f"WITH {PUBLISHED} SELECT * FROM published", doubles="crps ign mis")
def scan_scores(spark, sf):
    """Score file with month numbers, written and read back with periods."""
    path = fresh_path(spark, "scores")
    model_scores(scored_models(spark, sf)).write.csv(path, header=True)
    return tables.read_scores(spark, path, first_month=START, last_id=None)


@query(f"WITH {PANEL} SELECT entity, period, event_count, fatalities_best FROM panel WHERE period >= '1998-01'", doubles="fatalities_best")
def sink_stage(spark, sf):
    """A stage published year by year: one run reaches part of the years, the next adds the others, a last one only reads."""
    path, inputs = fresh_path(spark, "stage"), [f"{sf}/{name}.parquet" for name in ("orders", "customer", "nation")]
    # All years come from the same months: the events are aggregated once, when the first year is built.
    months = functools.cache(lambda: stored(spark, base.conflict_agg(spark, sf), "conflict-months"))
    for start, end in (("1998-01", "1999-12"), ("1998-01", END), ("1998-01", END)):
        df = sinks.run_yearly_stage(spark, path, lambda year: conflict_panel(spark, sf, months()), start, end, {"grid": START}, inputs)
    return df.select("entity", "period", "event_count", "fatalities_best")


@query(
    f"""WITH {base.RATE_GRID}
    SELECT 'rate' AS feature, round(avg(CASE WHEN rate IS NULL THEN 100.0 ELSE 0 END), 6) AS missing_pct,
           avg(CASE WHEN rate IS NULL THEN 100.0 ELSE 0 END) > 40 AS above_limit FROM grid"""
)
def sink_report_json(spark, sf):
    path = fresh_path(spark, "report")
    report = profile.missing_by_column(base.rate_grid(spark, sf), ["rate"])
    sinks.write_report_json(rounded(report), path)
    return spark.read.schema("feature STRING, missing_pct DOUBLE, above_limit BOOLEAN").json(path)

