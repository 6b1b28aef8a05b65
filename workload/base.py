"""Registry of queries and the derived tables they share.

The driver tables play the roles of a panel study: orders are events, a nation
is an entity reached through the customer, a month is a period; returned line
items give a second source and shipments a daily price series.  Every frame is
lazy and covers its whole tables.  Each Spark frame has its SQL twin as a CTE.

Money is divided by a prime so that no mean lands on a rounding tie; results are
rounded on both sides.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.operators import aggregates as agg
from panelloom.operators import joins, keys, scoring
from panelloom.operators.aggregates import Measure
from panelloom.session import stored  # noqa: F401

START, END = "1995-01", "2001-08"
SHIP_END = "2001-11"
MODULES = (
    "scans", "selections", "merges", "summaries", "history", "ordering", "reshaping", "profiling",
    "modelready", "evaluation", "predictive", "lifecycles",
)


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    module: str


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register a function under its own name, with the SQL that must agree with it.

    Double columns are rounded on both sides; ``doubles`` names them for SQL.
    """
    if sql and doubles:
        replace = ", ".join(f'round("{c}", {digits}) + 0.0 AS "{c}"' for c in doubles.split())
        sql = f"SELECT * REPLACE ({replace}) FROM ({sql})"

    def register(fn):
        if fn.__name__ in REGISTRY:
            raise ValueError(f"query {fn.__name__} is registered twice")
        REGISTRY[fn.__name__] = Query(lambda spark, sf: rounded(fn(spark, sf), digits), sql, fn.__module__.split(".")[-1])
        return fn

    return register


def load_all() -> dict[str, Query]:
    for name in MODULES:
        importlib.import_module(f"workload.{name}")
    return REGISTRY


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table; its schema is read from the file once, not by a job per query."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def rounded(df: DataFrame, digits: int = 6, **overrides: int) -> DataFrame:
    """Every double column rounded."""
    out = {
        f.name: F.round(f.name, overrides.get(f.name, digits)) + F.lit(0.0)
        for f in df.schema.fields
        if f.dataType.simpleString() == "double"
    }
    return df.withColumns(out) if out else df


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


_SMALL: dict[tuple[str, str], bool] = {}


def small(spark: SparkSession, sf: str, name: str) -> bool:
    """Whether a code table may be broadcast; its size is checked once per directory."""
    if (sf, name) not in _SMALL:
        _SMALL[sf, name] = keys.is_small(table(spark, sf, name))
    return _SMALL[sf, name]


def by_customer(spark: SparkSession, sf: str, events: DataFrame, measures: list[Measure]) -> DataFrame:
    """Events keyed by customer, aggregated to nation and month."""
    return agg.by_entity(events, "o_custkey", measures, customer_entities(spark, sf), small=small(spark, sf, "customer"))


def by_supplier(spark: SparkSession, sf: str, events: DataFrame, measures: list[Measure]) -> DataFrame:
    return agg.by_entity(events, "l_suppkey", measures, supplier_entities(spark, sf), small=small(spark, sf, "supplier"))


# --- events: orders -------------------------------------------------------

PRICE = 997.0


def customer_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Crosswalk customer -> nation name."""
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    joined = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    return joined.select(F.lit("customer").alias("code_system"), F.col("c_custkey").alias("code"), F.col("n_name").alias("entity"))


def order_events(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with conflict-event columns, still keyed by customer."""
    o = table(spark, sf, "orders")
    best = F.col("o_totalprice") / PRICE
    kind = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    dated = keys.with_period(o, "o_orderdate")
    return dated.select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "period",
        best.alias("best"), (best * 1.1).alias("high"), (best * 0.95).alias("low"),
        F.when(F.col("o_orderpriority") == "1-URGENT", best).otherwise(0.0).alias("civilian"),
        kind.alias("kind"),
    )


EV = f"""
ev AS (SELECT n_name AS entity, strftime(o_orderdate, '%Y-%m') AS period, o_orderkey, o_custkey, o_orderdate,
              o_orderpriority, o_orderstatus, c_mktsegment, c_nationkey,
              o_totalprice / {PRICE} AS best, o_totalprice / {PRICE} * 1.1 AS high,
              o_totalprice / {PRICE} * 0.95 AS low,
              CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice / {PRICE} ELSE 0 END AS civilian,
              CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS kind
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

CONFLICT_COLUMNS = [
    "event_count", "fatalities_best", "fatalities_high", "civilian_deaths", "peak_event_fatalities",
    "fatality_uncertainty", "state_based_events", "non_state_events", "one_sided_events",
]


def conflict_agg(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per nation and month; the customer join sees pre-aggregated rows."""
    measures = agg.conflict_measures("best", "high", "low", "civilian", "kind", prefix="")
    return by_customer(spark, sf, order_events(spark, sf), measures)


CAGG = (
    EV
    + """,
cagg AS (SELECT entity, period, count(*) AS event_count, sum(best) AS fatalities_best,
                sum(high) AS fatalities_high, sum(civilian) AS civilian_deaths,
                max(best) AS peak_event_fatalities,
                avg(greatest(high - low, 0)) AS fatality_uncertainty,
                count(*) FILTER (kind = 1) AS state_based_events, count(*) FILTER (kind = 2) AS non_state_events,
                count(*) FILTER (kind = 3) AS one_sided_events
         FROM ev GROUP BY entity, period)"""
)


def months_cte(name: str = "months", start: str = START, end: str = END) -> str:
    return f"""
{name} AS (SELECT strftime(x, '%Y-%m') AS period FROM (SELECT unnest(generate_series(
    TIMESTAMP '{start}-01', TIMESTAMP '{end}-01', INTERVAL 1 MONTH)) AS x))"""


def conflict_panel(spark: SparkSession, sf: str, months: DataFrame | None = None) -> DataFrame:
    """Complete nation x month grid, zero-filled, with a 0/1 activity flag; from ``months``, a stored ``conflict_agg``, if given."""
    return joins.onto_skeleton(conflict_agg(spark, sf) if months is None else months, START, END, CONFLICT_COLUMNS, activity="has_conflict")


PANEL = (
    CAGG
    + ","
    + months_cte()
    + """,
panel AS (SELECT e.entity, m.period, """
    + ", ".join(f"coalesce(c.{c}, 0) AS {c}" for c in CONFLICT_COLUMNS)
    + """, CASE WHEN c.entity IS NULL THEN 0 ELSE 1 END AS has_conflict
  FROM (SELECT DISTINCT entity FROM cagg) e CROSS JOIN months m
  LEFT JOIN cagg c ON c.entity = e.entity AND c.period = m.period)"""
)

CONFLICT_DOUBLES = "fatalities_best fatalities_high civilian_deaths peak_event_fatalities fatality_uncertainty"
LOGGED = [c for c in CONFLICT_COLUMNS if c not in ("fatality_uncertainty", "state_based_events", "non_state_events", "one_sided_events")]

# --- a gappy series: urgent fulfilled orders -------------------------------


def rate_series(spark: SparkSession, sf: str) -> DataFrame:
    """Mean price of urgent fulfilled orders per nation and month; months without any are absent."""
    urgent = order_events(spark, sf).filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"))
    return by_customer(spark, sf, urgent, [Measure("rate", "mean", F.col("best"))])


RATE = (
    EV
    + """,
rate AS (SELECT entity, period, avg(best) AS rate FROM ev
         WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY entity, period)"""
)


def rate_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The same on the complete grid, so that gaps are NULL cells."""
    return joins.complete_grid(rate_series(spark, sf), START, END)


RATE_GRID = (
    RATE
    + ","
    + months_cte()
    + """,
grid AS (SELECT e.entity, m.period, r.rate FROM (SELECT DISTINCT entity FROM rate) e CROSS JOIN months m
         LEFT JOIN rate r ON r.entity = e.entity AND r.period = m.period)"""
)

# --- second source: returned line items by supplier nation -------------------


def supplier_entities(spark: SparkSession, sf: str) -> DataFrame:
    supplier, nation = table(spark, sf, "supplier"), table(spark, sf, "nation")
    joined = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
    return joined.select(F.lit("supplier").alias("code_system"), F.col("s_suppkey").alias("code"), F.col("n_name").alias("entity"))


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with a tone (discount against tax), a weight and the ship month."""
    items = keys.with_period(table(spark, sf, "lineitem"), "l_shipdate")
    return items.select(
        "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag", "l_linestatus", "period", "l_linenumber",
        (F.col("l_discount") * 100 / 7 - F.col("l_tax") * 100 / 11).alias("tone"),
        (F.col("l_extendedprice") / PRICE).alias("price"),
    )


SHIP = f"""
ship AS (SELECT l_suppkey, l_shipdate, l_quantity, l_returnflag, l_linestatus, l_linenumber,
                strftime(l_shipdate, '%Y-%m') AS period,
                l_discount * 100 / 7 - l_tax * 100 / 11 AS tone, l_extendedprice / {PRICE} AS price FROM lineitem)"""


def returns_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Returned items per supplier nation and ship month; shares no month range or completeness with orders."""
    returned = shipments(spark, sf).filter(F.col("l_returnflag") == "R")
    measures = [
        Measure("returned_quantity", "sum", F.col("l_quantity")),
        Measure("returned_value", "sum", F.col("price")),
        Measure("mean_tone", "mean", F.col("tone")),
        Measure("peak_event_fatalities", "max", F.col("price")),
    ]
    return by_supplier(spark, sf, returned, measures)


RETURNS = (
    SHIP
    + """,
returns AS (SELECT n_name AS entity, period, sum(l_quantity) AS returned_quantity,
                   sum(price) AS returned_value, avg(tone) AS mean_tone,
                   max(price) AS peak_event_fatalities
            FROM ship JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
            WHERE l_returnflag = 'R' GROUP BY n_name, period)"""
)

# --- third source: month-level indices stored on some entities only ----------


def indices(spark: SparkSession, sf: str) -> DataFrame:
    """Month-level means of open shipments."""
    open_items = shipments(spark, sf).filter(F.col("l_linestatus") == "O")
    return agg.aggregate(open_items, ["period"], [
        Measure("index_mean", "mean", F.col("price")),
        Measure("index_vol", "std", F.col("price")),
    ])


INDICES = (
    SHIP
    + """,
indices AS (SELECT period, avg(price) AS index_mean, stddev_samp(price) AS index_vol
            FROM ship WHERE l_linestatus = 'O' GROUP BY period)"""
)

# --- daily entity panel: purchases per user ----------------------------------


def purchases(spark: SparkSession, sf: str) -> DataFrame:
    """Value of purchases per user and day on the complete 30-day grid, NULL without any."""
    events = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("entity"), F.to_date("ts").alias("period"),
        (F.col("value") / 7).alias("value"), "event_type",
    )
    daily = agg.aggregate(
        events.filter(F.col("event_type") == "purchase"), ["entity", "period"], [Measure("value", "sum", F.col("value"))]
    )
    grid = joins.day_skeleton(events, "2024-01-01", "2024-01-30")
    full = grid.join(daily, ["entity", "period"], "left")
    return full.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


PURCHASES = """
daily AS (SELECT CAST(user_id AS VARCHAR) AS entity, CAST(ts AS DATE) AS day, sum(value / 7) AS value
          FROM events WHERE event_type = 'purchase' GROUP BY ALL),
days AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS d),
purchases AS (SELECT u.entity, strftime(d, '%Y-%m-%d') AS period, value
              FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS entity FROM events) u CROSS JOIN days
              LEFT JOIN daily ON daily.entity = u.entity AND daily.day = CAST(d AS DATE))"""

# --- annual table -------------------------------------------------------------


def annual(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of order kinds per nation and year: indices between 0 and 1."""
    events = order_events(spark, sf).withColumn("period", F.substring("period", 1, 4))
    measures = [
        Measure("open_share", "mean", (F.col("kind") == 2).cast("double")),
        Measure("done_share", "mean", (F.col("kind") == 1).cast("double")),
        Measure("urgent_share", "mean", (F.col("o_orderpriority") == "1-URGENT").cast("double")),
        Measure("growth", "mean", F.col("best")),
    ]
    per_year = by_customer(spark, sf, events, measures)
    return per_year.withColumn("year", F.col("period").cast("int")).drop("period")


ANNUAL = (
    EV
    + """,
annual AS (SELECT entity, CAST(period[1:4] AS INTEGER) AS year,
                  avg(CASE WHEN kind = 2 THEN 1.0 ELSE 0 END) AS open_share,
                  avg(CASE WHEN kind = 1 THEN 1.0 ELSE 0 END) AS done_share,
                  avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0 END) AS urgent_share,
                  avg(best) AS growth FROM ev GROUP BY entity, period[1:4])"""
)

# --- monthly categories ---------------------------------------------------------


def categories(spark: SparkSession, sf: str) -> DataFrame:
    """Priority of the dearest order per nation and month on the grid, NULL without orders."""
    per_code = order_events(spark, sf).groupBy("o_custkey", "period").agg(
        F.max(F.struct("best", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate")).alias("top")
    )
    joined = keys.recode(per_code, "o_custkey", customer_entities(spark, sf))
    top = joined.groupBy("entity", "period").agg(F.max("top").alias("top"))
    return joins.complete_grid(top, START, END).select(
        "entity", "period", F.col("top.o_orderpriority").alias("government"),
        F.when(F.col("top.o_orderstatus") == "F", 1).when(F.col("top").isNotNull(), 0).alias("irregular"),
        F.col("top.o_orderdate").cast("date").alias("event_date"),
        (F.col("top.best") / 6).alias("age"),
    )


CATEGORIES = (
    EV
    + ","
    + months_cte()
    + """,
tops AS (SELECT entity, period, max({'best': best, 'k': o_orderkey, 'p': o_orderpriority, 's': o_orderstatus,
                                     'd': o_orderdate}) AS t FROM ev GROUP BY entity, period),
cat AS (SELECT e.entity, m.period, t.p AS government,
               CASE WHEN t IS NULL THEN NULL WHEN t.s = 'F' THEN 1 ELSE 0 END AS irregular,
               CAST(t.d AS DATE) AS event_date, t.best / 6 AS age
        FROM (SELECT DISTINCT entity FROM tops) e CROSS JOIN months m
        LEFT JOIN tops ON tops.entity = e.entity AND tops.period = m.period)"""
)

# --- rare events ("coups"): the dearest fulfilled urgent orders ------------------------


def coup_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Urgent orders above a price, keyed by customer: code 2 when fulfilled, 1 when pending, else NULL."""
    rare = order_events(spark, sf).filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("best") > 400))
    code = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "P", 1)
    return rare.select("o_custkey", "period", code.alias("coup_code"))


def coup_months(spark: SparkSession, sf: str) -> DataFrame:
    return agg.coup_months(
        coup_rows(spark, sf), source="o_custkey", crosswalk=customer_entities(spark, sf), small=small(spark, sf, "customer")
    )


COUPS = (
    EV
    + """,
coup_rows AS (SELECT entity, period, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 END AS coup_code
              FROM ev WHERE o_orderpriority = '1-URGENT' AND best > 400),
coups AS (SELECT entity, period, CAST(max(CASE WHEN coup_code = 2 THEN 1 ELSE 0 END) AS INTEGER) AS pt_coup_successful,
                 CAST(max(CASE WHEN coup_code = 1 THEN 1 ELSE 0 END) AS INTEGER) AS pt_coup_failed,
                 count(coup_code) AS pt_coup_count,
                 CAST(max(CASE WHEN coup_code IN (1, 2) THEN 1 ELSE 0 END) AS INTEGER) AS pt_coup_event
          FROM coup_rows GROUP BY entity, period)"""
)

# --- daily price series ------------------------------------------------------------------


def daily_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Mean shipment price per day and return flag, NULL on days whose mean is below a floor."""
    daily = agg.aggregate(
        shipments(spark, sf).withColumn("date", F.to_date("l_shipdate")), ["l_returnflag", "date"],
        [Measure("close", "mean", F.col("price"))],
    )
    close = F.when(F.col("close") >= 25, F.col("close"))
    return daily.select(F.col("l_returnflag").alias("series"), "date", close.alias("close"))


PRICES = (
    SHIP
    + """,
prices AS (SELECT l_returnflag AS series, CAST(l_shipdate AS DATE) AS date,
                  CASE WHEN avg(price) >= 25 THEN avg(price) END AS close FROM ship GROUP BY ALL)"""
)

# --- forecasts: previous monthly totals as samples ----------------------------------------------

SPIKE = 2500.0


def forecasts(spark: SparkSession, sf: str, size: int = 12) -> DataFrame:
    return scoring.history_forecast(conflict_panel(spark, sf), "fatalities_best", size)


def forecast_cte(name: str = "fc", size: int = 12) -> str:
    return f"""
{name} AS (SELECT entity, period, y, samples FROM (
  SELECT entity, period, fatalities_best AS y,
         list(fatalities_best) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING) AS samples
  FROM panel) WHERE len(samples) = {size})"""


FC = PANEL + "," + forecast_cte()


def sql_list(columns: list[str], template: str) -> str:
    """A select list from a template with ``{c}``."""
    return ", ".join(template.replace("{c}", c) for c in columns)


def erf_sql(x: str) -> str:
    """erf by its all-positive series, exact to double precision for |x| < 6."""
    return f"""CASE WHEN {x} = 0 THEN 0.0 WHEN abs({x}) >= 6 THEN sign({x}) ELSE sign({x}) * 2 / sqrt(pi()) * exp(-pow({x}, 2)) *
      list_sum(list_transform(range(0, 150), lambda n: exp((2 * n + 1) * ln(abs({x})) + 2 * n * ln(2.0) - lgamma(2 * n + 2) + lgamma(n + 1)))) END"""


def chi2_tail_9_sql(x: str) -> str:
    """Upper tail of chi-squared with nine degrees of freedom."""
    return f"""(1 - ({erf_sql(f'sqrt({x} / 2)')}) + sqrt(2 * {x} / pi()) * exp(-{x} / 2) *
      (1 + {x} / 3 + pow({x}, 2) / 15 + pow({x}, 3) / 105))"""


def philox_sql(source: str, key: str, first: str, second: str, names: tuple[str, str], step: str) -> str:
    """CTEs from ``source`` to ``{step}``: two columns of numbers in (0, 1) by ten rounds of Philox 2x32."""
    rounds = [f"{step}_0 AS (SELECT *, ({first})::UBIGINT AS _x, ({second})::UBIGINT AS _y, ({key})::UBIGINT AS _k FROM {source})"]
    for r in range(10):
        rounds.append(
            f"""{step}_{r + 1} AS (SELECT * REPLACE (xor(xor((_x * {0xD256D193}::UBIGINT) >> 32::UBIGINT, (_k + {r * 0x9E3779B9 % (1 << 32)}::UBIGINT) & 4294967295::UBIGINT), _y) AS _x,
            (_x * {0xD256D193}::UBIGINT) & 4294967295::UBIGINT AS _y) FROM {step}_{r})"""
        )
    rounds.append(f"{step} AS (SELECT * EXCLUDE (_x, _y, _k), (_x + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS {names[0]}, (_y + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS {names[1]} FROM {step}_10)")
    return ",\n".join(rounds)


def keyed_sql(at: int, text: str) -> str:
    """Eight hexadecimal digits of a digest as a number."""
    return f"CAST('0x' || substr(md5({text}), {at}, 8) AS UBIGINT)"
