"""Window features over an entity's history."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from panelloom.functions import scalar
from panelloom.operators import windows
from workload import base
from workload.base import (
    ANNUAL, CATEGORIES, INDICES, PANEL, PURCHASES, RATE, RATE_GRID, annual, categories, conflict_panel, indices,
    purchases, query, rate_grid, rate_series,
)
from workload.merges import COUP_PANEL, coup_panel

W = "(PARTITION BY entity ORDER BY period)"


def rows(first: str, last: str = "CURRENT ROW") -> str:
    return f"(PARTITION BY entity ORDER BY period ROWS BETWEEN {first} AND {last})"


PRIOR = [c for c in base.CONFLICT_COLUMNS if c != "fatalities_best"]


@query(
    f"""WITH {PANEL} SELECT entity, period, fatalities_best, {', '.join(f'lag({c}) OVER {W} AS {c}' for c in PRIOR)} FROM panel""",
    doubles=base.CONFLICT_DOUBLES,
)
def lag_features(spark, sf):
    """Every feature shifted by a month, the target left in place."""
    return windows.lag_columns(conflict_panel(spark, sf).drop("has_conflict"), PRIOR)


@query(
    f"""WITH {INDICES} SELECT period, lag(index_mean) OVER (ORDER BY period) AS index_mean,
    lag(index_vol) OVER (ORDER BY period) AS index_vol FROM indices""",
    doubles="index_mean index_vol",
)
def lag_global_series(spark, sf):
    return windows.lag_series(indices(spark, sf), ["index_mean", "index_vol"])


LOGS = ["event_count", "fatalities_best", "civilian_deaths"]


@query(
    f"""WITH {PANEL}, l AS (SELECT entity, period, {', '.join(f'ln(1 + {c}) AS {c}' for c in LOGS)} FROM panel)
    SELECT *, {', '.join(f'{c} - lag({c}) OVER {W} AS {c}_ld' for c in LOGS)} FROM l""",
    doubles=" ".join(c + s for c in LOGS for s in ("", "_ld")),
)
def log_diff(spark, sf):
    logged = conflict_panel(spark, sf).select("entity", "period", *[scalar.log1p_clipped(F.col(c)).alias(c) for c in LOGS])
    return windows.log_diff(logged, LOGS)


@query(
    f"""WITH {RATE} SELECT entity, period, rate / lag(rate) OVER {W} - 1 AS change_1,
    rate / lag(rate, 12) OVER {W} - 1 AS change_12 FROM rate""",
    doubles="change_1 change_12",
)
def pct_change(spark, sf):
    """Row-based changes of a series with missing months."""
    return rate_series(spark, sf).select(
        "entity", "period", windows.pct_change("rate", 1).alias("change_1"), windows.pct_change("rate", 12).alias("change_12")
    )


@query(
    f"""WITH {RATE_GRID}, y AS (SELECT *, rate - lag(rate, 12) OVER {W} AS diff_12, rate / lag(rate, 12) OVER {W} - 1 AS yoy FROM grid)
    SELECT entity, period, diff_12, yoy - lag(yoy) OVER {W} AS acceleration FROM y""",
    doubles="diff_12 acceleration",
)
def yoy_diff(spark, sf):
    df = rate_grid(spark, sf).withColumns({"diff_12": windows.diff("rate", 12), "yoy": windows.pct_change("rate", 12)})
    return df.select("entity", "period", "diff_12", windows.diff("yoy").alias("acceleration"))


@query(
    f"""WITH {RATE_GRID} SELECT entity, period, CASE WHEN count(rate) OVER w >= 2 THEN stddev_samp(rate) OVER w END AS vol,
    CASE WHEN count(rate) OVER w >= 2 THEN ln(1 + stddev_samp(rate) OVER w) END AS vol_log
    FROM grid WINDOW w AS {rows('2 PRECEDING')}""",
    doubles="vol vol_log",
)
def rolling_std_minp(spark, sf):
    vol = windows.rolling_std("rate", 3, 2)
    return rate_grid(spark, sf).select("entity", "period", vol.alias("vol"), F.log1p(vol).alias("vol_log"))


@query(
    f"""WITH {ANNUAL}, z AS (SELECT entity, year, CASE WHEN count(growth) OVER w >= 3
       THEN (growth - avg(growth) OVER w) / greatest(stddev_samp(growth) OVER w, 0.01) END AS deviation
       FROM annual WINDOW w AS (PARTITION BY entity ORDER BY year ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT *, CASE WHEN deviation < -1 THEN 1 ELSE 0 END AS shock FROM z""",
    doubles="deviation",
)
def rolling_z_trend(spark, sf):
    deviation = windows.rolling_deviation("growth", 5, 3, 0.01, period="year")
    df = annual(spark, sf).select("entity", "year", deviation.alias("deviation"))
    return df.withColumn("shock", scalar.flag(F.col("deviation") < -1.0))


@query(
    f"""WITH {RATE_GRID}, l AS (SELECT entity, period, lag(rate) OVER {W} AS x FROM grid),
    r AS (SELECT entity, period, CASE WHEN count(x) OVER w >= 6 THEN x / avg(x) OVER w END AS anomaly
          FROM l WINDOW w AS {rows('11 PRECEDING')})
    SELECT *, CASE WHEN anomaly IS NOT NULL THEN ln(greatest(anomaly, 1e-6)) END AS anomaly_log,
    CASE WHEN anomaly > 1.15 THEN 1 ELSE 0 END AS spike FROM r""",
    doubles="anomaly anomaly_log",
)
def rolling_ratio(spark, sf):
    """Lagged value against its twelve-row mean, its log and a spike flag."""
    lagged = windows.lag_columns(rate_grid(spark, sf), ["rate"])
    ratio = F.try_divide(F.col("rate"), windows.rolling_mean("rate", 12, 6))
    df = lagged.select("entity", "period", ratio.alias("anomaly"))
    return df.withColumns(
        {"anomaly_log": F.log(scalar.clip(F.col("anomaly"), low=1e-6)), "spike": scalar.flag(F.col("anomaly") > 1.15)}
    )


@query(
    f"""WITH {RATE_GRID} SELECT entity, period, CASE WHEN count(rate) OVER w >= 6 THEN (rate - avg(rate) OVER w)
    / greatest(stddev_samp(rate) OVER w, 1e-8) END AS zscore FROM grid WINDOW w AS {rows('UNBOUNDED PRECEDING')}""",
    doubles="zscore",
)
def expanding_zscore(spark, sf):
    return rate_grid(spark, sf).select("entity", "period", windows.expanding_zscore("rate").alias("zscore"))


@query(
    f"""WITH {RATE_GRID} SELECT entity, period, CASE WHEN stddev_samp(rate) OVER w > 0 AND
    rate > avg(rate) OVER w + 2 * stddev_samp(rate) OVER w THEN 1 ELSE 0 END AS depreciation,
    CASE WHEN stddev_samp(rate) OVER e > 0 AND rate > avg(rate) OVER e + 2 * stddev_samp(rate) OVER e THEN 1 ELSE 0 END AS depreciation_so_far
    FROM grid WINDOW w AS (PARTITION BY entity), e AS {rows('UNBOUNDED PRECEDING')}"""
)
def outlier_flag_entity(spark, sf):
    return rate_grid(spark, sf).select(
        "entity", "period", windows.entity_outlier_flag("rate").alias("depreciation"),
        windows.entity_outlier_flag("rate", expanding=True).alias("depreciation_so_far"),
    )


@query(
    f"""WITH {PURCHASES} SELECT entity, period, last_value(value IGNORE NULLS) OVER {rows('UNBOUNDED PRECEDING')} AS value FROM purchases""",
    doubles="value",
)
def ffill(spark, sf):
    return windows.ffill(purchases(spark, sf), ["value"])


@query(
    f"""WITH {PURCHASES} SELECT entity, period, last_value(value IGNORE NULLS) OVER {rows('3 PRECEDING')} AS value FROM purchases""",
    doubles="value",
)
def ffill_limit(spark, sf):
    return windows.ffill_limit(purchases(spark, sf), ["value"], 3)


CHANGES = (
    CATEGORIES
    + f""",
changes AS (SELECT entity, period, government, irregular, CASE WHEN government IS NULL THEN NULL
   WHEN row_number() OVER {W} = 1 THEN 0.0
   WHEN lag(government) OVER {W} IS DISTINCT FROM government THEN 1.0 ELSE 0.0 END AS regime_change FROM cat),
breaks AS (SELECT *, CASE WHEN regime_change = 1 OR irregular = 1 THEN 1.0 ELSE 0.0 END AS structural_break FROM changes)"""
)


@query(f"WITH {CHANGES} SELECT entity, period, government, CAST(regime_change AS DOUBLE) AS regime_change FROM changes")
def change_flag(spark, sf):
    return categories(spark, sf).select("entity", "period", "government", windows.change_flag("government").alias("regime_change"))


@query(f"WITH {CHANGES} SELECT entity, period, CAST(structural_break AS DOUBLE) AS structural_break FROM breaks")
def structural_break(spark, sf):
    df = categories(spark, sf).withColumn("regime_change", windows.change_flag("government"))
    return df.select("entity", "period", windows.structural_break("regime_change", "irregular").alias("structural_break"))


@query(f"WITH {COUP_PANEL} SELECT entity, period, pt_coup_event, pt_months_since_coup FROM coup_panel")
def periods_since_event(spark, sf):
    return coup_panel(spark, sf).select("entity", "period", "pt_coup_event", "pt_months_since_coup")


@query(f"WITH {COUP_PANEL} SELECT entity, period, pt_coup_event, pt_cumulative_coups FROM coup_panel")
def cumulative_events(spark, sf):
    return coup_panel(spark, sf).select("entity", "period", "pt_coup_event", "pt_cumulative_coups")


@query(
    f"""WITH {COUP_PANEL}, f AS (SELECT *, min(CASE WHEN pt_coup_event = 1 THEN period END) OVER (PARTITION BY entity, period[1:4]) AS first_break FROM coup_panel)
    SELECT entity, period, CASE WHEN period > first_break THEN 1 ELSE 0 END AS vdem_stale_flag FROM f"""
)
def stale_flag(spark, sf):
    flagged = windows.stale_flag(coup_panel(spark, sf), F.col("pt_coup_event") == 1, "vdem_stale_flag")
    return flagged.select("entity", "period", "vdem_stale_flag")


TARGET = (
    PANEL
    + """,
target AS (SELECT entity, period, ln(1 + fatalities_best) AS y FROM panel)"""
)


def target(spark, sf):
    return conflict_panel(spark, sf).select("entity", "period", scalar.log1p_clipped(F.col("fatalities_best")).alias("y"))


LAGS = f"""{TARGET},
lags AS (SELECT entity, period, y, lag(y, 1) OVER {W} AS target_lag1, lag(y, 2) OVER {W} AS target_lag2,
                lag(y, 3) OVER {W} AS target_lag3, lag(y, 1) OVER {W} - lag(y, 2) OVER {W} AS target_diff1 FROM target)"""


@query(f"WITH {LAGS} SELECT * FROM lags", doubles="y target_lag1 target_lag2 target_lag3 target_diff1")
def target_lags(spark, sf):
    return windows.target_lags(target(spark, sf), "y")


def _rolls(alias: str) -> str:
    parts = []
    for w in (3, 6, 12):
        over = f"(PARTITION BY entity ORDER BY period ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        parts.append(
            f"avg(y) OVER {over} AS target_roll{w}_mean, quantile_cont(y, 0.5) OVER {over} AS target_roll{w}_median, "
            f"stddev_samp(y) OVER {over} AS target_roll{w}_std, max(y) OVER {over} AS target_roll{w}_max"
        )
    return f"{alias} AS (SELECT *, {', '.join(parts)} FROM lags)"


ROLLS = LAGS + "," + _rolls("rolls")
ROLL_COLUMNS = " ".join(f"target_roll{w}_{s}" for w in (3, 6, 12) for s in ("mean", "median", "std", "max"))


@query(f"WITH {ROLLS} SELECT entity, period, {ROLL_COLUMNS.replace(' ', ', ')} FROM rolls", doubles=ROLL_COLUMNS)
def rolling_target_stats(spark, sf):
    return windows.rolling_target_stats(target(spark, sf), "y").drop("y")


ZSCORES = ", ".join(
    f"CASE WHEN target_roll{w}_std <> 0 THEN (target_lag1 - target_roll{w}_mean) / target_roll{w}_std END AS target_roll{w}_zscore"
    for w in (3, 6, 12)
)


@query(f"WITH {ROLLS} SELECT entity, period, {ZSCORES} FROM rolls", doubles="target_roll3_zscore target_roll6_zscore target_roll12_zscore")
def rolling_target_zscore(spark, sf):
    df = windows.rolling_target_stats(windows.target_lags(target(spark, sf), "y"), "y")
    return windows.rolling_target_zscores(df).select("entity", "period", *[f"target_roll{w}_zscore" for w in (3, 6, 12)])


SPIKE_LEVEL = math.log1p(base.SPIKE)


@query(
    f"""WITH {LAGS}, n AS (SELECT *, row_number() OVER {W} AS rn FROM lags)
    SELECT entity, period, CAST(rn - max(CASE WHEN target_lag1 > {SPIKE_LEVEL!r} THEN rn END) OVER {rows('UNBOUNDED PRECEDING')} AS DOUBLE) AS target_months_since_spike FROM n"""
)
def periods_since_spike(spark, sf):
    return windows.periods_since_spike(target(spark, sf), "y", SPIKE_LEVEL).drop("y")


def _window_summary(df):
    """Arrays reduced to their size, ends and a checksum, so results compare as plain columns."""
    first, last = F.col("x")[0], F.element_at("x", -1)
    total = F.aggregate("x", F.lit(0.0), lambda acc, s: acc + F.coalesce(s["rate"], F.lit(0.0)))
    return df.select(
        "entity", "period", "y", F.size("x").cast("long").alias("n"), first["events"].alias("first_events"),
        last["events"].alias("last_events"), last["rate"].alias("last_rate"), total.alias("rate_sum"),
    )


WINDOW_BASE = (
    PANEL
    + ","
    + RATE.replace(base.EV + ",", "")
    + """,
wb AS (SELECT p.entity, p.period, p.event_count AS events, r.rate, ln(1 + p.fatalities_best) AS y FROM panel p
       LEFT JOIN rate r ON r.entity = p.entity AND r.period = p.period)"""
)


def _window_base(spark, sf):
    joined = conflict_panel(spark, sf).join(rate_series(spark, sf), ["entity", "period"], "left")
    return joined.select("entity", "period", F.col("event_count").alias("events"), "rate", F.log1p("fatalities_best").alias("y"))


def _windows_sql(where: str) -> str:
    over = rows("24 PRECEDING", "1 PRECEDING")
    return f"""WITH {WINDOW_BASE}, c AS (SELECT entity, period, exp(y) - 1 AS y, list(struct_pack(events, rate)) OVER {over} AS x FROM wb)
    SELECT entity, period, y, len(x) AS n, x[1].events AS first_events, x[-1].events AS last_events, x[-1].rate AS last_rate,
    list_sum(list_transform(x, lambda s: coalesce(s.rate, 0))) AS rate_sum FROM c WHERE len(x) = 24 {where}"""


@query(_windows_sql(""), doubles="y last_rate rate_sum")
def sliding_windows(spark, sf):
    return _window_summary(windows.sliding_windows(_window_base(spark, sf), ["events", "rate"], "y"))


@query(_windows_sql("AND period BETWEEN '1999-01' AND '2000-12'"), doubles="y last_rate rate_sum")
def sliding_windows_padded(spark, sf):
    padded = windows.sliding_windows_padded(
        _window_base(spark, sf), ["events", "rate"], "y", start="1999-01", end="2000-12"
    )
    return _window_summary(padded)
