"""Missingness, profiles, correlation, registries and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators import joins, profile, registry
from workload import base
from workload.base import (
    END, INDICES, RATE, START, annual, indices, query, rate_series,

)
from workload.merges import MERGED, merged, stored_merge

COLUMNS = ["event_count", "fatalities_best", "returned_value", "mean_tone", "rate", "index_mean"]


def union(template: str, columns=COLUMNS, source: str = "merged") -> str:
    """One SELECT per column, ``{c}`` replaced."""
    return " UNION ALL ".join(f"({template.replace('{c}', c)} FROM {source})" for c in columns)


def corr_sql(a: str, b: str) -> str:
    """Correlation, NULL where a side has no spread."""
    return f"CASE WHEN NOT isnan(corr({a}, {b})) THEN corr({a}, {b}) END"


NULL_PCT = "avg(CASE WHEN {c} IS NULL THEN 100.0 ELSE 0 END)"


@query(
    f"WITH {MERGED} " + union(f"SELECT '{{c}}' AS feature, {NULL_PCT} AS missing_pct, {NULL_PCT} > 40 AS above_limit"),
    doubles="missing_pct",
)
def missingness_by_column(spark, sf):
    return profile.missing_by_column(merged(spark, sf), COLUMNS)


@query(
    f"WITH {MERGED} "
    + " UNION ALL ".join(
        f"(SELECT period[1:4] AS year, '{c}' AS feature, {NULL_PCT.replace('{c}', c)} AS missing_pct FROM merged GROUP BY period[1:4])"
        for c in COLUMNS
    ),
    doubles="missing_pct",
)
def missingness_by_year(spark, sf):
    return profile.missing_by_year(merged(spark, sf), COLUMNS)


@query(
    f"""WITH {RATE}, {base.months_cte()}, e AS (SELECT DISTINCT entity FROM rate)
    SELECT e.entity, 100 - 100.0 * count(r.rate) / count(*) AS missing_pct FROM e CROSS JOIN months m
    LEFT JOIN rate r ON r.entity = e.entity AND r.period = m.period GROUP BY e.entity HAVING missing_pct > 0
    ORDER BY missing_pct DESC, entity LIMIT 10""",
    doubles="missing_pct",
)
def missingness_by_entity(spark, sf):
    return profile.missing_by_entity(rate_series(spark, sf), "rate", START, END, 10)


SOURCES = {"a": ["event_count", "fatalities_best"], "b": ["returned_value", "mean_tone"], "c": ["rate", "index_mean"]}


@query(
    f"WITH {MERGED} "
    + " UNION ALL ".join(
        f"(SELECT '{s}' AS source, ({' + '.join(NULL_PCT.replace('{c}', c) for c in cols)}) / {len(cols)} AS missing_pct FROM merged)"
        for s, cols in SOURCES.items()
    ),
    doubles="missing_pct",
)
def missingness_by_source(spark, sf):
    return profile.missing_by_source(merged(spark, sf), SOURCES)


ZERO_PCT = "avg(CASE WHEN {c} = 0 THEN 100.0 WHEN {c} IS NOT NULL THEN 0 END)"


@query(
    f"WITH {MERGED} "
    + union(
        f"""SELECT '{{c}}' AS feature, count({{c}}) AS n_nonmissing, {NULL_PCT} AS missing_pct, {ZERO_PCT} AS pct_zero, avg({{c}}) AS mean,
    stddev_samp({{c}}) AS std, skewness({{c}}) AS skewness, CAST(max({{c}}) AS DOUBLE) AS max, quantile_cont({{c}}, 0.5) AS median,
    quantile_cont({{c}}, 0.05) AS p5, quantile_cont({{c}}, 0.95) AS p95"""
    ),
    doubles="missing_pct pct_zero mean std skewness max median p5 p95",
)
def profile_basic(spark, sf):
    return profile.profile_basic(stored_merge(spark, sf), COLUMNS)


FULL = union(
    f"""SELECT '{{c}}' AS feature, count({{c}}) AS n, avg({{c}}) AS mean, stddev_samp({{c}}) AS std, CAST(min({{c}}) AS DOUBLE) AS min,
    CAST(max({{c}}) AS DOUBLE) AS max, skewness({{c}}) AS skewness, kurtosis({{c}}) AS kurtosis, {ZERO_PCT} AS pct_zero, """
    + ", ".join(f"quantile_cont({{c}}, {p}) AS {n}" for n, p in profile.FULL_QUANTILES.items())
)
FULL_DOUBLES = "mean std min max skewness kurtosis pct_zero median p01 p05 p25 p75 p95 p99"


@query(f"WITH {MERGED} {FULL}", doubles=FULL_DOUBLES)
def profile_full(spark, sf):
    return profile.profile_full(stored_merge(spark, sf), COLUMNS)


def classified_source(spark, sf):
    """Merged panel with a bounded, a mostly-zero, a heavy-tailed and a nearly constant column."""
    df = stored_merge(spark, sf)
    best = F.col("fatalities_best")
    return df.select(
        "entity", "period", "event_count", "rate",
        (F.col("event_count") / 1000).alias("share"),
        F.when(F.col("event_count") > 10, best).when(F.col("event_count").isNotNull(), 0.0).alias("rare"),
        F.exp(best / 500).alias("heavy"),
        (1000 + best / 1000).alias("still"),
    )


CLASS_COLUMNS = ["event_count", "rate", "share", "rare", "heavy", "still"]
CLASS_BASE = """cs AS (SELECT entity, period, event_count, rate, event_count / 1000 AS share,
  CASE WHEN event_count > 10 THEN fatalities_best WHEN event_count IS NOT NULL THEN 0 END AS rare,
  exp(fatalities_best / 500) AS heavy, 1000 + fatalities_best / 1000 AS still FROM merged)"""
CLASS_PROFILE = (
    f"{MERGED}, {CLASS_BASE}, prof AS ("
    + union(
        f"""SELECT '{{c}}' AS feature, avg({{c}}) AS mean, stddev_samp({{c}}) AS std, min({{c}}) AS min, max({{c}}) AS max, kurtosis({{c}}) AS kurtosis,
    {ZERO_PCT} AS pct_zero, quantile_cont({{c}}, 0.5) AS median, quantile_cont({{c}}, 0.99) AS p99""",
        CLASS_COLUMNS,
        "cs",
    )
    + """), classes AS (SELECT *, CASE WHEN min >= 0 AND max <= 1.01 THEN 'bounded' WHEN pct_zero > 50 THEN 'zero-inflated'
      WHEN kurtosis > 5 OR (median > 0 AND p99 > 10 * median) THEN 'heavy-tailed' WHEN mean <> 0 AND std < 0.01 * abs(mean) THEN 'near-zero-variance'
      ELSE 'normal-ish' END AS distribution_type FROM prof),
    advised AS (SELECT *, CASE WHEN distribution_type IN ('heavy-tailed', 'zero-inflated') AND min >= 0 THEN 'log1p'
      WHEN distribution_type = 'bounded' THEN 'raw (bounded index)' WHEN distribution_type = 'near-zero-variance' THEN 'drop candidate'
      ELSE 'raw' END AS transform_rec FROM classes)"""
)


@query(f"WITH {CLASS_PROFILE} SELECT feature, distribution_type, transform_rec FROM advised")
def profile_classify(spark, sf):
    full = profile.profile_full(classified_source(spark, sf), CLASS_COLUMNS)
    return profile.classify(full).select("feature", "distribution_type", "transform_rec")


@query(
    f"WITH {MERGED}, o AS ("
    + " UNION ALL ".join(
        f"""(SELECT '{c}' AS feature, t AS threshold, CAST(count(*) AS BIGINT) AS n_outliers, CAST(max({c}) AS DOUBLE) AS max
      FROM merged, (SELECT quantile_cont({c}, 0.995) AS t FROM merged) WHERE {c} > t GROUP BY t)"""
        for c in COLUMNS
    )
    + ") SELECT * FROM o",
    doubles="threshold max",
)
def outliers_p995(spark, sf):
    return profile.outliers(stored_merge(spark, sf), COLUMNS)


@query(
    f"WITH {MERGED} " + union("SELECT '{c}' AS feature, avg(CASE WHEN coalesce({c}, 0) = 0 THEN 100.0 ELSE 0 END) AS pct_zero"),
    doubles="pct_zero",
)
def zero_inflation(spark, sf):
    return profile.zero_inflation(merged(spark, sf), COLUMNS)


PAIRS = [(a, b) for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :]]
RANKED = ", ".join(
    f"""CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 END AS {c}"""
    for c in COLUMNS
)


SNAPPED = "snapped AS (SELECT entity, period, " + ", ".join(f"round({c}, 6) AS {c}" for c in COLUMNS) + " FROM merged)"


@query(
    f"WITH {MERGED}, {SNAPPED}, ranked AS (SELECT entity, period, {RANKED} FROM snapped) SELECT *, abs(r) > 0.9 AS redundant FROM ("
    + " UNION ALL ".join(f"(SELECT '{a}' AS feature_a, '{b}' AS feature_b, {corr_sql(a, b)} AS r FROM ranked)" for a, b in PAIRS)
    + ") WHERE r IS NOT NULL AND NOT isnan(r)",
    doubles="r",
)
def spearman_matrix(spark, sf):
    """All pairs, average ranks over each column's own values.

    Values are rounded first: equal means must tie whatever the order of their sums.
    """
    return profile.spearman_pairs(base.rounded(stored_merge(spark, sf)), COLUMNS, report=None)


@query(
    f"WITH {MERGED} SELECT * FROM ("
    + " UNION ALL ".join(f"(SELECT '{a}' AS feature_a, '{b}' AS feature_b, {corr_sql(a, b)} AS r FROM merged)" for a, b in PAIRS)
    + ")",
    doubles="r",
)
def pearson_matrix(spark, sf):
    return profile.pearson_pairs(merged(spark, sf), COLUMNS)


@query(
    f"WITH {MERGED} "
    + union("SELECT '{c}' AS feature, CASE WHEN count(CASE WHEN {c} IS NOT NULL AND fatalities_best IS NOT NULL THEN 1 END) > 10 THEN abs(corr({c}, fatalities_best)) ELSE 0 END AS abs_r", [c for c in COLUMNS if c != "fatalities_best"]),
    doubles="abs_r",
)
def target_correlation(spark, sf):
    return profile.target_correlation(merged(spark, sf), [c for c in COLUMNS if c != "fatalities_best"], "fatalities_best")


@query(
    f"""WITH {RATE}, {INDICES}, p AS (SELECT entity, rate AS x, lag(rate) OVER (PARTITION BY entity ORDER BY period) AS x1 FROM rate),
    per AS (SELECT entity, corr(x, x1) AS r, count(*) AS n FROM p GROUP BY entity HAVING count(*) > 12),
    s AS (SELECT index_mean AS x, lag(index_mean, 1) OVER (ORDER BY period) AS l1, lag(index_mean, 3) OVER (ORDER BY period) AS l3,
          lag(index_mean, 12) OVER (ORDER BY period) AS l12 FROM indices)
    SELECT 'mean_autocorr' AS metric, avg(r) AS value FROM per UNION ALL SELECT 'n_high', count(*) FILTER (r > 0.1) FROM per
    UNION ALL SELECT 'n_entities', count(*) FROM per UNION ALL SELECT 'index_mean_lag1', corr(x, l1) FROM s
    UNION ALL SELECT 'index_mean_lag3', corr(x, l3) FROM s UNION ALL SELECT 'index_mean_lag12', corr(x, l12) FROM s""",
    doubles="value",
)
def autocorrelation(spark, sf):
    """Lag-1 per entity, summarised, and lags 1, 3 and 12 of a month-level series."""
    per = profile.autocorrelation(rate_series(spark, sf), "rate")
    row = profile.autocorrelation_summary(per, high=0.1)
    names = ["mean_autocorr", "n_high", "n_entities"]
    summary = row.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "metric", "value")
    series = profile.series_autocorrelation(indices(spark, sf), ["index_mean"])
    named = series.select(F.concat("feature", F.lit("_lag"), F.col("lag").cast("string")).alias("metric"), F.col("autocorr").alias("value"))
    return summary.unionByName(named)


HIST_COLUMNS = ["fatalities_best", "rate"]


def _hist(c: str, bins: int, value: str) -> str:
    return f"""(SELECT '{c}' AS feature, least(CAST(floor((v - lo) / ((hi - lo) / {bins})) AS INTEGER), {bins - 1}) AS bin, lo, hi, count(*) AS n
      FROM (SELECT {value.replace('{c}', c)} AS v, min({value.replace('{c}', c)}) OVER () AS lo, max({value.replace('{c}', c)}) OVER () AS hi FROM merged WHERE {c} IS NOT NULL) GROUP BY ALL)"""


@query(
    f"WITH {MERGED}, h AS ("
    + " UNION ALL ".join(
        f"SELECT {b} AS bins, '{k}' AS scale, * FROM " + _hist(c, b, v)
        for k, v, b in (("raw", "{c}", 50), ("raw", "{c}", 60), ("log1p", "ln(1 + greatest({c}, 0))", 40))
        for c in HIST_COLUMNS
    )
    + ") SELECT bins, scale, feature, bin, lo + bin * ((hi - lo) / bins) AS low, lo + (bin + 1) * ((hi - lo) / bins) AS high, n FROM h",
    doubles="low high",
)
def histogram_table(spark, sf):
    """Counts in 50, 60 and 40 bins, raw and on the log scale."""
    df = stored_merge(spark, sf)
    parts = [
        profile.histogram(df, HIST_COLUMNS, b, log).select(F.lit(b).alias("bins"), F.lit("log1p" if log else "raw").alias("scale"), "*")
        for b, log in ((50, False), (60, False), (40, True))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    f"WITH {MERGED}, q AS ("
    + union("SELECT '{c}' AS feature, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3")
    + "), v AS ("
    + union("SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v")
    + """) SELECT q.feature, q1, median, q3, min(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
      max(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
      CAST(count(*) FILTER (v NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_fliers
      FROM v JOIN q ON v.feature = q.feature WHERE v IS NOT NULL GROUP BY q.feature, q1, median, q3""",
    doubles="q1 median q3 whisker_low whisker_high",
)
def box_summary(spark, sf):
    return profile.box_summary(stored_merge(spark, sf), COLUMNS)


REG_RULES = [("prefix", "fatal", "UCDP"), ("suffix", "_value", "ACLED"), ("name", "rate", "IMF IFS"), ("prefix", "rate", "never")]
REG_SOURCE = "CASE WHEN '{c}' LIKE 'fatal%' THEN 'UCDP' WHEN '{c}' LIKE '%\\_value' ESCAPE '\\' THEN 'ACLED' WHEN '{c}' = 'rate' THEN 'IMF IFS' ELSE 'GDELT' END"


@query(
    f"WITH {MERGED} "
    + union(
        f"""SELECT '{{c}}' AS feature_name, {REG_SOURCE} AS source, CASE WHEN '{{c}}' = 'event_count' THEN 'bigint' ELSE 'double' END AS dtype,
    round({NULL_PCT}, 2) AS missing_pct, round(avg({{c}}), 4) AS mean, round(stddev_samp({{c}}), 4) AS std, round(CAST(min({{c}}) AS DOUBLE), 4) AS min,
    round(CAST(max({{c}}) AS DOUBLE), 4) AS max, '{{c}}' IN ('event_count', 'rate') AS log1p_applied, CASE WHEN '{{c}}' = 'fatalities_best' THEN 0 ELSE 1 END AS lag_months"""
    )
)
def feature_registry_ab(spark, sf):
    return registry.panel_registry(
        merged(spark, sf), COLUMNS, REG_RULES, "GDELT", log1p=["event_count", "rate"], unlagged=["fatalities_best"]
    )


REG_C_PAIRS = [(a, b) for i, a in enumerate(CLASS_COLUMNS) for b in CLASS_COLUMNS[i + 1 :]]


@query(
    f"WITH {CLASS_PROFILE}, miss AS ("
    + union(f"SELECT '{{c}}' AS feature, {NULL_PCT} AS missing_pct", CLASS_COLUMNS, "cs")
    + "), pairs AS ("
    + " UNION ALL ".join(f"(SELECT '{a}' AS a, '{b}' AS b, {corr_sql(a, b)} AS r FROM cs)" for a, b in REG_C_PAIRS)
    + """), strong AS (SELECT a AS feature, b AS other, r FROM pairs WHERE abs(r) > 0.9 UNION ALL SELECT b, a, r FROM pairs WHERE abs(r) > 0.9),
    partners AS (SELECT feature, string_agg(other || printf('(%.2f)', r), '; ' ORDER BY other) AS correlated_with, min(other) AS first FROM strong GROUP BY feature)
    SELECT p.feature AS feature_name, CASE WHEN p.feature = 'rate' THEN 'Yahoo Finance' ELSE 'GDELT' END AS source,
    CASE WHEN p.feature LIKE 'r%' THEN 'daily (agg to monthly)' ELSE 'monthly' END AS original_resolution,
    CASE WHEN p.feature LIKE 'r%' THEN 'monthly mean/std/last' ELSE 'none (already monthly)' END AS aggregation_method,
    't-1' AS lag_applied, CASE WHEN p.feature = 'heavy' THEN 'log1p' WHEN transform_rec = 'raw (bounded index)' THEN 'raw (bounded)' ELSE 'raw' END AS transform,
    round(missing_pct, 2) AS pct_missing, distribution_type, coalesce(correlated_with, '') AS correlated_with,
    CASE WHEN p.feature = 'share' THEN 'redundant (r>0.9 with ' || coalesce(first, '?') || ')' WHEN distribution_type = 'near-zero-variance' THEN 'near-zero variance' ELSE '' END AS known_issues,
    CASE WHEN p.feature = 'share' THEN 'drop' WHEN distribution_type = 'near-zero-variance' THEN 'review' ELSE 'keep' END AS status
    FROM advised p LEFT JOIN miss USING (feature) LEFT JOIN partners USING (feature)"""
)
def feature_registry_c(spark, sf):
    df = classified_source(spark, sf)
    profiles = profile.classify(profile.profile_full(df, CLASS_COLUMNS))
    return registry.volatility_registry(
        profiles, profile.missing_by_column(df, CLASS_COLUMNS), profile.pearson_pairs(df, CLASS_COLUMNS),
        [("name", "rate", "Yahoo Finance")], "GDELT", daily_prefixes=["r"], redundant=["share"], log1p=["heavy"],
    )


# Faults are planted: copies of rows, a thirteenth month, and two months stored in the wrong order.
QUALITY = f"""{base.ANNUAL}, am AS (SELECT entity, year * 12 + m AS position, printf('%d-%02d', year, CASE WHEN m = 12 AND year % 5 = 0 THEN 13
      WHEN m = 3 AND year % 2 = 0 THEN 4 WHEN m = 4 AND year % 2 = 0 THEN 3 ELSE m END) AS period, open_share, done_share * 2 AS doubled FROM annual
    CROSS JOIN (SELECT unnest(generate_series(1, 12)) AS m)),
    q AS (SELECT * FROM am UNION ALL SELECT * FROM am WHERE doubled > 0.8)"""


def _quality_rows(spark, sf):
    monthly = joins.annual_to_monthly(annual(spark, sf))
    year, month = F.substring("period", 1, 4).cast("int"), F.substring("period", 6, 2).cast("int")
    swapped = year % 2 == 0
    stored = (
        F.when((month == 12) & (year % 5 == 0), 13)
        .when((month == 3) & swapped, 4)
        .when((month == 4) & swapped, 3)
        .otherwise(month)
    )
    return monthly.select(
        "entity", (year * 12 + month).alias("position"), F.format_string("%d-%02d", year, stored).alias("period"),
        "open_share", (F.col("done_share") * 2).alias("doubled"),
    )


@query(
    f"""WITH {QUALITY}, k AS (SELECT count(*) AS n FROM q GROUP BY entity, period),
    s AS (SELECT open_share - lag(open_share, 12) OVER (PARTITION BY entity ORDER BY period) AS d,
                 lag(period) OVER (PARTITION BY entity ORDER BY position) > period AS back FROM am)
    SELECT 'duplicate_keys' AS "check", CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS violations FROM k
    UNION ALL SELECT 'period_format', count(*) FILTER (NOT regexp_full_match(period, '[0-9]{{4}}-(0[1-9]|1[0-2])')) FROM q
    UNION ALL SELECT 'range_open_share', count(*) FILTER (open_share NOT BETWEEN -0.01 AND 1.01) FROM q
    UNION ALL SELECT 'range_doubled', count(*) FILTER (doubled NOT BETWEEN -0.01 AND 1.01) FROM q
    UNION ALL SELECT 'large_shift_open_share', count(*) FILTER (abs(d) > 0.15) FROM s
    UNION ALL SELECT 'period_order', count(*) FILTER (back) FROM s"""
)
def quality_checks(spark, sf):
    single = _quality_rows(spark, sf)
    source = single.unionByName(single.filter(F.col("doubled") > 0.8))
    checks = profile.quality_checks(source, ["open_share", "doubled"])
    shifts = profile.quality_checks(single, [], shift="open_share").filter(F.col("check").startswith("large_shift"))
    return checks.unionByName(shifts).unionByName(profile.order_violations(single, "position"))


RANGES = ["fatalities_best", "rate"]
QR_METRICS = {
    "min": "min({c})", "max": "max({c})", "mean": "avg({c})", "std": "stddev_samp({c})", "p25": "quantile_cont({c}, 0.25)",
    "p75": "quantile_cont({c}, 0.75)",
}


@query(
    f"WITH {MERGED}, report AS (SELECT 'panel_dimensions' AS section, 'panel' AS item, 'n_rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM merged"
    " UNION ALL SELECT 'panel_dimensions', 'panel', 'n_entities', count(DISTINCT entity) FROM merged"
    " UNION ALL SELECT 'panel_dimensions', 'panel', 'n_periods', count(DISTINCT period) FROM merged UNION ALL "
    + " UNION ALL ".join(f"SELECT 'missingness', '{c}', 'missing_pct', round({NULL_PCT.replace('{c}', c)}, 2) AS v FROM merged HAVING v > 0" for c in COLUMNS)
    + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT 'source_coverage', '{s}', 'coverage_pct', round(avg(CASE WHEN {c} IS NULL THEN 0 ELSE 100.0 END), 2) FROM merged"
        for s, c in (("orders", "event_count"), ("fx", "rate"))
    )
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT 'value_ranges', '{c}', '{m}', round({e.replace('{c}', c)}, 4) FROM merged" for c in RANGES for m, e in QR_METRICS.items())
    + ") SELECT * FROM report"
)
def quality_report(spark, sf):
    return profile.quality_report(stored_merge(spark, sf), COLUMNS, {"orders": "event_count", "fx": "rate"}, RANGES)


