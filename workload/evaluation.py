"""Forecast scores.  The samples of a month are the entity's previous monthly values."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators import aggregates as agg
from panelloom.operators import scoring
from workload import base
from workload.base import FC, forecasts, query
from workload.scans import (
    CRPS_SQL, IGN_SQL, MEAN_SQL, MODELS, PIT_SQL, PUBLISHED, interval_sql, published, quantile_sql,
    scored_models,
)

EXACT_SQL = CRPS_SQL.replace("(2 * (i - 1) - len(samples))", "(2 * (i - 1) - len(samples) + 1)")

@query(f"WITH {FC} SELECT entity, period, y, {CRPS_SQL} AS crps, {EXACT_SQL} AS crps_exact FROM fc", doubles="y crps crps_exact")
def crps_sample(spark, sf):
    scored = scoring.crps_rows(forecasts(spark, sf))
    exact = scoring.crps_rows(scored.withColumnRenamed("crps", "_c"), exact=True)
    return exact.select("entity", "period", "y", F.col("_c").alias("crps"), F.col("crps").alias("crps_exact"))


@query(f"WITH {FC} SELECT avg({CRPS_SQL}) AS crps FROM fc", doubles="crps")
def crps_mean(spark, sf):
    return scoring.crps_mean(forecasts(spark, sf))


@query(f"WITH {FC} SELECT entity, period, {IGN_SQL} AS ign FROM fc", doubles="ign")
def ign_score(spark, sf):
    return scoring.ignorance_rows(forecasts(spark, sf)).select("entity", "period", "ign")


@query(f"WITH {FC} SELECT entity, period, {interval_sql(0.1)} AS interval_score FROM fc", doubles="interval_score")
def interval_score(spark, sf):
    return scoring.interval_rows(forecasts(spark, sf), 0.1).select("entity", "period", "interval_score")


@query(f"WITH {FC} SELECT avg({interval_sql(0.1)}) AS mis_90, avg({interval_sql(0.5)}) AS mis_50 FROM fc", doubles="mis_90 mis_50")
def mis_from_samples(spark, sf):
    return scoring.mean_interval_scores(forecasts(spark, sf))


@query(f"WITH {FC} SELECT entity, period, {PIT_SQL} AS pit FROM fc", doubles="pit")
def pit_values(spark, sf):
    return scoring.pit_rows(forecasts(spark, sf)).select("entity", "period", "pit")


PIT_BINS = f"""{FC}, pb AS (SELECT least(CAST(floor({PIT_SQL} * 10) AS INTEGER), 9) AS bin FROM fc),
bins AS (SELECT CAST(unnest(range(10)) AS INTEGER) AS bin), hist AS (SELECT b.bin, count(pb.bin) AS n FROM bins b LEFT JOIN pb ON pb.bin = b.bin GROUP BY b.bin),
tot AS (SELECT sum(n) AS total FROM hist)"""


@query(
    f"""WITH {PIT_BINS}, c AS (SELECT sum(n * n) / (max(total) / 10.0) - max(total) AS chi2_stat FROM hist, tot)
    SELECT bin, bin / 10.0 AS low, (bin + 1) / 10.0 AS high, n, n / total AS observed_freq, CAST(0.1 AS DOUBLE) AS expected_freq, CAST(chi2_stat AS DOUBLE) AS chi2_stat
    FROM hist, tot, c""",
    doubles="low high observed_freq expected_freq chi2_stat",
)
def pit_reliability(spark, sf):
    """PIT histogram with the test statistic (the p-value is checked against closed forms in the tests)."""
    histogram = scoring.pit_histogram(forecasts(spark, sf))
    stat = scoring.pit_chi2(histogram).select("chi2_stat").scalar()
    return histogram.withColumn("chi2_stat", stat)


@query(
    f"""WITH {PIT_BINS}, c AS (SELECT CAST(sum(n * n) / (max(total) / 10.0) - max(total) AS DOUBLE) AS chi2_stat FROM hist, tot)
    SELECT chi2_stat, {base.chi2_tail_9_sql('chi2_stat')} AS chi2_pval FROM c""",
    doubles="chi2_stat chi2_pval",
)
def pit_chi2_pvalue(spark, sf):
    """Statistic and p-value against the closed form for nine degrees of freedom."""
    return scoring.pit_chi2(scoring.pit_histogram(forecasts(spark, sf)))


SPIKES = f"""count(*) FILTER (y > {base.SPIKE}) AS n_spikes, count(*) FILTER (u > {base.SPIKE}) AS n_alerts,
count(*) FILTER (y > {base.SPIKE} AND u > {base.SPIKE}) AS hits"""
RATES = """CASE WHEN n_spikes > 0 THEN hits / n_spikes END AS recall, CASE WHEN n_alerts > 0 THEN hits / n_alerts END AS precision"""
F1 = "CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) END AS f1"


@query(
    f"""WITH {FC}, u AS (SELECT y, {quantile_sql('0.9')} AS u FROM fc), k AS (SELECT {SPIKES} FROM u), r AS (SELECT *, {RATES} FROM k)
    SELECT n_spikes, n_alerts, recall, precision, {F1} FROM r""",
    doubles="recall precision f1",
)
def spike_metrics(spark, sf):
    return scoring.spike_metrics(forecasts(spark, sf), base.SPIKE)


EVALUATED = f"""{MODELS},
ev0 AS (SELECT model, avg(crps) AS crps, avg(ign) AS ign, avg(is_90) AS mis_90, avg(is_50) AS mis_50, count(*) AS n_observations,
  sum(predicted * n_draws) / sum(n_draws) AS mean_predicted, avg(y) AS mean_observed, {SPIKES.replace('u >', 'upper >')},
  ({' + '.join(f"pow(count(*) FILTER (least(floor(pit * 10), 9) = {b}), 2)" for b in range(10))}) / (count(*) / 10.0) - count(*) AS chi2_stat
  FROM scored GROUP BY model),
ev1 AS (SELECT *, {RATES} FROM ev0), evaluated AS (SELECT *, {F1} FROM ev1)"""


@query(f"WITH {EVALUATED} SELECT * EXCLUDE (hits), {base.chi2_tail_9_sql('chi2_stat')} AS chi2_pval FROM evaluated", doubles="crps ign mis_90 mis_50 mean_predicted mean_observed chi2_stat recall precision f1 chi2_pval")
def full_evaluation(spark, sf):
    """Every metric for three models in one pass over the scored rows."""
    scored = scored_models(spark, sf)
    return scoring.full_evaluation(scored, ["model"], base.SPIKE)


@query(f"WITH {base.CAGG} SELECT period, max(civilian_deaths) > 450 AS usable FROM cagg GROUP BY period")
def usable_months(spark, sf):
    """Months in which some entity is positive (shifted so that some months are not)."""
    shifted = base.conflict_agg(spark, sf).withColumn("y", F.col("civilian_deaths") - 450)
    return scoring.usable_periods(shifted)


@query(
    f"""WITH {EVALUATED}, published AS (SELECT period, model, avg(crps) AS crps, avg(ign) AS ign, avg(is_90) AS mis FROM scored GROUP BY period, model),
    bench AS (SELECT model, avg(crps) AS crps, avg(ign) AS ign, avg(mis) AS mis FROM published GROUP BY model)
    SELECT model, crps, ign, mis_90, mis_50, recall AS spike_recall, precision AS spike_precision, f1 AS spike_f1, {base.chi2_tail_9_sql('chi2_stat')} AS calib_chi2_p, n_observations AS n FROM evaluated
    UNION ALL SELECT '[views] ' || model, crps, ign, mis, NULL, NULL, NULL, NULL, NULL, NULL FROM bench""",
    doubles="crps ign mis_90 mis_50 spike_recall spike_precision spike_f1 calib_chi2_p",
)
def compare_models(spark, sf):
    """Own models next to benchmark rows; metrics a benchmark lacks are NULL."""
    scored = base.stored(spark, scored_models(spark, sf), "scored")
    own = scoring.full_evaluation(scored, ["model"], base.SPIKE)
    return scoring.compare_models(own, agg.benchmark_means(published(spark, sf, scored)))


@query(
    f"""WITH {PUBLISHED}, own AS (SELECT period, avg(crps) AS own FROM scored WHERE model = 'history_12' GROUP BY period),
    m AS (SELECT own.period, own, max(p.crps) FILTER (p.model = 'history_6') AS history_6, max(p.crps) FILTER (p.model = 'history_24') AS history_24
          FROM own LEFT JOIN published p ON p.period = own.period GROUP BY own.period, own)
    SELECT * FROM m UNION ALL SELECT 'AVG', avg(own), avg(history_6), avg(history_24) FROM m""",
    doubles="own history_6 history_24",
)
def per_month_comparison(spark, sf):
    scored = base.stored(spark, scored_models(spark, sf), "scored")
    own = scored.filter(F.col("model") == "history_12")
    return scoring.per_month(own, published(spark, sf, scored), ["history_6", "history_24"])


@query(
    f"""WITH {FC}, s AS (SELECT y, {CRPS_SQL} AS crps, {MEAN_SQL} AS predicted, len(list_filter(samples, lambda v: v = 0)) / len(samples) AS pz FROM fc)
    SELECT CASE WHEN y > {base.SPIKE} THEN 'y > 2500' WHEN y > 0 THEN '0 < y <= 2500' ELSE 'y = 0' END AS segment, avg(crps) AS crps, count(*) AS n,
    (SELECT avg(pz) FROM s) AS mean_pzero, (SELECT avg(CASE WHEN y = 0 THEN 1.0 ELSE 0 END) FROM s) AS zero_rate, (SELECT avg(predicted) FROM s) AS mean_predicted,
    (SELECT avg(y) FROM s) AS mean_observed, (SELECT quantile_cont(predicted, 0.5) FROM s) AS median_predicted, (SELECT quantile_cont(y, 0.5) FROM s) AS median_observed
    FROM s GROUP BY 1""",
    doubles="crps mean_pzero zero_rate mean_predicted mean_observed median_predicted median_observed",
)
def segment_diagnostics(spark, sf):
    """Scores by size of the outcome, with overall calibration figures."""
    fc = base.stored(spark, forecasts(spark, sf), "forecasts")
    segments = scoring.segment_scores(scoring.score_rows(fc), base.SPIKE)
    names = ["mean_pzero", "zero_rate", "mean_predicted", "mean_observed", "median_predicted", "median_observed"]
    overall = scoring.calibration_summary(fc).select(F.struct(*names).alias("s")).scalar()
    return segments.select("*", *[overall[n].alias(n) for n in names])


@query(
    f"WITH {FC} SELECT entity, period, y, {MEAN_SQL} AS mean, list_sort(samples)[CAST(floor((len(samples) - 1) / 2) AS BIGINT) + 1] AS median, "
    + ", ".join(f"{quantile_sql(str(q))} AS {n}" for n, q in scoring.SUMMARY_QUANTILES.items())
    + ", len(list_filter(samples, lambda v: v = 0)) / len(samples) AS zero_share FROM fc",
    doubles="y mean median p05 p10 p25 p75 p90 p95 zero_share",
)
def sample_summary(spark, sf):
    return scoring.sample_summary(forecasts(spark, sf))
