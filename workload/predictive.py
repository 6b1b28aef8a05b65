"""Predictive distributions and losses over a parameter table derived from the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators import distributions
from workload import base
from workload.base import PANEL, conflict_panel, query

KEYS = ["entity", "period"]


def mixture(spark, sf):
    """Zero-inflated log-normal mixtures: weights from event types, locations from monthly totals."""
    p = conflict_panel(spark, sf)
    n = F.col("event_count")
    weights = [(F.col(c) + 1) / (n + 3) for c in ("state_based_events", "non_state_events", "one_sided_events")]
    level = F.log1p("fatalities_best")
    return p.select(
        *KEYS,
        F.round("civilian_deaths").alias("y"),
        (1 / (1 + n)).alias("pi_zero"),
        F.array(*weights).alias("mix_weights"),
        F.array(level / 2, level * 0.7, level * 0.9).alias("mus"),
        F.array(F.lit(0.5), F.lit(1.0), 1 + 1 / (n + 1)).alias("sigmas"),
    )


MIX = f"""{PANEL}, mix AS (SELECT entity, period, round(civilian_deaths) AS y, 1 / (1 + event_count) AS pi_zero,
  [(state_based_events + 1) / (event_count + 3), (non_state_events + 1) / (event_count + 3), (one_sided_events + 1) / (event_count + 3)] AS w,
  [ln(1 + fatalities_best) / 2, ln(1 + fatalities_best) * 0.7, ln(1 + fatalities_best) * 0.9] AS mus,
  [0.5, 1.0, 1 + 1 / (event_count + 1)] AS sigmas, ln(greatest(round(civilian_deaths), 1e-6)) AS ly FROM panel)"""
PART = "w[{i}] / sigmas[{i}] / sqrt(2 * pi()) * exp(-0.5 * pow((ly - mus[{i}]) / sigmas[{i}], 2) - ly)"
MIX_LP = f"""{MIX}, lp AS (SELECT *, CASE WHEN y = 0 THEN ln(pi_zero + 1e-8)
  ELSE ln(1 - pi_zero + 1e-8) + ln({' + '.join(PART.replace('{i}', str(i)) for i in (1, 2, 3))}) END AS logprob FROM mix)"""


@query(f"WITH {MIX_LP} SELECT entity, period, y, logprob FROM lp", doubles="y logprob")
def zilnm_logprob(spark, sf):
    return distributions.zilnm_logprob(mixture(spark, sf)).select(*KEYS, "y", "logprob")


Z = [f"((ly - mus[{i}]) / sigmas[{i}])" for i in (1, 2, 3)]
PHI = [f"w[{i}] * 0.5 * (1 + ({base.erf_sql(f'(z{i} / sqrt(2))')}))" for i in (1, 2, 3)]


@query(
    f"""WITH {MIX}, zs AS (SELECT *, {', '.join(f'{z} AS z{i}' for i, z in enumerate(Z, 1))} FROM mix)
    SELECT entity, period, least(greatest(pi_zero + (1 - pi_zero) * ({' + '.join(PHI)}), 0), 1) AS cdf FROM zs""",
    doubles="cdf",
)
def zilnm_cdf(spark, sf):
    return distributions.zilnm_cdf(mixture(spark, sf)).select(*KEYS, "cdf")


DRAWS = 1000


ROW = "'42|' || entity || '|' || period"


def _draws_sql(source: str) -> str:
    """Four numbers in (0, 1) for every draw of every row."""
    return f"""d0 AS (SELECT *, {base.keyed_sql(1, ROW)} AS key, {base.keyed_sql(9, ROW)} AS counter FROM {source}),
    d AS (SELECT *, unnest(range(0, {DRAWS})) AS i FROM d0),
    {base.philox_sql('d', 'key', '2 * i', 'counter', ('gate', 'choice'), 'one')},
    {base.philox_sql('one', 'key', '2 * i + 1', 'counter', ('radius', 'angle'), 'u')}"""


def _digest_sql(draws: str) -> str:
    return f"""SELECT entity, period, count(*)::INTEGER AS n, (count(*) FILTER (v = 0))::INTEGER AS n_zero, max(v) AS "max", sum(v) / count(*) AS mean
      FROM ({draws}) GROUP BY entity, period"""


# The alias table of three parts: the smallest column, the largest other one, then the smaller of what is left.
ALIAS = """a0 AS (SELECT *, list_transform(w, lambda v: v * 3 / (w[1] + w[2] + w[3])) AS q FROM mix),
    a1 AS (SELECT *, list_position(q, list_min(q)) AS s FROM a0),
    a2 AS (SELECT *, list_transform(q, lambda v, i: CASE WHEN i = s THEN -1.0 ELSE v END) AS rest FROM a1),
    a3 AS (SELECT *, list_position(rest, list_max(rest)) AS l FROM a2),
    a4 AS (SELECT *, 6 - s - l AS m, q[l] + q[s] - 1 AS ql FROM a3),
    a5 AS (SELECT *, CASE WHEN ql < q[m] OR (ql = q[m] AND l < m) THEN l ELSE m END AS s2, least(ql, q[m]) AS q2 FROM a4),
    alias AS (SELECT entity, period, pi_zero, mus, sigmas,
      list_transform([1, 2, 3], lambda c: CASE c WHEN s THEN q[s] WHEN s2 THEN q2 ELSE 1.0 END) AS share,
      list_transform([1, 2, 3], lambda c: CASE c WHEN s THEN l WHEN s2 THEN l + m - s2 ELSE c END) AS other FROM a5)"""


@query(
    f"""WITH {MIX}, {ALIAS}, {_draws_sql('alias')},
    c AS (SELECT *, least(floor(choice * 3)::INTEGER, 2) + 1 AS col, sqrt(-2 * ln(radius)) * cos(2 * pi() * angle) AS score FROM u),
    k AS (SELECT *, CASE WHEN choice * 3 - (col - 1) < share[col] THEN col ELSE other[col] END AS part FROM c)
    {_digest_sql("SELECT entity, period, CASE WHEN gate >= pi_zero THEN round_even(exp(mus[part] + sigmas[part] * score), 0) ELSE 0.0 END AS v FROM k")}""",
    doubles="max mean",
)
def zilnm_sample(spark, sf):
    """Draws per month, summarised per row."""
    drawn = distributions.zilnm_sample(mixture(spark, sf), KEYS, DRAWS)
    return _digest(drawn)


def _digest(drawn):
    total = F.aggregate("samples", F.lit(0.0), lambda acc, v: acc + v)
    zeros = F.aggregate("samples", F.lit(0), lambda acc, v: acc + (v == 0).cast("int"))
    return drawn.select(*KEYS, F.size("samples").alias("n"), zeros.alias("n_zero"), F.array_max("samples").alias("max"), (total / F.size("samples")).alias("mean"))


def hurdle(spark, sf):
    """Hurdle Student t parameters; two or four degrees of freedom have closed distribution functions."""
    n = F.col("event_count")
    return conflict_panel(spark, sf).select(
        *KEYS,
        F.round("civilian_deaths").alias("y"),
        F.log((n + 1) / 3).alias("conflict_logit"),
        (F.log1p("fatalities_best") * 0.8).alias("mu"),
        (0.5 + 1 / (n + 1)).alias("sigma"),
        F.when(F.col("state_based_events") > F.col("non_state_events"), 2.0).otherwise(4.0).alias("nu"),
    )


HURDLE = f"""{PANEL}, h0 AS (SELECT entity, period, round(civilian_deaths) AS y, ln((event_count + 1) / 3) AS g, ln(1 + fatalities_best) * 0.8 AS mu,
  0.5 + 1 / (event_count + 1) AS sigma, CASE WHEN state_based_events > non_state_events THEN 2.0 ELSE 4.0 END AS nu FROM panel),
h1 AS (SELECT *, (ln(1 + greatest(y, 0)) - mu) / sigma AS z FROM h0),
h AS (SELECT *, lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * ln(nu * pi()) - ln(sigma) - (nu + 1) / 2 * ln(1 + z * z / nu) AS part,
      -ln(1 + exp(-g)) AS ls, -ln(1 + exp(g)) AS ln_not FROM h1),
hp AS (SELECT *, CASE WHEN y = 0 THEN ln_not ELSE ls + part END AS logprob FROM h)"""


@query(f"WITH {HURDLE} SELECT entity, period, y, logprob FROM hp", doubles="y logprob")
def hurdle_t_logprob(spark, sf):
    return distributions.hurdle_t_logprob(hurdle(spark, sf)).select(*KEYS, "y", "logprob")


@query(
    f"""WITH {HURDLE}, c AS (SELECT *, CASE WHEN nu = 2 THEN 0.5 + z / (2 * sqrt(2 + z * z))
      ELSE 0.5 + 0.375 * z / sqrt(1 + z * z / 4) * (1 - z * z / (12 * (1 + z * z / 4))) END AS tc FROM h)
    SELECT entity, period, least(greatest(1 / (1 + exp(g)) + (1 - 1 / (1 + exp(g))) * tc, 0), 1) AS cdf FROM c""",
    doubles="cdf",
)
def hurdle_t_cdf(spark, sf):
    return distributions.hurdle_t_cdf(hurdle(spark, sf)).select(*KEYS, "cdf")


@query(
    f"""WITH {HURDLE}, {_draws_sql('h0')},
    s AS (SELECT *, sqrt(nu * (pow(radius, -2 / nu) - 1)) * cos(2 * pi() * angle) AS score FROM u)
    {_digest_sql("SELECT entity, period, CASE WHEN gate < 1 / (1 + exp(-g)) THEN round_even(greatest(exp(least(mu + sigma * score, 15.0)) - 1, 0), 0) ELSE 0.0 END AS v FROM s")}""",
    doubles="max mean",
)
def hurdle_t_sample(spark, sf):
    """Draws per month, summarised per row."""
    return _digest(distributions.hurdle_t_sample(hurdle(spark, sf), KEYS, DRAWS))


@query(
    f"WITH {MIX_LP} SELECT avg(-logprob * CASE WHEN y > 500 THEN 5 ELSE 1 END) AS loss, avg(logprob) AS mean_log_prob FROM lp",
    doubles="loss mean_log_prob",
)
def weighted_nll(spark, sf):
    return distributions.weighted_nll(distributions.zilnm_logprob(mixture(spark, sf)))


@query(
    f"""WITH {HURDLE} SELECT avg(-logprob * CASE WHEN ln(1 + greatest(y, 0)) - mu > 0 AND y > 0 THEN 1 + 2 * ln(1 + y) / 13.5 ELSE 1 END
      * CASE WHEN y > 500 THEN 5 ELSE 1 END) AS loss, avg(logprob) AS mean_log_prob FROM hp""",
    doubles="loss mean_log_prob",
)
def asymmetric_nll(spark, sf):
    return distributions.asymmetric_nll(distributions.hurdle_t_logprob(hurdle(spark, sf)))


@query(
    f"""WITH {HURDLE}, l AS (SELECT avg(CASE WHEN y > 0 THEN -5.1 * ls ELSE -ln_not END) AS bce, coalesce(avg(-part) FILTER (y > 0.5), 0) AS nll FROM hp)
    SELECT bce + nll AS loss, bce, nll FROM l""",
    doubles="loss bce nll",
)
def hurdle_loss(spark, sf):
    return distributions.hurdle_loss(hurdle(spark, sf))
