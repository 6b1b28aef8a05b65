"""Forecast scores and predictive distributions against closed forms and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.functions import special
from panelloom.operators import distributions, scoring


def table(spark, cases):
    rows = [(str(i), "2024-07", float(y), [float(v) for v in s]) for i, (y, s) in enumerate(cases)]
    return spark.createDataFrame(rows, "entity STRING, period STRING, y DOUBLE, samples ARRAY<DOUBLE>")


CASES = [
    (3, [3] * 6), (4, [3] * 6), (-5, [1, 2, 3, 4]), (99, [1, 2, 3, 4]),
    (12.5, np.random.default_rng(1).gamma(2, 9, 13)), (600, np.random.default_rng(2).gamma(3, 250, 50)),
]


def brute(y, s, exact=False):
    s = np.sort(np.asarray(s, dtype=float))
    n = len(s)
    spread = ((2 * np.arange(n) - n + (1 if exact else 0)) * s).sum() / n**2
    return np.abs(s - y).mean() - spread


def test_crps(spark):
    got = scoring.crps_rows(table(spark, CASES)).orderBy("entity").collect()
    exact = scoring.crps_rows(table(spark, CASES), exact=True).orderBy("entity").collect()
    for r, e, (y, s) in zip(got, exact, CASES):
        assert r["crps"] == pytest.approx(brute(y, s))
        pairs = np.abs(np.subtract.outer(s, s)).mean()
        assert e["crps"] == pytest.approx(np.abs(np.asarray(s) - y).mean() - 0.5 * pairs)


def test_ignorance(spark):
    got = scoring.ignorance_rows(table(spark, CASES)).orderBy("entity").collect()
    assert got[0]["ign"] == 0.0 and got[1]["ign"] == 50.0
    for r, (y, s) in list(zip(got, CASES))[2:]:
        s = np.asarray(s, dtype=float)
        h = (len(s) * 0.75) ** -0.2 * s.std(ddof=1)
        density = np.exp(-0.5 * ((y - s) / h) ** 2).sum() / (len(s) * h * math.sqrt(2 * math.pi))
        assert r["ign"] == pytest.approx(-math.log(max(density, 1e-10)))


def test_intervals_pit_and_summary(spark):
    df = table(spark, CASES)
    iv = scoring.interval_rows(df, 0.1).orderBy("entity").collect()
    pit = scoring.pit_rows(df).orderBy("entity").collect()
    summary = scoring.sample_summary(df).orderBy("entity").collect()
    for a, b, c, (y, s) in zip(iv, pit, summary, CASES):
        lo, hi = np.quantile(s, [0.05, 0.95])
        assert a["interval_score"] == pytest.approx(hi - lo + 20 * (max(lo - y, 0) + max(y - hi, 0)))
        assert b["pit"] == pytest.approx((np.asarray(s) <= y).mean())
        assert c["p90"] == pytest.approx(np.quantile(s, 0.9))
        assert c["median"] == pytest.approx(np.sort(s)[(len(s) - 1) // 2])


def test_pit_histogram_closes_the_last_bin(spark):
    df = table(spark, [(10, [1, 2]), (10, [1, 2]), (0, [1, 2])])
    counts = {r["bin"]: r["n"] for r in scoring.pit_histogram(df).collect()}
    assert counts[9] == 2 and counts[0] == 1 and sum(counts.values()) == 3
    row = scoring.pit_chi2(scoring.pit_histogram(df)).first()
    assert row["chi2_stat"] == pytest.approx(sum((counts[i] - 0.3) ** 2 / 0.3 for i in range(10)))


def test_spikes_without_a_base_are_null(spark):
    row = scoring.spike_metrics(table(spark, [(1, [1, 2]), (2, [3, 4])])).first()
    assert (row["n_spikes"], row["n_alerts"], row["recall"], row["precision"], row["f1"]) == (0, 0, None, None, None)
    row = scoring.spike_metrics(table(spark, [(600, [1, 900]), (700, [1, 2]), (1, [800, 900])])).first()
    assert (row["n_spikes"], row["n_alerts"], row["recall"], row["precision"], row["f1"]) == (2, 2, 0.5, 0.5, 0.5)
    row = scoring.spike_metrics(table(spark, [(600, [1, 2]), (1, [800, 900])])).first()
    assert (row["recall"], row["precision"], row["f1"]) == (0.0, 0.0, None)


def test_full_evaluation_agrees_with_the_single_metrics(spark):
    df = table(spark, CASES)
    row = scoring.full_evaluation(scoring.score_rows(df)).first()
    mis = scoring.mean_interval_scores(df).first()
    assert row["crps"] == pytest.approx(scoring.crps_mean(df).first()["crps"])
    assert (row["mis_90"], row["mis_50"]) == (pytest.approx(mis["mis_90"]), pytest.approx(mis["mis_50"]))
    assert row["mean_predicted"] == pytest.approx(np.concatenate([np.asarray(s, float) for _, s in CASES]).mean())


def test_chi2_tail_closed_forms():
    import pandas as pd

    got = special.chi2_sf(pd.Series([3.0, 16.918977604620448, 0.0]), pd.Series([2, 9, 9]))
    assert got.tolist() == pytest.approx([math.exp(-1.5), 0.05, 1.0])


def test_betainc_closed_forms():
    x = np.linspace(0, 1, 21)
    assert special.betainc(1, 1, x) == pytest.approx(x)
    assert special.betainc(3, 1, x) == pytest.approx(x**3)
    assert special.betainc(2, 2, x) == pytest.approx(x**2 * (3 - 2 * x))
    t = np.array([-30, -2.0, 0.0, 0.7, 12])
    assert special.student_cdf(t, np.full(5, 2.0)) == pytest.approx(0.5 + t / (2 * np.sqrt(2 + t * t)))


def mixture(spark, y):
    return spark.createDataFrame(
        [(str(i), v, 0.3, [0.6, 0.4], [1.0, 5.0], [0.5, 1.0]) for i, v in enumerate(y)],
        "k STRING, y DOUBLE, pi_zero DOUBLE, mix_weights ARRAY<DOUBLE>, mus ARRAY<DOUBLE>, sigmas ARRAY<DOUBLE>",
    )


def test_zilnm(spark):
    df = distributions.zilnm_cdf(distributions.zilnm_logprob(mixture(spark, [0.0, 1.0, 600.0])))
    rows = df.orderBy("k").collect()
    phi = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    for r, y in zip(rows, [0.0, 1.0, 600.0]):
        ly = math.log(max(y, 1e-6))
        dens = sum(w / (y * s * math.sqrt(2 * math.pi)) * math.exp(-0.5 * ((ly - m) / s) ** 2) for w, m, s in ((0.6, 1, 0.5), (0.4, 5, 1.0))) if y else None
        expected = math.log(0.3 + 1e-8) if y == 0 else math.log(0.7 + 1e-8) + math.log(dens)
        assert r["logprob"] == pytest.approx(expected)
        assert r["cdf"] == pytest.approx(0.3 + 0.7 * (0.6 * phi((ly - 1) / 0.5) + 0.4 * phi((ly - 5) / 1)))


def test_zilnm_samples_follow_the_distribution(spark):
    drawn = distributions.zilnm_sample(mixture(spark, [0.0] * 8), ["k"], 4000)
    values = np.concatenate([r["samples"] for r in drawn.collect()])
    assert (values == 0).mean() == pytest.approx(0.3 + 0.7 * 0.6 * 0.5 * math.erfc((1 - math.log(0.5)) / 0.5 / math.sqrt(2)), abs=0.01)
    assert np.median(values[values > 0]) == pytest.approx(np.exp(1.5), rel=0.35)
    again = distributions.zilnm_sample(mixture(spark, [0.0] * 8).repartition(5), ["k"], 4000)
    assert sorted(map(str, again.collect())) == sorted(map(str, drawn.collect()))


def hurdle(spark, y):
    return spark.createDataFrame([(str(i), v, -0.5, 3.0, 0.8, 4.0) for i, v in enumerate(y)],
                                 "k STRING, y DOUBLE, conflict_logit DOUBLE, mu DOUBLE, sigma DOUBLE, nu DOUBLE")


def test_hurdle_t(spark):
    rows = distributions.hurdle_t_cdf(distributions.hurdle_t_logprob(hurdle(spark, [0.0, 20.0]))).orderBy("k").collect()
    gate = 1 / (1 + math.exp(0.5))
    z = (math.log1p(20) - 3) / 0.8
    density = 0.375 * (1 + z * z / 4) ** -2.5 / 0.8
    assert rows[0]["logprob"] == pytest.approx(math.log(1 - gate))
    assert rows[1]["logprob"] == pytest.approx(math.log(gate) + math.log(density))
    t_cdf = 0.5 + 0.375 * z / math.sqrt(1 + z * z / 4) * (1 - z * z / (12 * (1 + z * z / 4)))
    assert rows[1]["cdf"] == pytest.approx(1 - gate + gate * t_cdf)


def test_hurdle_t_samples(spark):
    values = np.concatenate([r["samples"] for r in distributions.hurdle_t_sample(hurdle(spark, [0.0] * 8), ["k"], 4000).collect()])
    gate = 1 / (1 + math.exp(0.5))
    assert (values > 0).mean() == pytest.approx(gate, abs=0.02)
    assert values.max() <= round(math.expm1(15))
    assert np.median(values[values > 0]) == pytest.approx(math.expm1(3), rel=0.1)


def test_losses(spark):
    df = distributions.hurdle_t_logprob(hurdle(spark, [0.0, 20.0, 900.0]))
    lp = [r["logprob"] for r in df.orderBy("k").collect()]
    assert distributions.weighted_nll(df).first()["loss"] == pytest.approx(-(lp[0] + lp[1] + 5 * lp[2]) / 3)
    under = lambda y: 1 + 2 * math.log1p(y) / 13.5
    expected = -(lp[0] + under(20) * lp[1] + under(900) * 5 * lp[2]) / 3
    assert distributions.asymmetric_nll(df).first()["loss"] == pytest.approx(expected)
    none = distributions.hurdle_loss(df.filter(F.col("y") == 0)).first()
    assert none["nll"] == 0.0 and none["loss"] == pytest.approx(none["bce"])


def test_mixtures_of_any_number_of_parts(spark):
    rows = [("a", 3.0, 0.2, [1.0], [1.0], [0.5]), ("b", 3.0, 0.2, [0.25] * 4, [1.0] * 4, [0.5] * 4), ("c", 3.0, None, [1.0], [1.0], [0.5])]
    df = spark.createDataFrame(rows, "k STRING, y DOUBLE, pi_zero DOUBLE, mix_weights ARRAY<DOUBLE>, mus ARRAY<DOUBLE>, sigmas ARRAY<DOUBLE>")
    cdf = {r["k"]: r["cdf"] for r in distributions.zilnm_cdf(df).collect()}
    expected = 0.2 + 0.8 * 0.5 * math.erfc(-(math.log(3) - 1) / 0.5 / math.sqrt(2))
    assert cdf["a"] == pytest.approx(expected, abs=1e-12) == cdf["b"] and cdf["c"] is None
    drawn = {r["k"]: r["samples"] for r in distributions.zilnm_sample(df, ["k"], 50).collect()}
    assert len(drawn["a"]) == len(drawn["b"]) == 50 and drawn["c"] is None


def test_extreme_gates_draw_without_overflow(spark):
    rows = [("off", -800.0, 1.0, 1.0, 2.5), ("on", 800.0, 1.0, 1.0, 2.5), ("none", None, 1.0, 1.0, 2.5)]
    df = spark.createDataFrame(rows, "k STRING, conflict_logit DOUBLE, mu DOUBLE, sigma DOUBLE, nu DOUBLE")
    drawn = {r["k"]: r["samples"] for r in distributions.hurdle_t_sample(df, ["k"], 200).collect()}
    assert set(drawn["off"]) == {0.0} and max(drawn["on"]) > 0 and drawn["none"] is None


def test_special_functions_against_math():
    from panelloom.functions import special

    x = np.linspace(0.02, 60, 3001)
    assert np.allclose(special.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-13)
    x = np.linspace(-8, 8, 3201)
    assert np.allclose(special.erf(x), [math.erf(v) for v in x], rtol=0, atol=1e-14)
    assert np.allclose(special.erfc(x[x >= 0]), [math.erfc(v) for v in x[x >= 0]], rtol=1e-10, atol=0)


def test_registered_samples_draw_as_many_as_the_operators():
    from inspect import signature

    from workload import predictive

    for sample in (distributions.zilnm_sample, distributions.hurdle_t_sample):
        assert predictive.DRAWS == signature(sample).parameters["n"].default
