"""The counter-based generator and the samplers that use it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.functions import draws
from panelloom.operators import distributions


def test_philox_gives_the_published_numbers():
    one = lambda key, a, b: tuple(int(x[0]) for x in draws.philox(np.array([key]), np.array([a]), np.array([b])))
    assert one(0, 0, 0) == (0xFF1DAE59, 0x6CD10DF2)
    assert one(0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFF) == (0x2C3F628B, 0xAB4FD7AD)
    assert one(0x13198A2E, 0x243F6A88, 0x85A308D3) == (0xDD7CE038, 0xF62A4C12)


def test_uniforms_are_even_and_unrelated():
    u, v = draws.uniforms(np.array([[7]]), np.arange(200_000), np.array([[3]]))
    for x in (u.ravel(), v.ravel()):
        counts = np.histogram(x, 100, (0, 1))[0]
        assert ((counts - 2000) ** 2 / 2000).sum() < 160  # 99 degrees of freedom
        assert abs(np.corrcoef(x[1:], x[:-1])[0, 1]) < 0.01
    assert abs(np.corrcoef(u.ravel(), v.ravel())[0, 1]) < 0.01
    other = draws.uniforms(np.array([[8]]), np.arange(200_000), np.array([[3]]))[0]
    assert abs(np.corrcoef(u.ravel(), other.ravel())[0, 1]) < 0.01


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_alias_tables_hold_the_weights(k):
    rng = np.random.default_rng(k)
    weights = rng.random((50, k)) * rng.integers(0, 2, (50, k))
    weights[:, 0] += 0.1
    weights[0] = 1.0
    share, other = draws.alias_table(weights)
    mass = np.zeros_like(weights)
    for r in range(50):
        for c in range(k):
            mass[r, c] += share[r, c]
            mass[r, other[r, c]] += 1 - share[r, c]
    assert np.allclose(mass / k, weights / weights.sum(1, keepdims=True), atol=1e-12)
    parts = draws.alias_draw(share, other, (np.arange(10_000)[None, :] + 0.5) / 10_000 * np.ones((50, 1)))
    got = np.stack([np.bincount(p, minlength=k) / 10_000 for p in parts])
    assert np.allclose(got, weights / weights.sum(1, keepdims=True), atol=0.002)


def test_mixture_parts_and_scores(spark):
    rows = [(str(i), 0.25, [0.2, 0.5, 0.3], [0.0, 5.0, 10.0], [1e-9] * 3) for i in range(20)]
    df = spark.createDataFrame(rows, "k STRING, pi_zero DOUBLE, mix_weights ARRAY<DOUBLE>, mus ARRAY<DOUBLE>, sigmas ARRAY<DOUBLE>")
    values = np.concatenate([r["samples"] for r in distributions.zilnm_sample(df, ["k"], 5000).collect()])
    expected = {0.0: 0.25, 1.0: 0.15, float(np.rint(np.exp(5))): 0.375, float(np.rint(np.exp(10))): 0.225}
    found, counts = np.unique(values, return_counts=True)
    assert set(found) == set(expected)
    assert all(abs(c / len(values) - expected[v]) < 0.006 for v, c in zip(found, counts))
    assert len({tuple(r["samples"][:50]) for r in distributions.zilnm_sample(df, ["k"], 50).collect()}) == 20  # rows draw apart
    more = {r["k"]: r["samples"] for r in distributions.zilnm_sample(df, ["k"], 60).collect()}
    fewer = {r["k"]: r["samples"] for r in distributions.zilnm_sample(df, ["k"], 20).collect()}
    assert all(more[k][:20] == fewer[k] for k in more)
    assert distributions.zilnm_sample(df, ["k"], 60, seed=1).first()["samples"] != more["0"]


def test_student_scores_have_their_tails(spark):
    rows = [(str(i), 800.0, 5.0, 0.5, 3.0) for i in range(10)]
    df = spark.createDataFrame(rows, "k STRING, conflict_logit DOUBLE, mu DOUBLE, sigma DOUBLE, nu DOUBLE")
    values = np.concatenate([r["samples"] for r in distributions.hurdle_t_sample(df, ["k"], 20_000).collect()])
    z = (np.log1p(values) - 5) / 0.5
    # Published quantiles of Student's t with three degrees of freedom.
    for p, q in ((0.75, 0.765), (0.9, 1.638), (0.975, 3.182), (0.995, 5.841)):
        assert (z <= q).mean() == pytest.approx(p, abs=0.004)


def test_odd_parameters_give_no_samples(spark):
    rows = [("a", 0.1, [0.0, 0.0], [1.0, 1.0], [1.0, 1.0]), ("b", 0.1, [], [], []), ("c", 0.1, [1.0], [1.0, 2.0], [1.0]), ("d", 0.1, None, [1.0], [1.0]),
            ("e", 0.1, [1.0, None], [1.0, 1.0], [1.0, 1.0]), ("f", 0.1, [1.0, 0.0], [1.0, 1.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "k STRING, pi_zero DOUBLE, mix_weights ARRAY<DOUBLE>, mus ARRAY<DOUBLE>, sigmas ARRAY<DOUBLE>")
    got = {r["k"]: r["samples"] for r in distributions.zilnm_sample(df.withColumn("samples", F.lit(1)), ["k"], 9).collect()}
    assert [k for k, v in sorted(got.items()) if v is None] == list("abcde") and len(got["f"]) == 9
    whole = df.select("k", F.lit(1).alias("pi_zero"), F.array(F.lit(1)).alias("mix_weights"), F.array(F.lit(1)).alias("mus"), F.array(F.lit(1)).alias("sigmas"))
    assert set(distributions.zilnm_sample(whole, ["k"], 5).first()["samples"]) == {0.0}
