"""Exact quantiles, ranks, moments and resampling against brute force, with hot values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.functions import moments
from panelloom.operators import preprocess, profile, quantiles


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    n = 3000
    x = np.where(rng.random(n) < 0.4, 0.0, rng.lognormal(3, 2, n))  # a value with a third of the rows
    y = rng.integers(0, 12, n).astype(float)
    z = rng.normal(size=n)
    z[rng.random(n) < 0.2] = np.nan
    return pd.DataFrame({"k": np.arange(n), "x": x, "y": y, "z": z})


@pytest.fixture(scope="module")
def frame(spark, data):
    df = spark.createDataFrame(data)
    return df.withColumn("z", F.when(~F.isnan("z"), F.col("z")))


PROBS = {"p0": 0.0, "p01": 0.01, "p50": 0.5, "p995": 0.995, "p100": 1.0}


def check_quantiles(got, data):
    rows = got.collect()
    assert {r["feature"] for r in rows} == {"x", "y", "z"}
    for r in rows:
        values = data[r["feature"]].dropna()
        for name, p in PROBS.items():
            assert r[name] == pytest.approx(values.quantile(p), abs=1e-12), (r["feature"], name)


# Direct, bracketed, bracketed with values of many buckets, and brackets so narrow that ranks are missed.
@pytest.mark.parametrize("limit,bucket,accuracy", [(10**6, 10**6, 10**4), (5, 10**6, 10**3), (5, 20, 200), (5, 20, 10), (5, 10**6, 10**9)])
def test_quantiles_on_all_routes(frame, data, limit, bucket, accuracy):
    check_quantiles(quantiles.quantiles(frame, ["x", "y", "z"], PROBS, direct_limit=limit, per_bucket=bucket, accuracy=accuracy), data)


def test_missed_ranks_are_counted_in_full(frame, data, monkeypatch):
    real = quantiles.brackets

    def beside(*args):
        return {c: (n, [(v[0][0], v[0][0])] if c == "z" else v) for c, (n, v) in real(*args).items()}

    monkeypatch.setattr(quantiles, "brackets", beside)
    check_quantiles(quantiles.quantiles(frame, ["x", "y", "z"], PROBS, direct_limit=5), data)


def test_only_bracketed_values_are_shuffled(spark):
    """A hundred thousand different values: the exchange carries those near the wanted ranks and one row a gap and task."""
    df = spark.range(100_000, numPartitions=4).select((F.xxhash64("id") / 1e9).alias("v"), F.lit(None).cast("double").alias("none"))
    found = quantiles.brackets(df, ["v", "none"], [0.25, 0.5], 1000)
    counts = quantiles.bracketed_counts(df, found)
    assert counts.where("gap").count() == 3
    assert 400 <= counts.where("NOT gap").count() <= 2000 and counts.agg(F.sum("n")).first()[0] == 100_000
    got = quantiles.quantiles(df, ["v", "none"], {"a": 0.25, "b": 0.5}, direct_limit=0, accuracy=1000).collect()
    values = np.array([r[0] for r in df.select("v").collect()])
    assert len(got) == 1 and got[0]["a"] == np.quantile(values, 0.25) and got[0]["b"] == np.quantile(values, 0.5)


def test_quantiles_of_no_rows(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert quantiles.quantiles(df, ["a", "b"], {"m": 0.5}).collect() == []
    assert quantiles.quantiles(df, ["a", "b"], {"m": 0.5}, direct_limit=-1).collect() == []


@pytest.mark.parametrize("partitions", [None, 1, 7, 40])
def test_average_ranks_with_ties_across_partitions(frame, data, partitions):
    # 40 % of x are one value, so it fills many of 40 partitions; y has 12 values.
    got = quantiles.average_ranks(frame.repartition(5), ["k"], ["x", "y", "z"], partitions)
    mine = got.toPandas().set_index("k").sort_index()
    expected = data.set_index("k")[["x", "y", "z"]].rank()
    pd.testing.assert_frame_equal(mine[["x", "y", "z"]].astype(float), expected, check_index_type=False)


def test_tie_runs_do_not_depend_on_batches(spark, frame, data):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "3", "100"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            mine = quantiles.average_ranks(frame.limit(500), ["k"], ["x", "y", "z"], 6).toPandas().set_index("k").sort_index()
            expected = data.head(500).set_index("k")[["x", "y", "z"]].rank()
            pd.testing.assert_frame_equal(mine.astype(float), expected, check_index_type=False)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_ranks_of_zeros_constants_and_columns_without_values(spark):
    rows = [(1, 0.0, 5.0, None), (2, -0.0, 5.0, None), (3, -1.0, 5.0, None), (4, None, None, None)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double")
    got = {r["k"]: tuple(r)[1:] for r in quantiles.average_ranks(df, ["k"], ["a", "b", "c"], 3).collect()}
    assert got == {1: (2.5, 2.0, None), 2: (2.5, 2.0, None), 3: (1.0, 2.0, None)}


def test_ranks_travel_through_one_exchange_and_one_pivot(frame):
    ranks, _ = quantiles.ranked_rows(frame, ["k"], ["x", "y", "z"], 7)
    plan = ranks._jdf.queryExecution().executedPlan().toString()
    # What reads the stored rows joins border values by broadcast only.
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_spearman(frame, data):
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in profile.spearman_pairs(frame, ["x", "y", "z"], ["k"], None).collect()}
    # Ranks are over each column's own values, then aligned by key.
    expected = data[["x", "y", "z"]].rank().corr()
    for (a, b), r in got.items():
        assert r == pytest.approx(expected.loc[a, b], abs=1e-9)


def test_adjusted_moments(frame, data):
    row = frame.agg(*[f(F.col(c)).alias(f"{c}_{n}") for c in "xyz" for n, f in (("s", moments.skew), ("k", moments.excess_kurtosis))]).first()
    for c in "xyz":
        assert row[f"{c}_s"] == pytest.approx(data[c].skew())
        assert row[f"{c}_k"] == pytest.approx(data[c].kurt())


def test_constant_column_moments_are_zero(spark):
    row = spark.range(10).select(F.lit(2.0).alias("c")).agg(moments.skew(F.col("c")).alias("s"), moments.excess_kurtosis(F.col("c")).alias("k")).first()
    assert (row["s"], row["k"]) == (0.0, 0.0)


def test_histogram_matches_numpy(frame, data):
    got = {r["bin"]: r["n"] for r in profile.histogram(frame, ["z"], 20).collect()}
    expected, _ = np.histogram(data["z"].dropna(), bins=20)
    assert [got.get(i, 0) for i in range(20)] == expected.tolist()


def test_resample_is_proportional_and_stable(spark):
    df = spark.range(20000).withColumn("w", F.when(F.col("id") % 10 == 0, 10.0).otherwise(1.0))
    drawn = preprocess.weighted_resample(df, "w", ["id"])
    n = drawn.count()
    assert n == 20000
    share = drawn.filter("id % 10 = 0").count() / n
    assert share == pytest.approx(10 / 19, abs=0.02)
    again = preprocess.weighted_resample(df.repartition(7), "w", ["id"])
    assert again.groupBy().agg(F.sum("id")).first() == drawn.groupBy().agg(F.sum("id")).first()


def test_redundancy_prune_follows_the_greedy_walk(spark, data):
    rng = np.random.default_rng(5)
    base = rng.normal(size=400)
    pdf = pd.DataFrame({"a": base, "b": base + rng.normal(size=400) * 0.05, "c": base + rng.normal(size=400) * 0.01, "d": rng.normal(size=400)})
    pdf["y"] = pdf["b"] + rng.normal(size=400) * 0.01
    names = ["a", "b", "c", "d"]
    corr, strength = pdf[names].corr().abs(), pdf[names].corrwith(pdf["y"]).abs()
    gone = set()
    for i, p in enumerate(names):
        if p in gone:
            continue
        for q in names[i + 1 :]:
            if q not in gone and corr.loc[p, q] > 0.9:
                gone.add(q if strength[p] >= strength[q] else p)
    kept, dropped = preprocess.redundancy_prune(spark.createDataFrame(pdf), names, "y")
    assert kept == [c for c in names if c not in gone]
    assert {d[0] for d in dropped} == gone


def test_drop_constant_and_scaling(spark):
    rows = [("a", f"2020-{m:02d}", 5.0 if m < 7 else 9.0, float(m)) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "entity STRING, period STRING, c DOUBLE, x DOUBLE")
    assert "c" not in preprocess.drop_constant(df, ["c", "x"], "2020-06").columns
    scaled = preprocess.zscore_train(df, ["x"], "2020-06").filter("period <= '2020-06'")
    row = scaled.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).first()
    assert row["m"] == pytest.approx(0) and row["s"] == pytest.approx(1)


def test_correlation_with_a_constant_is_null(spark):
    df = spark.range(30).select(F.col("id").cast("double").alias("a"), F.lit(2.0).alias("c"), (F.col("id") * 3.0).alias("b"))
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in profile.pearson_pairs(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == pytest.approx(1.0) and got[("a", "c")] is None and got[("b", "c")] is None


def test_resample_of_a_heavy_row_has_the_exact_size(spark):
    df = spark.range(1000).withColumn("w", F.when(F.col("id") == 7, 5000.0).otherwise(1.0))
    for direct in (1 << 20, 5):  # draws one by one, and by conditional binomials
        drawn = preprocess.weighted_resample(df, "w", ["id"], n=6000, direct=direct)
        copies = {r["id"]: r["count"] for r in drawn.groupBy("id").count().collect()}
        assert sum(copies.values()) == 6000
        assert abs(copies[7] - 6000 * 5000 / 5999) < 5 * (6000 * 5000 / 5999 * 999 / 5999) ** 0.5


@pytest.mark.parametrize("direct", [1 << 20, 20])
def test_resample_counts_vary_like_independent_draws(spark, direct):
    """Counts over many seeds have the multinomial mean, variance and covariance; equally spaced draws have almost none."""
    weights = np.array([1.0, 2.0, 3.0, 4.0, 0.0, 10.0, 1.0, 1.0, 5.0, 3.0] * 4)
    df = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "id int, w double").coalesce(1).persist()
    n, seeds = 400, 16
    tables = [preprocess.weighted_resample(df, "w", ["id"], n=n, seed=s, direct=direct).select(F.lit(s).alias("s"), "id") for s in range(seeds)]
    from functools import reduce

    rows = reduce(lambda a, b: a.unionByName(b), tables).groupBy("s", "id").count().collect()
    df.unpersist()
    counts = np.zeros((seeds, len(weights)))
    for r in rows:
        counts[r["s"], r["id"]] = r["count"]
    p = weights / weights.sum()
    assert (counts.sum(axis=1) == n).all() and not counts[:, weights == 0].any()
    held = p > 0
    chi = ((counts[:, held] - n * p[held]) ** 2 / (n * p[held])).sum(axis=1)
    free = held.sum() - 1
    # The mean of 16 statistics with `free` degrees of freedom; systematic draws stay near 0.
    assert abs(chi.mean() - free) < 4 * (2 * free / seeds) ** 0.5
    total = counts.sum(axis=0)
    assert ((total[held] - n * seeds * p[held]) ** 2 / (n * seeds * p[held])).sum() < free + 5 * (2 * free) ** 0.5
    halves = counts[:, :20].sum(axis=1)
    q = p[:20].sum()
    assert 0.2 < halves.var() / (n * q * (1 - q)) < 3


def test_resample_of_odd_weights(spark):
    df = spark.createDataFrame([(1, None), (2, -3.0), (3, 0.0), (4, 2.0), (5, float(1))], "id int, w double").withColumns({"draws": F.lit(1), "n": F.lit(2)})
    got = [tuple(r) for r in preprocess.weighted_resample(df, "w", ["id"], n=50).collect()]
    assert len(got) == 50 and {g[0] for g in got} == {4, 5}
    assert preprocess.weighted_resample(df.where("id < 4"), "w", ["id"]).count() == 0
    assert preprocess.weighted_resample(df.where("id > 9"), "w", ["id"]).count() == 0


def test_split_draws_in_pieces_equals_the_whole():
    from panelloom.functions import draws

    weights = np.array([0.0, 1.0, 2.5, 0.0, 4.0, 0.0])
    whole = draws.split_draws(1000, weights, 11, 12)
    pieces = sum(draws.split_draws(250, weights, 11, 12, first=at) for at in range(0, 1000, 250))
    assert (whole == pieces).all() and whole.sum() == 1000 and not whole[[0, 3, 5]].any()
    u = draws.stream(11, 12, np.arange(100_000))
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.005 and len(np.unique(u)) == 100_000
    # Counters beyond 32 bits continue in the second word.
    assert draws.stream(11, 12, np.array([1 << 32]))[0] == draws.stream(11, 13, np.array([0]))[0]


def test_pair_correlation_at_panel_width(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2000, 76)) @ rng.normal(size=(76, 76)) + 1e3
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 5] = 4.2
    names = [f"f{i}" for i in range(76)]
    pdf = pd.DataFrame(x, columns=names)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{n} double" for n in names)).repartition(5)
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in profile.pearson_pairs(df, names).collect()}
    expected = pdf.corr().to_numpy()
    assert len(got) == 76 * 75 // 2
    for i in range(76):
        for j in range(i + 1, 76):
            r = got[names[i], names[j]]
            assert r is None if 5 in (i, j) else r == pytest.approx(expected[i, j], abs=1e-9)


def test_deviation_merges_from_partial_rows(spark):
    from panelloom.operators import aggregates as agg

    df = spark.range(500).select((F.col("id") % 20).cast("string").alias("c"), F.lit("2020-01").alias("period"), (F.rand(3) * 5 + 100).alias("v")).persist()
    walk = spark.createDataFrame([("x", str(i), "ab"[i % 2]) for i in range(20)], "code_system STRING, code STRING, entity STRING")
    measures = [agg.Measure("s", "std", F.col("v"))]
    one, two = ({r["entity"]: r["s"] for r in agg.by_entity(df, "c", measures, walk, small=small).collect()} for small in (True, False))
    df.unpersist()
    assert one.keys() == two.keys() and all(two[k] == pytest.approx(one[k], rel=1e-9) for k in one)


def test_any_number_of_labels(spark):
    from panelloom.operators import features

    df = spark.range(1500).select(F.concat(F.lit("l"), "id").alias("c"), F.lit("e").alias("entity"), F.lit("p").alias("period"))
    assert len(features.one_hot_open(df, "c", "x").columns) == 1503
    assert features.one_hot_long(df, "c").count() == 1500


def test_one_hot_refuses_too_many_labels(spark, monkeypatch):
    from panelloom.operators import features

    monkeypatch.setattr(features, "MOST_LABELS", 5, raising=False)
    df = spark.range(6).selectExpr("CAST(id AS STRING) AS c")
    assert len(features.one_hot_open(df.where("c <> '0'"), "c", "x").columns) == 6
    with pytest.raises(ValueError, match="one_hot_long"):
        features.one_hot_open(df, "c", "x")
