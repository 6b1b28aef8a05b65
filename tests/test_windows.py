"""Window operators on small hand-made series."""

import math

import pytest
from pyspark.sql import functions as F

from panelloom.functions import scalar
from panelloom.operators import windows as w


def series(spark, values, entity="a"):
    rows = [(entity, f"2020-{i + 1:02d}", None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "entity STRING, period STRING, x DOUBLE")


def column(df, name):
    return [r[name] for r in df.orderBy("entity", "period").collect()]


GAPPY = [None, 1, None, 2, None, None, None, 3, None, None, None, None]


def test_ffill_and_limit(spark):
    df = series(spark, GAPPY)
    assert column(w.ffill(df, ["x"]), "x") == [None, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 3]
    assert column(w.ffill_limit(df, ["x"], 3), "x") == [None, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, None]


def test_lag_counts_rows_and_keeps_entities_apart(spark):
    df = series(spark, [1, 2, 3]).unionByName(series(spark, [7, 8], "b"))
    assert column(w.lag_columns(df, ["x"]), "x") == [None, 1, 2, None, 7]
    assert column(w.lag_columns(df, ["x"], 2), "x") == [None, None, 1, None, None]


def test_lagged_panel_shows_the_month_before(spark):
    df = series(spark, range(10))
    raw = {r["period"]: r["x"] for r in df.collect()}
    shifted = w.lag_columns(df, ["x"]).withColumn("prev", scalar.shift_period(F.col("period"), -1)).collect()
    assert all(r["x"] == raw.get(r["prev"]) for r in shifted)


def test_rolling_std_needs_two_values(spark):
    df = series(spark, [1, None, 3, None, None, 5])
    got = column(df.withColumn("s", w.rolling_std("x", 3, 2)), "s")
    assert got == [None, None, pytest.approx(math.sqrt(2)), None, None, None]


def test_change_flag_with_gaps_and_single_rows(spark):
    rows = [("a", f"2020-0{i}", v) for i, v in enumerate(["a", "a", None, "b", "b", "c"], 1)] + [("z", "2020-01", "q")]
    df = spark.createDataFrame(rows, "entity STRING, period STRING, g STRING")
    # The row after a gap differs from NULL, so it counts as a change.
    assert column(df.withColumn("f", w.change_flag("g")), "f") == [0, 0, None, 1, 0, 1, 0]


def test_periods_since_and_cumulative(spark):
    df = series(spark, [0, 1, 0, 0, 1, 0])
    out = w.cumulative_events(w.periods_since(df, F.col("x") == 1, "since"), "x", "total")
    assert column(out, "since") == [None, 0, 1, 2, 0, 1]
    assert column(out, "total") == [0, 1, 1, 1, 2, 2]


def test_stale_flag_restarts_each_year(spark):
    rows = [("a", f"{y}-{m:02d}", 1.0 if (y, m) in ((2020, 3), (2020, 5)) else 0.0) for y in (2020, 2021) for m in range(1, 7)]
    df = spark.createDataFrame(rows, "entity STRING, period STRING, x DOUBLE")
    assert column(w.stale_flag(df, F.col("x") == 1, "s"), "s") == [0, 0, 0, 1, 1, 1] + [0] * 6


def test_constant_series_has_no_scores(spark):
    df = series(spark, [5] * 8)
    assert column(df.withColumn("z", w.expanding_zscore("x", 6)), "z") == [None] * 5 + [0.0] * 3
    assert set(column(df.withColumn("f", w.entity_outlier_flag("x")), "f")) == {0}
    rolled = w.rolling_target_zscores(w.rolling_target_stats(w.target_lags(df, "x"), "x"))
    assert set(column(rolled, "target_roll3_zscore")) == {None}


def test_rolling_target_stats_use_only_the_past(spark):
    out = w.rolling_target_stats(series(spark, [1, 5, 2, 100]), "x", [3])
    assert column(out, "target_roll3_median") == [None, 1, 3, 2]
    assert column(out, "target_roll3_max") == [None, 1, 5, 5]


def test_spike_counter(spark):
    df = series(spark, [1, 9, 1, 1, 9, 9])
    assert column(w.periods_since_spike(df, "x", 5.0, "s"), "s") == [None, None, 0, 1, 2, 0]


def test_sliding_windows(spark):
    df = series(spark, [0, None, 2, 3, None, 5]).withColumn("y", F.col("x"))
    out = {r["period"]: [s["x"] for s in r["x"]] for r in w.sliding_windows(df, ["x"], "y", 3).collect()}
    assert out == {"2020-04": [0, None, 2], "2020-06": [2, 3, None]}
    padded = w.sliding_windows_padded(df, ["x"], "y", 3)
    assert padded.count() == 3  # a NULL target counts as 0
    short = w.sliding_windows_padded(series(spark, [1, 2]), ["x"], "x", 3)
    assert short.count() == 0
    asked = w.sliding_windows_padded(series(spark, [1, 2]), ["x"], "x", 3, emit_short=True).orderBy("period").collect()
    assert [[s["x"] for s in r["x"]] for r in asked] == [[0, 0, 0], [0, 0, 1]]


def test_pct_change_by_zero_is_null(spark):
    df = series(spark, [0, 2, 3])
    assert column(df.withColumn("c", w.pct_change("x")), "c") == [None, None, 0.5]


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_rolling_walk_equals_the_windows(spark, batch):
    import random

    rng = random.Random(3)
    rows = [(e, f"{d:05d}", rng.choice([None, float(rng.randrange(5)), rng.random() * 1e6])) for e in ["a", "b", None, "c"] for d in range(rng.randrange(1, 90))]
    df = spark.createDataFrame(rows, "entity STRING, period STRING, y DOUBLE").withColumn("n", F.lit(1))
    widths = (1, 5, 60)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        walked = w.rolling_target_stats(df, "y", widths, wide=0)
        got = {(r["entity"], r["period"]): r.asDict() for r in walked.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = w.rolling_target_stats(df, "y", widths, wide=1000).collect()
    assert len(got) == len(want) == len(rows)
    for r in want:
        mine = got[r["entity"], r["period"]]
        for c, v in r.asDict().items():
            assert mine[c] == (v if v is None or isinstance(v, (str, int)) else pytest.approx(v, rel=1e-9, abs=1e-6)), (c, r)


def test_wide_frames_cost_little_more_than_narrow_ones(spark):
    """A daily series of one entity: thirty times the width is far from thirty times the time."""
    import time

    df = spark.range(60_000, numPartitions=1).select(F.lit("a").alias("entity"), F.format_string("%08d", "id").alias("period"), (F.xxhash64("id") % 1000).cast("double").alias("y"))

    def seconds(width):
        run = lambda: w.rolling_walk(df, "y", [width]).write.format("noop").mode("overwrite").save()
        run()
        start = time.perf_counter()
        run()
        return time.perf_counter() - start

    assert seconds(365) < 4 * seconds(12) + 1


def test_rolling_walk_of_no_rows(spark):
    df = spark.createDataFrame([], "entity STRING, period STRING, y DOUBLE")
    assert w.rolling_walk(df, "y", [50]).count() == 0


@pytest.mark.parametrize("batch", ["10000", "3"])
@pytest.mark.parametrize("short", [False, True])
def test_sliding_windows_equal_slices(spark, batch, short):
    import random

    rng = random.Random(6)
    rows = [(e, f"{d:03d}", rng.choice([None, 1.5, 2.5]), rng.randrange(9), rng.choice([None, 0.0, 1.0])) for e in ["a", "b", None, "c"] for d in range(rng.randrange(1, 25))]
    df = spark.createDataFrame(rows, "entity STRING, period STRING, f DOUBLE, g INT, y DOUBLE")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        plain = w.sliding_windows(df, ["f", "g"], "y", 4).collect()
        padded = w.sliding_windows_padded(df, ["f", "g"], "y", 4, start="002", end="015", emit_short=short).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want, want_padded = {}, {}
    for e in ["a", "b", None, "c"]:
        own = [x[1:] for x in rows if x[0] == e]
        for i, (period, _, _, y) in enumerate(own):
            x = [(f, g) for _, f, g, _ in own[max(0, i - 4) : i]]
            if i >= 4 and y is not None:
                want[e, period] = (x, math.expm1(y))
            if "002" <= period <= "015" and (i >= 4 or short):
                want_padded[e, period] = ([(0.0, 0)] * (4 - len(x)) + x, math.expm1(y or 0.0))
    for got, expected in ((plain, want), (padded, want_padded)):
        mine = {(r["entity"], r["period"]): ([tuple(c) for c in r["x"]], r["y"]) for r in got}
        assert len(got) == len(mine) and mine == expected
