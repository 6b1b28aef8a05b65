"""Blocked histories against the window operators, with blocks of a few rows forced."""

import random

import pytest
from pyspark.sql import functions as F

from panelloom.operators import longhistory as lh
from panelloom.operators import windows as w


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(4)
    rows = []
    for e, n in (("hot", 1000), ("b", 3), (None, 40), ("d", 1), ("none", 30)):
        for i in range(n):
            known = e != "none" and rng.random() < 0.8
            rows.append((e, f"{i:05d}", 1e6 + rng.random() * 10 if known else None, None if rng.random() < 0.1 or e == "none" else int(rng.random() < 0.03)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "entity STRING, period STRING, x DOUBLE, event INT")


def same(mine, theirs, name):
    a = {(r["entity"], r["period"]): r[name] for r in mine.collect()}
    b = {(r["entity"], r["period"]): r[name] for r in theirs.collect()}
    assert len(a) == len(b) and a.keys() == b.keys()
    for k, v in b.items():
        assert a[k] == (v if v is None else pytest.approx(v, rel=1e-7, abs=1e-7)), (k, a[k], v)


@pytest.mark.parametrize("blocks", [20, 1, None])
def test_blocked_histories_equal_the_windows(series, blocks):
    rows = lh.in_blocks(series, blocks)
    if blocks == 20:
        assert rows.where("entity = 'hot'").select(lh.BLOCK).distinct().count() > 10
    same(lh.ffill(rows, ["x", "event"]), w.ffill(series, ["x", "event"]), "x")
    same(lh.ffill(rows, ["x", "event"]), w.ffill(series, ["x", "event"]), "event")
    same(lh.cumulative_events(rows, "event", "c"), w.cumulative_events(series, "event", "c"), "c")
    same(lh.periods_since(rows, F.col("event") == 1, "p"), w.periods_since(series, F.col("event") == 1, "p"), "p")
    same(lh.expanding_zscore(rows, "x", "z"), series.withColumn("z", w.expanding_zscore("x")), "z")


def test_blocked_histories_keep_columns_and_take_no_rows(spark, series):
    rows = lh.in_blocks(series, 5)
    for out in (lh.ffill(rows, ["x"]), lh.cumulative_events(rows, "event", "c"), lh.periods_since(rows, F.col("event") == 1, "p"), lh.expanding_zscore(rows, "x", "z")):
        assert [c for c in out.columns if c.startswith("_")] == [lh.BLOCK] and out.columns[:4] == series.columns
    none = lh.in_blocks(series.where("false"), 5)
    assert lh.ffill(none, ["x"]).count() == lh.expanding_zscore(none, "x", "z").count() == 0


def test_no_window_partition_holds_a_whole_history(series):
    rows = lh.in_blocks(series, 20)
    plan = lh.expanding_zscore(rows, "x", "z")._jdf.queryExecution().executedPlan().toString()
    over_rows = [line for line in plan.splitlines() if "Window [" in line and "var_pop" in line]
    assert over_rows and all("_block" in line for line in over_rows)
