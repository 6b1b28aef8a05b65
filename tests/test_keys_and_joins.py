"""Keys, recoding, skeletons and merges on small tables."""

import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelloom.functions import scalar
from panelloom.operators import aggregates as agg
from panelloom.operators import joins, keys
from panelloom.operators.aggregates import Measure


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_invalid_dates_give_no_period(spark):
    df = spark.createDataFrame([("2024-02-30",), (None,), ("2024-02-29",), ("x",)], "d STRING")
    assert rows(keys.with_period(df, "d"), "period") == [("2024-02",)]
    numbers = spark.createDataFrame([(20240230,), (20240229,), (None,)], "d INT")
    assert rows(keys.with_period_from_yyyymmdd(numbers, "d"), "period") == [("2024-02",)]


def test_range_with_lead(spark):
    df = spark.createDataFrame([("1999-12",), ("2000-01",), ("2000-06",), ("2000-07",), ("1999-06",)], "period STRING")
    assert len(rows(keys.in_range(df, "2000-01", "2000-06"), "period")) == 2
    assert len(rows(keys.in_range(df, "2000-01", "2000-06", lead_months=6), "period")) == 3


def test_numeric_turns_text_and_nan_into_null(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "v STRING")
    assert rows(keys.coerce_numeric(df, ["v"]), "v") == rows(spark.createDataFrame([(1.5,), (None,), (None,), (None,)], "v DOUBLE"), "v")
    assert rows(keys.coerce_numeric(df, ["v"], 0.0), "v") == [(0.0,), (0.0,), (0.0,), (1.5,)]


def test_skeleton_sizes(spark):
    entities = spark.createDataFrame([(str(i),) for i in range(228)], "entity STRING")
    assert joins.skeleton(entities, "1985-01", "2024-12").count() == 109_440
    assert joins.skeleton(entities.limit(189), "1985-01", "2025-12").count() == 92_988


def test_keep_one_ignores_partitioning(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "z"), ("k", 1, "a"), ("l", 5, "q")], "k STRING, o INT, v STRING")
    for n in (1, 3):
        assert rows(keys.keep_one(df.repartition(n), ["k"], ["o"]), "k", "o", "v") == [("k", 1, "a"), ("l", 5, "q")]
        assert rows(keys.keep_one(df.repartition(n), ["k"], ["o"], "last"), "k", "o", "v") == [("k", 2, "b"), ("l", 5, "q")]


def test_recode_rows_splits_hot_codes(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 500 + 100).cast("int").alias("c"), "id")
    table = spark.createDataFrame([(7, "hot"), *[(i + 100, f"e{i % 9}") for i in range(0, 480)]], "code INT, entity STRING")
    plain = rows(keys.recode(df, "c", table), "id", "entity")
    assert rows(keys.recode_rows(df, "c", table, small=False), "id", "entity") == plain
    assert rows(keys.recode_rows(df, "c", table), "id", "entity") == plain
    no_hot = table.filter("code <> 7")
    assert rows(keys.recode_rows(df, "c", no_hot, small=False), "id", "entity") == rows(keys.recode(df, "c", no_hot), "id", "entity")


def test_by_entity_equals_row_level_aggregation(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 40).cast("int").alias("code"),
        F.concat(F.lit("2020-0"), (F.col("id") % 5 + 1).cast("string")).alias("period"),
        F.when(F.col("id") % 7 > 0, (F.col("id") % 13).cast("double")).alias("v"),
    )
    table = spark.createDataFrame([(i, f"e{i % 4}") for i in range(35)], "code INT, entity STRING")
    measures = [Measure("n", "count", F.col("v")), Measure("s", "sum", F.col("v")), Measure("lo", "min", F.col("v")),
                Measure("hi", "max", F.col("v")), Measure("m", "mean", F.col("v")), Measure("c", "count_if", F.col("v") > 5)]
    names = ["entity", "period", *[m.name for m in measures]]
    direct = agg.aggregate(keys.recode(df, "code", table), ["entity", "period"], measures)
    for small in (True, False, None):
        staged = agg.by_entity(df, "code", measures, table, small=small)
        for a, b in zip(rows(direct, *names), rows(staged, *names)):
            assert a == pytest.approx(b)


def test_size_check(spark):
    assert keys.is_small(spark.range(10), 10) and not keys.is_small(spark.range(11), 10)


def panel(spark, data, *names):
    return spark.createDataFrame(data, "entity STRING, period STRING, " + ", ".join(f"{n} DOUBLE" for n in names))


def test_outer_merge_keeps_left_version_and_counts_the_union(spark):
    a = panel(spark, [("x", "1", 1.0, 2.0), ("y", "1", 3.0, 4.0)], "f", "shared")
    b = panel(spark, [("x", "1", 9.0, 5.0), ("z", "1", 8.0, 6.0)], "shared", "acled_g")
    out = joins.outer_merge(a, b, fill_prefixes=["acled_"])
    assert rows(out, "entity", "f", "shared", "acled_g") == [("x", 1.0, 2.0, 5.0), ("y", 3.0, 4.0, 0.0), ("z", None, None, 6.0)]
    report = {r["metric"]: r["value"] for r in joins.merge_validation(out, {"a": a, "b": b}).collect()}
    assert report["merged_rows"] == report["union_keys"] == 3
    assert joins.overlapping_columns({"a": a, "b": b}) == {("a", "b"): ["shared"]}


def test_globals_take_the_first_known_value(spark):
    df = panel(spark, [("a", "1", None), ("b", "1", 7.0), ("c", "1", 8.0), ("a", "2", None)], "g")
    assert rows(joins.spread_globals(df, ["g", "absent"]), "entity", "period", "g") == [
        ("a", "1", 7.0), ("a", "2", None), ("b", "1", 7.0), ("c", "1", 7.0)]


def test_backfill_refuses_duplicate_lookup_keys(spark):
    df = panel(spark, [("a", "1", None), ("b", "1", 2.0)], "t")
    good = panel(spark, [("a", "1", 5.0), ("b", "1", 9.0)], "t")
    assert rows(joins.backfill(df, good, ["t"]), "entity", "t") == [("a", 5.0), ("b", 2.0)]
    with pytest.raises(PySparkException, match="duplicate key"):
        joins.backfill(df, good.unionByName(good), ["t"]).collect()


def test_coup_months_counts_two_in_one_month(spark):
    df = spark.createDataFrame([("a", "1", 2), ("a", "1", 1), ("b", "1", None)], "entity STRING, period STRING, coup_code INT")
    assert rows(agg.coup_months(df), "entity", "pt_coup_successful", "pt_coup_failed", "pt_coup_count", "pt_coup_event") == [
        ("a", 1, 1, 2, 1), ("b", 0, 0, 0, 0)]


def test_daily_to_monthly_keeps_empty_months_and_pads(spark):
    d = datetime.date
    df = spark.createDataFrame([("s", d(2020, 1, 5), 10.0), ("s", d(2020, 1, 9), 20.0), ("s", d(2020, 3, 1), 30.0), ("s", d(2020, 3, 2), None)],
                               "series STRING, date DATE, close DOUBLE")
    out = rows(agg.daily_to_monthly(df, "series", "date", "close"), "period", "mean", "close", "pct_chg")
    assert out == [("2020-01", 15.0, 20.0, None), ("2020-02", None, None, 0.0), ("2020-03", 30.0, 30.0, 50.0)]


def test_row_mean_skips_missing(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a DOUBLE, b DOUBLE, c DOUBLE")
    assert rows(df.select(scalar.row_mean([F.col(c) for c in "abc"]).alias("m")), "m") == [(2.0,), (None,)]


def test_complete_grid_equals_a_skeleton_join(spark):
    df = panel(spark, [("a", "2020-03", 1.0), ("a", "2020-05", 2.0), ("b", "2019-12", 9.0), ("b", "2020-01", 3.0), ("c", "2020-06", None)], "v")
    out = joins.complete_grid(df, "2020-01", "2020-06", activity="seen")
    grid = joins.skeleton(df, "2020-01", "2020-06").join(df.withColumn("seen", F.lit(1)), ["entity", "period"], "left").fillna(0, ["seen"])
    assert rows(out, "entity", "period", "v", "seen") == rows(grid, "entity", "period", "v", "seen")
    assert out.count() == 18
