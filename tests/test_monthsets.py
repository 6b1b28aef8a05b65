"""Keys as bits against plain sets."""

import random

import pytest
from pyspark.sql import functions as F

from panelloom.operators import joins, monthsets, profile, sets

SCHEMA = "entity STRING, period STRING, v DOUBLE"


def some(seed, n=300):
    rng = random.Random(seed)
    months = [f"{y:04d}-{m:02d}" for y in (1, 1969, 1970, 1999, 2000, 2021) for m in range(1, 13)] + [None, "2020-13", "1", ""]
    return [(rng.choice(["a", "b", "c", None, f"only{seed}"]), rng.choice(months), rng.choice([None, 1.0])) for _ in range(n)]


def test_set_operations(spark):
    a, b = some(1), some(2)
    fa, fb = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    ka, kb = ({r[:2] for r in x} for x in (a, b))
    rows = lambda df: [tuple(r) for r in df.collect()]
    got = rows(monthsets.union_keys([fa, fb]))
    assert len(got) == len(set(got)) and set(got) == ka | kb
    assert set(rows(sets.distinct_union([fa, fb], ["entity", "period"]))) == ka | kb
    got = rows(monthsets.compared_keys(fa, fb))
    assert len(got) == len(ka | kb)
    assert set(got) == {("both", *k) for k in ka & kb} | {("only_a", *k) for k in ka - kb} | {("only_b", *k) for k in kb - ka}
    empty = spark.createDataFrame([], SCHEMA)
    assert set(rows(monthsets.compared_keys(fa, empty))) == {("only_a", *k) for k in ka}
    assert rows(monthsets.union_keys([empty, empty])) == []


def test_overlap_report(spark):
    a, b, c = some(1), some(2), some(3)
    panels = {n: spark.createDataFrame(x, SCHEMA) for n, x in zip("abc", (a, b, c))}
    got = {r["metric"]: r["n"] for r in joins.key_overlap(panels).collect()}
    ents = {n: {r[0] for r in x} for n, x in zip("abc", (a, b, c))}
    for n, x in zip("abc", (a, b, c)):
        assert got[f"duplicates_{n}"] == len(x) - len({r[:2] for r in x})
        assert got[f"only_{n}"] == len(ents[n] - set().union(*[ents[m] for m in "abc" if m != n]))
    assert got["shared_a_b"] == len(ents["a"] & ents["b"]) and got["shared_all"] == len(ents["a"] & ents["b"] & ents["c"])


def test_presence_equals_a_grid(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), f"20{rng.randrange(9, 16):02d}-{rng.randrange(1, 13):02d}", rng.choice([None, 2.0])) for _ in range(250)]
    rows += [("outside", "1999-01", 1.0), ("empty", "2011-05", None), (None, "2012-01", 3.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    start, end = "2010-03", "2015-11"
    months = [f"{n // 12:04d}-{n % 12 + 1:02d}" for n in range(monthsets.number_of(start), monthsets.number_of(end) + 1)]
    inside = [r for r in rows if start <= r[1] <= end]
    known = {r[:2] for r in inside if r[2] is not None}
    want = {(e, m, int((e, m) in known)) for e in {r[0] for r in inside} for m in months}
    got = [tuple(r) for r in profile.presence(df, "v", start, end).collect()]
    assert len(got) == len(want) and set(got) == want
    share = {r["entity"]: r["missing_pct"] for r in profile.missing_by_entity(df, "v", start, end, None).collect()}
    for e in {r[0] for r in inside}:
        missing = 100 * (1 - sum((e, m) in known for m in months) / len(months))
        assert share.get(e, 0) == pytest.approx(missing)


def test_keys_are_not_shuffled_as_rows(spark):
    """Ten thousand rows of two entities leave each task as a few words."""
    df = spark.range(10_000, numPartitions=4).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("entity"), F.format_string("%04d-%02d", F.lit(2000) + F.col("id") % 10, F.col("id") % 12 + 1).alias("period")
    )
    plan = monthsets.words({"p": df})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(entity" in plan and "period" not in plan.split("Exchange")[0]
    assert monthsets.words({"p": df}).count() <= 2 * 3
