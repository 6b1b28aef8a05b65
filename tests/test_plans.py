"""Plans and readers on files and tables in the source schemas."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from panelloom.plans import conflict, forecast, structural, volatility
from panelloom.session import fresh_path, shared_folder
from panelloom.sources import crosswalks, sinks, tables, wide


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_crosswalks(spark):
    gw = crosswalks.crosswalk(spark, "gw", crosswalks.GW_TO_ISO3)
    assert gw.count() == len(crosswalks.GW_TO_ISO3) == gw.select("code").distinct().count()
    regions = crosswalks.regions(spark)
    assert regions.select("region").distinct().count() == 14
    assert regions.count() == regions.select("entity").distinct().count()


def test_coup_file_to_monthly_flags(spark):
    path = fresh_path(spark, "coups")
    raw = spark.createDataFrame([("41", "Haiti", "1991", "9", "2"), ("41", "Haiti", "1991", "9", "1"), ("x", "?", "1991", "9", "2"),
                                 ("999", "none", "1991", "9", "2"), ("2", "US", "1970", "1", "2")],
                                "ccode STRING, country STRING, year STRING, month STRING, coup STRING")
    raw.write.csv(path, header=True, sep="\t")
    df = tables.read_delimited(spark, path, sep="\t")
    out = structural.coups(df, crosswalks.crosswalk(spark, "gw", crosswalks.GW_TO_ISO3))
    assert rows(out, "entity", "period", "pt_coup_successful", "pt_coup_failed", "pt_coup_count", "pt_coup_event") == [
        ("HTI", "1991-09", 1, 1, 2, 1)]


def test_leaders_take_changes_before_duplicates_go(spark):
    data = [(2, 2000, 1, "p", 39.0, 0.0, 1), (2, 2000, 2, "p", 50.0, 0.0, 1), (2, 2000, 2, "m", 80.0, 1.0, 2), (2, 2000, 3, "m", None, None, 1)]
    df = spark.createDataFrame(data, "ccode INT, year INT, month INT, government STRING, age DOUBLE, irregular DOUBLE, seq INT")
    out = structural.leaders(df, crosswalks.crosswalk(spark, "gw", crosswalks.GW_TO_ISO3), order=["seq"])
    got = rows(out, "period", "age", "leader_age_risk", "regime_change", "coup_event", "months_since_structural_break", "reign_regime_m")
    assert got == [("2000-01", 39.0, 1.0, 0.0, 0.0, None, 0), ("2000-02", 80.0, 1.0, 1.0, 1.0, 0.0, 1),
                   ("2000-03", None, None, 0.0, None, 1.0, 1)]


def test_exchange_rates_from_imf_codes(spark):
    data = [(111, 2000, m, v) for m, v in enumerate(["1", "2", "x", "4", "4"], 1)] + [(5, 2000, 1, "9")]
    df = spark.createDataFrame(data, "`IMF_Code` INT, Year INT, Month INT, `Value` STRING")
    imf = crosswalks.crosswalk(spark, "imf", crosswalks.IMF_TO_ISO3)
    out = structural.exchange_rates(df, imf=imf)
    assert rows(out, "entity", "period", "fx_pct_change") == [
        ("USA", "2000-01", None), ("USA", "2000-02", 1.0), ("USA", "2000-04", 1.0), ("USA", "2000-05", 0.0)]


def test_structural_panel_without_optional_sources(spark):
    gdp = structural.growth(spark.createDataFrame([("USA", y, float(y % 4)) for y in range(1995, 2003)], "iso3 STRING, year INT, gdp_growth DOUBLE"),
                            start="2000-01", end="2001-12")
    out = structural.assemble({"gdp": gdp}, None, "2000-01", "2001-12")
    assert out.count() == 24
    first = out.orderBy("period").first()
    assert first["gdp_growth"] is None and first["gdp_available"] == 0 and first["vdem_available"] == 0
    assert {r["vdem_stale_flag"] for r in out.filter("period > '2000-01'").collect()} == {0}


def test_conflict_panel_shape_and_lag(spark):
    d = datetime.date
    ged = spark.createDataFrame([("Iran", d(2020, 1, 3), 5.0, 7.0, 9.0, 1.0, 1), ("Iran", d(2020, 3, 3), 2.0, 4.0, 1.0, 0.0, 3), ("Nowhere", d(2020, 1, 1), 1.0, 1.0, 1.0, 0.0, 1)],
                                "country STRING, date_start DATE, best DOUBLE, high DOUBLE, low DOUBLE, deaths_civilians DOUBLE, type_of_violence INT")
    names = crosswalks.crosswalk(spark, "name", crosswalks.NAME_TO_ISO3)
    final = conflict.build(conflict.conflict_events(ged, names, "2020-01", "2020-04"), None, None, "2020-01", "2020-04")
    got = {r["period"]: r for r in final.collect()}
    assert len(got) == 4
    assert got["2020-01"]["ucdp_fatalities_best"] == pytest.approx(math.log(6))
    assert got["2020-02"]["ucdp_event_count"] == pytest.approx(math.log(2)) and got["2020-02"]["ucdp_fatality_uncertainty"] == 0.0
    assert got["2020-04"]["ucdp_one_sided_events"] == 1 and got["2020-04"]["ucdp_has_conflict"] == 1


def test_wide_reader_coerces_and_keeps_the_first_series(spark):
    df = spark.createDataFrame([("usa.B", "1.5", "x"), ("usa.A", "2.5", None)], "SERIES_CODE STRING, `2000-M01` STRING, `2000-M02` STRING")
    assert rows(wide.fx_wide_to_long(df), "iso3", "year", "month", "exchange_rate") == [("USA", 2000, 1, 2.5), ("USA", 2000, 2, None)]


def test_risk_readers(spark):
    df = spark.createDataFrame([(datetime.date(2000, 1, 1), 1.0, 2.0, 3.0, None, 5.0), (datetime.date(2000, 2, 1), None, 2.0, 3.0, 4.0, 5.0)],
                               "month DATE, GPR DOUBLE, GPRT DOUBLE, GPRA DOUBLE, GPRC_USA DOUBLE, GPRC_DEU DOUBLE")
    assert rows(wide.risk_global(df), "period", "gpr_acts") == [("2000-01", 3.0)]
    assert rows(wide.risk_by_entity(df), "entity", "period") == [("DEU", "2000-02"), ("USA", "2000-02")]
    assert len(rows(wide.risk_by_entity(df, require="any"), "entity")) == 4


def test_tone_of_codes_that_share_an_entity_is_merged(spark):
    tone = spark.createDataFrame([("A", "2000-01", 1.0, 3), ("B", "2000-01", 3.0, 4), ("A", "2000-02", 0.0, 1)], "code STRING, period STRING, tone_mean DOUBLE, event_count INT")
    one = crosswalks.crosswalk(spark, "fips", {"A": "x", "B": "x"})
    two = crosswalks.crosswalk(spark, "iso2", {"x": "XXX"})
    out = volatility.tone_for_entities(tone, one, two)
    assert rows(out, "entity", "period", "tone_mean", "event_count") == [("XXX", "2000-01", None, None), ("XXX", "2000-02", 2.0, 7.0)]


def test_score_file_months(spark):
    df = spark.createDataFrame([(535, "", "m", 1.0, 2.0, 3.0), (546, "", "m", 1.0, 2.0, 3.0), (547, "", "m", 1.0, 2.0, 3.0)], tables.SCORE_SCHEMA)
    assert [r["period"] for r in tables.month_ids_to_periods(df).collect()] == ["2024-07", "2025-06", None]


def test_evaluation_uses_months_with_events_only(spark):
    fc = spark.createDataFrame([("a", "2024-07", 3.0, [1.0, 2.0]), ("a", "2024-08", 0.0, [1.0, 2.0]), ("b", "2023-01", 9.0, [1.0, 2.0])],
                               "entity STRING, period STRING, y DOUBLE, samples ARRAY<DOUBLE>")
    published = spark.createDataFrame([("2024-07", "CCEW_tft", 1.0, 1.0, 1.0), ("2024-08", "CCEW_tft", 9.0, 9.0, 9.0)], "period STRING, model STRING, crps DOUBLE, ign DOUBLE, mis DOUBLE")
    report = forecast.evaluate(fc, published)
    assert rows(report.usable, "period", "usable") == [("2024-07", True), ("2024-08", False)]
    own = {r["model"]: r for r in report.comparison.collect()}
    assert own["ours"]["n"] == 1 and own["[views] CCEW_tft"]["crps"] == 1.0 and own["[views] CCEW_tft"]["mis_50"] is None
    assert {r["period"] for r in report.per_month.collect()} == {"2024-07", "AVG"}


def test_stage_is_built_once(spark):
    path, calls = fresh_path(spark, "stage"), []

    def build():
        calls.append(1)
        return spark.createDataFrame([("a", "2020-01", 1.0), ("a", "2021-01", 2.0)], "entity STRING, period STRING, v DOUBLE")

    for _ in range(2):
        df = sinks.run_stage(spark, path, build)
    assert len(calls) == 1 and df.columns == ["entity", "period", "v"] and df.count() == 2


def test_shared_folder_follows_the_session(spark):
    folder = shared_folder(spark)
    assert spark.conf.get("spark.checkpoint.dir") == folder
    assert fresh_path(spark, "x").startswith(folder + "/") and fresh_path(spark, "x") != fresh_path(spark, "x")


def test_normalise_columns_reports_what_is_missing(spark):
    with pytest.raises(ValueError, match="gdp_growth"):
        tables.normalise_columns(spark.range(1).select(F.lit("x").alias("iso3")), tables.GDP_SYNONYMS, ["iso3", "gdp_growth"])


def test_a_torn_stage_is_built_again(spark):
    import os

    def build():
        return spark.createDataFrame([("a", f"20{y}-01", 1.0) for y in range(10, 17)], "entity STRING, period STRING, v DOUBLE")

    for torn in ("stage_year=2010", "_temporary/0"):
        path = fresh_path(spark, "torn")
        folder = f"{path.removeprefix('file:')}/{torn}"
        os.makedirs(folder)
        if "year" in torn:
            build().limit(1).write.mode("overwrite").parquet(f"file:{folder}")
            os.remove(f"{folder}/_SUCCESS")
        assert sinks.run_stage(spark, path, build).count() == 7
    sinks.drop_stage(spark, path)
    assert not sinks.stage_exists(spark, path)


def test_a_stage_prunes_years(spark):
    path = fresh_path(spark, "pruned")
    df = sinks.run_stage(
        spark, path, lambda: spark.createDataFrame([("a", "2019-05", 1.0), ("a", "2020-03", 2.0), ("a", "2020-09", 3.0)], "entity STRING, period STRING, v DOUBLE"),
        start="2020-02", end="2020-08",
    )
    assert [r["v"] for r in df.collect()] == [2.0]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(stage_year" in plan


def test_duplicate_keys_in_a_panel_are_an_error(spark):
    from panelloom.operators import joins

    one = spark.createDataFrame([("a", "2020-01", 1.0, 9.0), ("a", "2020-01", 2.0, 3.0)], "entity STRING, period STRING, p DOUBLE, q DOUBLE")
    two = spark.createDataFrame([("a", "2020-01", 5.0)], "entity STRING, period STRING, r DOUBLE")
    with pytest.raises(Exception, match="several rows"):
        joins.merge_panels([one, two]).collect()
    assert joins.merge_panels([one.limit(1), two]).collect()[0]["r"] == 5.0


def test_conflict_panel_shuffles_once_beyond_the_sources(spark):
    from workload import load_all

    sf = "/root/testdata/sf0.001"
    run = load_all()["conflict_lifecycle"].run
    plan = run(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 6 and "SortMergeJoin" not in plan and "FullOuter" not in plan


def test_entities_after_the_range_stay_on_the_structural_grid(spark):
    rows = [("USA", y, float(y % 4)) for y in range(1996, 2002)] + [("LATE", y, 1.0 * y) for y in range(2005, 2009)]
    gdp = structural.growth(spark.createDataFrame(rows, "iso3 STRING, year INT, gdp_growth DOUBLE"), start="2000-01", end="2001-12")
    out = structural.assemble({"gdp": gdp}, None, "2000-01", "2001-12")
    late = out.filter("entity = 'LATE'").collect()
    assert sorted(r["period"] for r in late) == sorted(r["period"] for r in out.filter("entity = 'USA'").collect())
    assert len(late) == 24 and all(r["gdp_growth"] is None and r["gdp_available"] == 0 for r in late)
    assert out.filter("entity = 'USA' AND gdp_growth IS NOT NULL").count() == 23


def test_complete_grid_outside_rows_leave_no_values(spark):
    from panelloom.operators import joins

    df = spark.createDataFrame([("a", "2019-05", 1.0), ("a", "2020-02", 2.0), ("b", "2018-01", 3.0), ("b", "2021-01", 4.0)], "entity STRING, period STRING, v DOUBLE")
    got = sorted(tuple(r) for r in joins.complete_grid(df, "2020-01", "2020-03", activity="seen", outside=True).collect())
    assert got == [("a", "2020-01", None, 0), ("a", "2020-02", 2.0, 1), ("a", "2020-03", None, 0)] + [("b", f"2020-0{m}", None, 0) for m in (1, 2, 3)]
    assert {r["entity"] for r in joins.complete_grid(df, "2020-01", "2020-03").collect()} == {"a"}


def test_yearly_stage_resumes_and_rebuilds_what_changed(spark, tmp_path):
    from panelloom.sources import sinks

    source, path = f"{tmp_path}/in.parquet", f"{tmp_path}/stage"
    months = [(f"{y}-{m:02d}", float(y)) for y in range(2001, 2008) for m in range(1, 13)]
    spark.createDataFrame(months, "period STRING, v DOUBLE").write.parquet(source)
    built = []

    def build(fail_at=None):
        def run(year):
            if year == fail_at:
                raise RuntimeError("killed")
            built.append(year)
            return spark.read.parquet(source)

        return run

    run = lambda fail_at=None, **kw: sinks.run_yearly_stage(spark, path, build(fail_at), "2001-03", "2007-12", {"p": 1} | kw, [source])
    with pytest.raises(RuntimeError):
        run(2003)
    assert built == [2001, 2002]
    df = run()
    assert built == list(range(2001, 2008)) and df.count() == 7 * 12 - 2 and df.columns == ["period", "v"]
    run()
    assert built == list(range(2001, 2008))
    run(p=2)  # another parameter
    assert built[7:] == list(range(2001, 2008))
    part = sinks.run_yearly_stage(spark, path, build(), "2003-01", "2004-06", {"p": 2}, [source])
    assert built[14:] == [2004] and part.agg({"period": "max"}).first()[0] == "2004-06"  # 2003 is whole, 2004 asks for half
    spark.createDataFrame(months[:1], "period STRING, v DOUBLE").write.mode("append").parquet(source)
    assert run(p=2).count() == 7 * 12 - 2 and built[15:] == list(range(2001, 2008))  # another input


def test_sink_stage_aggregates_events_once(spark, tmp_path, monkeypatch):
    import datetime

    from workload import base, load_all

    rows = {
        "nation": ([(1, "A"), (2, "B")], "n_nationkey INT, n_name STRING"),
        "customer": ([(1, 1), (2, 2), (3, 1)], "c_custkey BIGINT, c_nationkey INT"),
        "orders": (
            [(i, i % 3 + 1, datetime.date(1996 + i % 6, i % 8 + 1, 5), "1-URGENT", "F", 997.0 * i) for i in range(1, 41)],
            "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate DATE, o_orderpriority STRING, o_orderstatus STRING, o_totalprice DOUBLE",
        ),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    calls, real = [], base.conflict_agg
    monkeypatch.setattr(base, "conflict_agg", lambda *a: calls.append(a) or real(*a))
    out = load_all()["sink_stage"].run(spark, str(tmp_path)).collect()
    assert len(calls) == 1
    want = {("A" if i % 3 + 1 != 2 else "B", f"{1996 + i % 6}-{i % 8 + 1:02d}") for i in range(1, 41) if i % 6 >= 2}
    assert len(out) == 2 * 44 and {(r.entity, r.period) for r in out if r.event_count} == want
    assert sum(r.fatalities_best for r in out) == sum(i for i in range(1, 41) if i % 6 >= 2)
