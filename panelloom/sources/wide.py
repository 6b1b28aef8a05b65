"""Readers for layouts that spread periods or entities over columns.

Each is a projection plus ``unpivot`` (Spark's Expand): row-parallel, no
shuffle except where one series per entity must be chosen.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions import scalar
from panelloom.operators.keys import keep_one

FX_PERIOD_COLUMN = re.compile(r"^\d{4}-M\d{2}$")
FAO_YEAR_COLUMN = re.compile(r"^Y\d{4}$")
YEAR_COLUMN = re.compile(r"^\d+$")

# Fixed values of the source files.
FX_INDICATOR = "Domestic currency per US Dollar"
FX_FREQUENCY = "Monthly"
FX_TRANSFORMATION = "Period average"
FAO_FOOD_CPI_ITEM = 23013
FAO_MONTH_OFFSET = 7000
MONTH_NAMES = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)


def _quoted(name: str):
    return F.col(f"`{name}`")


def fx_wide_to_long(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Exchange-rate series with ``YYYY-Mnn`` columns -> (iso3, year, month, exchange_rate).

    Keeps monthly period averages of the dollar rate and one series per ISO3
    code, the first by ``order`` (default: by series code).
    """
    periods = [c for c in df.columns if FX_PERIOD_COLUMN.match(c.strip())]
    if not periods:
        raise ValueError("no YYYY-Mnn columns")
    if "INDICATOR" in df.columns:
        df = df.filter(F.col("INDICATOR").contains(FX_INDICATOR))
    if "FREQUENCY" in df.columns:
        df = df.filter(F.col("FREQUENCY") == FX_FREQUENCY)
    iso3 = F.upper(F.trim(F.split("SERIES_CODE", r"\.").getItem(0)))
    # A period-average series wins over other transformations; files without any
    # fall back to what they have.
    if "TYPE_OF_TRANSFORMATION" in df.columns:
        averaged = F.col("TYPE_OF_TRANSFORMATION").contains(FX_TRANSFORMATION)
        any_average = df.agg(F.bool_or(F.coalesce(averaged, F.lit(False)))).scalar()
        df = df.filter(F.coalesce(averaged, F.lit(False)) | ~F.coalesce(any_average, F.lit(False)))
    kept = keep_one(df.withColumn("iso3", iso3), ["iso3"], order or ["SERIES_CODE"])
    long = kept.select("iso3", *[_quoted(c).cast("string").alias(c) for c in periods]).unpivot(
        ["iso3"], periods, "period_code", "raw"
    )
    return long.select(
        "iso3",
        F.substring("period_code", 1, 4).try_cast("int").alias("year"),
        F.substring("period_code", 7, 2).try_cast("int").alias("month"),
        scalar.numeric(F.col("raw")).alias("exchange_rate"),
    )


def fx_sdmx_to_long(df: DataFrame) -> DataFrame:
    """SDMX layout (REF_AREA, TIME_PERIOD, OBS_VALUE) -> (iso3, year, month, exchange_rate)."""
    names = {c.strip().upper(): c for c in df.columns}
    time = F.trim(_quoted(names["TIME_PERIOD"]).cast("string"))
    return df.select(
        F.upper(F.trim(_quoted(names["REF_AREA"]))).alias("iso3"),
        F.substring(time, 1, 4).try_cast("int").alias("year"),
        F.regexp_extract(time, r"^\d{4}-M?(\d{2})", 1).try_cast("int").alias("month"),
        scalar.numeric(_quoted(names["OBS_VALUE"])).alias("exchange_rate"),
    )


def fao_wide_to_long(df: DataFrame, item: int | None = FAO_FOOD_CPI_ITEM) -> DataFrame:
    """Bulk price index with ``Ynnnn`` columns -> (m49, year, month, food_cpi)."""
    years = [c for c in df.columns if FAO_YEAR_COLUMN.match(c)]
    if not years:
        raise ValueError("no Ynnnn columns")
    if item is not None and "Item Code" in df.columns:
        df = df.filter(_quoted("Item Code").try_cast("int") == item)
    area = next(
        (c for c in df.columns if "area code" in c.lower() and "m49" in c.lower()), "Area Code (M49)"
    )
    base = df.select(
        F.trim(F.regexp_replace(_quoted(area).cast("string"), "'", "")).try_cast("int").alias("m49"),
        (_quoted("Months Code").try_cast("int") - FAO_MONTH_OFFSET).alias("month"),
        *[_quoted(c).cast("string").alias(c) for c in years],
    ).filter(F.col("month").isNotNull() & F.col("m49").isNotNull())
    long = base.unpivot(["m49", "month"], years, "year_code", "raw")
    return long.select(
        "m49",
        F.substring("year_code", 2, 4).cast("int").alias("year"),
        "month",
        scalar.numeric(F.col("raw")).alias("food_cpi"),
    )


def month_number(value) -> F.col:
    """Month names, plain numbers or codes 7001..7012 -> 1..12, else NULL."""
    text = F.lower(F.trim(value.cast("string")))
    by_name = F.lit(None).cast("int")
    for number, name in enumerate(MONTH_NAMES, 1):
        by_name = F.when(text == name, F.lit(number)).otherwise(by_name)
    code = text.try_cast("double").cast("int")
    by_code = F.when(code > FAO_MONTH_OFFSET, code - FAO_MONTH_OFFSET).otherwise(code)
    return F.coalesce(by_name, by_code)


def fao_long_months(df: DataFrame, months: str | None = None) -> DataFrame:
    """Long price index: ``Months`` names or codes to ``month``, ``Value`` to ``food_cpi``."""
    column = months or next(c for c in df.columns if c.strip().lower() in ("months", "months code"))
    value = "Value" if "Value" in df.columns else "food_cpi"
    rest = [c for c in df.columns if c not in (column, value, "month", "food_cpi")]
    return df.select(
        *[_quoted(c) for c in rest],
        month_number(_quoted(column)).alias("month"),
        scalar.numeric(_quoted(value)).alias("food_cpi"),
    ).filter(F.col("month").isNotNull())


def years_wide_to_long(df: DataFrame, code: str = "Country Code", value: str = "gdp_growth") -> DataFrame:
    """Years as columns -> (iso3, year, value) for three-letter codes and present values."""
    years = [c for c in df.columns if YEAR_COLUMN.match(c.strip())]
    base = df.select(F.trim(_quoted(code)).alias("iso3"), *[_quoted(c).cast("string").alias(c) for c in years])
    long = base.unpivot(["iso3"], years, "year_code", "raw")
    return (
        long.select(
            "iso3",
            F.trim("year_code").cast("int").alias("year"),
            scalar.numeric(F.col("raw")).alias(value),
        )
        .filter((F.length("iso3") == 3) & F.col(value).isNotNull())
    )


def risk_global(df: DataFrame) -> DataFrame:
    """Month-level risk index columns of the wide file."""
    return df.filter(F.col("GPR").isNotNull()).select(
        scalar.period_of(F.col("month")).alias("period"),
        F.col("GPR").alias("gpr_global"),
        F.col("GPRT").alias("gpr_threats"),
        F.col("GPRA").alias("gpr_acts"),
    )


def risk_by_entity(df: DataFrame, prefix: str = "GPRC_", require: str = "first") -> DataFrame:
    """Entity-level risk columns -> (entity, period, gpr_country).

    ``require='first'`` keeps months in which the first entity column has a
    value, ``'any'`` months in which some entity column has one.
    """
    columns = [c for c in df.columns if c.startswith(prefix)]
    if require == "first":
        df = df.filter(_quoted(columns[0]).isNotNull())
    else:
        df = df.filter(F.coalesce(*[_quoted(c) for c in columns]).isNotNull())
    base = df.select(
        scalar.period_of(F.col("month")).alias("period"),
        *[_quoted(c).cast("double").alias(c) for c in columns],
    )
    long = base.unpivot(["period"], columns, "entity_code", "gpr_country")
    return long.select(
        F.regexp_replace("entity_code", f"^{re.escape(prefix)}", "").alias("entity"), "period", "gpr_country"
    )
