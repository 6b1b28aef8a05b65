"""Delimited files with explicit schemas, and column-name repair."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.operators.keys import keep_one

# Canonical column name -> accepted spellings (compared trimmed
# and in lower case).
FX_SYNONYMS = {
    "iso3": ("country_code", "iso3", "iso", "country_iso3", "ref_area"),
    "imf_code": ("imf_code", "imf_country_code"),
    "year": ("year",),
    "month": ("month",),
    "exchange_rate": ("exchange_rate", "value", "rate", "fx_rate", "obs_value"),
}
GDP_SYNONYMS = {
    "iso3": ("country_code", "iso3", "iso", "country_iso3", "countrycode"),
    "year": ("year", "date"),
    "gdp_growth": ("gdp_growth", "value", "ny.gdp.mktp.kd.zg", "gdp_growth_annual"),
}
FOOD_SYNONYMS = {
    "iso3": ("country_code", "iso3", "iso", "area_code"),
    "year": ("year",),
    "month": ("month",),
    "food_cpi": ("food_cpi", "value", "cpi_food", "food_price_index"),
}
COUP_SYNONYMS = {
    "gwcode": ("ccode",),
    "country_name": ("country",),
    "coup_code": ("coup",),
}


def tidy(df: DataFrame) -> DataFrame:
    """Trim column names and string values; NaN becomes NULL."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            c = F.trim(c)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(field.name.strip()))
    return df.select(*out)


def read_delimited(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType | str | None = None,
    sep: str = ",",
    encoding: str = "UTF-8",
    columns: Iterable[str] | None = None,
) -> DataFrame:
    """Headered text files as a tidy DataFrame.

    Without a schema every column is a string, which costs no inference pass.
    ``columns`` prunes at the scan.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", False)
    df = reader.csv(paths if isinstance(paths, str) else list(paths))
    if columns is not None:
        wanted = {c.strip() for c in columns}
        df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.strip() in wanted])
    return tidy(df)


def scan_union(
    spark: SparkSession,
    paths: str | Sequence[str],
    key: str,
    schema: T.StructType | str | None = None,
    **options,
) -> DataFrame:
    """All files of a pattern as one table with one row per ``key``.

    The first row in the order of its own values is kept, so the choice does
    not depend on file listing or task order.
    """
    df = read_delimited(spark, paths, schema, **options)
    return keep_one(df, [key], order=[])


def normalise_columns(
    df: DataFrame, synonyms: Mapping[str, Sequence[str]], required: Sequence[str] = ()
) -> DataFrame:
    """Rename columns to canonical names through case-insensitive synonyms."""
    canonical = {alias: name for name, aliases in synonyms.items() for alias in aliases}
    renames: dict[str, str] = {}
    for column in df.columns:
        name = canonical.get(column.strip().lower())
        if name and name not in renames.values():
            renames[column] = name
    missing = [name for name in required if name not in {renames.get(c, c) for c in df.columns}]
    if missing:
        raise ValueError(f"columns {missing} not found in {df.columns}")
    return df.withColumnsRenamed(renames)


# The published score table and the twelve months it covers.
SCORE_SCHEMA = "`Month ID` INT, Date STRING, Model STRING, CRPS DOUBLE, `ab-Log Score` DOUBLE, MIS DOUBLE"
FIRST_MONTH_ID = 535
LAST_MONTH_ID = 546
FIRST_SCORE_MONTH = "2024-07"


def read_scores(
    spark: SparkSession,
    path: str,
    first_id: int = FIRST_MONTH_ID,
    first_month: str = FIRST_SCORE_MONTH,
    last_id: int | None = LAST_MONTH_ID,
) -> DataFrame:
    """Monthly scores of published models: (period, model, crps, ign, mis)."""
    return month_ids_to_periods(
        read_delimited(spark, path, SCORE_SCHEMA), first_id, first_month, last_id
    )


def month_ids_to_periods(
    df: DataFrame,
    first_id: int = FIRST_MONTH_ID,
    first_month: str = FIRST_SCORE_MONTH,
    last_id: int | None = LAST_MONTH_ID,
) -> DataFrame:
    """Consecutive month numbers to periods; numbers outside the window give NULL."""
    number = F.col("Month ID")
    start = F.to_date(F.lit(first_month + "-01"))
    inside = number >= first_id
    if last_id is not None:
        inside = inside & (number <= last_id)
    period = F.when(inside, F.date_format(F.add_months(start, number - first_id), "yyyy-MM"))
    return df.select(
        period.alias("period"),
        F.col("Model").alias("model"),
        F.col("CRPS").alias("crps"),
        F.col("`ab-Log Score`").alias("ign"),
        F.col("MIS").alias("mis"),
    )
