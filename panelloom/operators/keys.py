"""Keys: periods, entity codes, column selection and duplicates."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions import scalar

KEYS = ("entity", "period")
METADATA_SUFFIXES = ("_missing", "_available", "_flag")


def with_period(
    df: DataFrame, date: str, period: str = "period", start: str | None = None, end: str | None = None
) -> DataFrame:
    """Add the 'yyyy-MM' period of a date column; rows with an invalid date go.

    A [start, end] range on a typed date column is a filter on the column
    itself, so it reaches the scan and skips row groups.
    """
    typed = isinstance(df.schema[date].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    kind = df.schema[date].dataType.typeName() if typed else None
    if typed and start:
        df = df.filter(F.col(date) >= F.lit(start + "-01").cast(kind))
    if typed and end:
        year, month = (int(part) for part in end.split("-"))
        after = f"{year + month // 12:04d}-{month % 12 + 1:02d}-01"
        df = df.filter(F.col(date) < F.lit(after).cast(kind))
    if typed:
        # A typed date is valid unless NULL; testing the column and not the
        # period spares computing the period twice.
        text = F.col(date).cast("date").cast("string")
        return df.filter(F.col(date).isNotNull()).withColumn(period, F.substring(text, 1, 7))
    df = df.withColumn(period, scalar.period_of(F.col(date))).filter(F.col(period).isNotNull())
    if start:
        df = df.filter(F.col(period) >= start)
    if end:
        df = df.filter(F.col(period) <= end)
    return df


def with_period_from_parts(df: DataFrame, year: str, month: str, period: str = "period") -> DataFrame:
    key = scalar.period_of_parts(F.col(year), F.col(month))
    return df.withColumn(period, key).filter(F.col(period).isNotNull())


def with_period_from_yyyymmdd(df: DataFrame, number: str, period: str = "period") -> DataFrame:
    return df.withColumn(period, scalar.period_of_yyyymmdd(F.col(number))).filter(F.col(period).isNotNull())


def in_range(df: DataFrame, start: str, end: str, period: str = "period", lead_months: int = 0) -> DataFrame:
    """Rows with ``start <= period <= end``; ``lead_months`` keeps history before the start."""
    if lead_months:
        year, month = (int(part) for part in start.split("-"))
        count = year * 12 + month - 1 - lead_months
        start = f"{count // 12:04d}-{count % 12 + 1:02d}"
    return df.filter(F.col(period).between(start, end))


def coerce_numeric(df: DataFrame, columns: Sequence[str], fill: float | None = None) -> DataFrame:
    return df.withColumns({c: scalar.numeric(F.col(c), fill) for c in columns})


def recode(
    df: DataFrame, code: str, crosswalk: DataFrame, entity: str = "entity", keep_unmapped: bool = False
) -> DataFrame:
    """Attach the entity of a code; rows without one go unless ``keep_unmapped``.

    ``crosswalk`` has one row per code.  Its size decides the join: Spark
    broadcasts it below the configured threshold and shuffles beyond it.
    Aggregate by code first where rows are many (see ``aggregates.by_entity``),
    so that a code with very many rows is one row per period here.
    """
    table = crosswalk.select(
        F.col("code").try_cast(df.schema[code].dataType).alias("_code"), F.col("entity").alias(entity)
    )
    how = "left" if keep_unmapped else "inner"
    return df.join(table, df[code] == table["_code"], how).drop("_code")


# A code with at least this share of all rows is joined by broadcast.
HOT_SHARE = 1 / 200


# A crosswalk of at most this many rows (two short columns each) is broadcast.
SMALL_ROWS = 100_000


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Whether a table has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def recode_rows(
    df: DataFrame,
    code: str,
    crosswalk: DataFrame,
    entity: str = "entity",
    hot_share: float = HOT_SHARE,
    small: bool | None = None,
) -> DataFrame:
    """:func:`recode` for raw rows that cannot be aggregated first.

    A crosswalk that is ``small`` (checked unless stated) is broadcast.  Beyond
    that, codes holding much of the table, at most 1 / ``hot_share`` of them, get
    their crosswalk rows by broadcast and only the other rows are shuffled.
    """
    if is_small(crosswalk) if small is None else small:
        return recode(df, code, F.broadcast(crosswalk), entity)
    counts = df.groupBy(F.col(code).alias("_code")).agg(F.count(F.lit(1)).alias("_n"))
    rows = counts.agg(F.sum("_n")).scalar()
    hot = counts.filter(F.col("_n") >= rows * hot_share).select("_code")
    table = crosswalk.select(F.col("code").try_cast(df.schema[code].dataType).alias("_code"), F.col("entity").alias("_entity"))
    lookup = F.broadcast(hot.join(table, "_code", "left").withColumn("_hot", F.lit(True)))
    tagged = df.join(lookup, df[code] == lookup["_code"], "left").drop("_code")
    done = tagged.filter(F.col("_hot") & F.col("_entity").isNotNull()).withColumnRenamed("_entity", entity).drop("_hot")
    rest = tagged.filter(F.col("_hot").isNull()).drop("_hot", "_entity")
    return done.unionByName(recode(rest, code, crosswalk, entity))


def recode_chain(df: DataFrame, code: str, first: DataFrame, second: DataFrame, entity: str = "entity") -> DataFrame:
    """Two-hop recode, e.g. FIPS to ISO2 to ISO3."""
    hop = first.select(F.col("code").alias("_c1"), F.col("entity").alias("_mid"))
    chained = hop.join(second.select(F.col("code").alias("_mid"), F.col("entity")), "_mid")
    return recode(df, code, chained.select(F.col("_c1").alias("code"), "entity"), entity)


def unmapped_codes(df: DataFrame, code: str, crosswalk: DataFrame) -> DataFrame:
    """(code, n_rows) of codes without an entity; counted first, so the anti join is small."""
    counts = df.groupBy(F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("n_rows"))
    known = crosswalk.select(F.col("code").try_cast(df.schema[code].dataType).alias("code"))
    return counts.join(known, "code", "left_anti")


def assign_region(df: DataFrame, regions: DataFrame, entity: str = "entity") -> DataFrame:
    """Region of each entity, NULL where it has none."""
    return df.join(regions.withColumnRenamed("entity", entity), entity, "left")


def calendar_columns(df: DataFrame, period: str = "period") -> DataFrame:
    return df.withColumns(
        {
            "year": F.substring(period, 1, 4).cast("int"),
            "month": F.substring(period, 6, 2).cast("int"),
        }
    )


def ensure_columns(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add absent columns with a constant; present ones stay as they are."""
    absent = {name: F.lit(value) for name, value in defaults.items() if name not in df.columns}
    return df.withColumns(absent) if absent else df


def feature_columns(
    df: DataFrame, exclude: Collection[str] = KEYS, suffixes: Sequence[str] = METADATA_SUFFIXES
) -> list[str]:
    """Sorted numeric columns that are neither excluded nor metadata; reads the schema only."""
    numeric = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType)
    return sorted(
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, numeric) and f.name not in exclude and not f.name.endswith(tuple(suffixes))
    )


def drop_listed(df: DataFrame, columns: Collection[str]) -> DataFrame:
    return df.drop(*[c for c in columns if c in df.columns])


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "first") -> DataFrame:
    """One row per key, the first or last by ``order`` and then by all other columns.

    A min/max aggregate rather than a ranking window: copies collapse before
    the shuffle, so a key with very many copies stays cheap.
    """
    rest = [c for c in df.columns if c not in keys]
    tail = [c for c in rest if c not in order]
    rank = F.struct(*[F.col(f"`{c}`") for c in [*order, *tail]])
    pick = (F.min if keep == "first" else F.max)(rank).alias("_row")
    kept = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(pick)
    return kept.select(*[F.col(f"`{c}`") if c in keys else F.col(f"_row.`{c}`") for c in df.columns])


def keep_periods(df: DataFrame, periods: DataFrame, period: str = "period") -> DataFrame:
    """Rows whose period is in ``periods`` (semi join)."""
    return df.join(periods.select(period), period, "left_semi")
