"""Row-local column expressions with the library's NULL rules.

Missing is NULL and never NaN.  A flag built from a comparison is 0 when the
comparison has a missing side.  Division by zero and failed casts give NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_MONTH = 30.44


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def period_of(date: Column) -> Column:
    """'yyyy-MM' of a date, timestamp or parseable string; NULL if invalid.

    The head of the ISO text costs a fraction of a pattern formatter per row.
    """
    return F.substring(date.try_cast("date").cast("string"), 1, 7)


def period_of_parts(year: Column, month: Column) -> Column:
    y, m = year.try_cast("int"), month.try_cast("int")
    return F.when(y.isNotNull() & m.isNotNull(), F.format_string("%04d-%02d", y, m))


def period_of_yyyymmdd(number: Column) -> Column:
    """Period of an 8-digit date number; NULL unless it is a calendar day.

    A cast of ISO text parses natively, a pattern parser costs several times as much.
    """
    text = number.cast("string")
    iso = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
    valid = (F.length(text) == 8) & iso.try_cast("date").isNotNull()
    return F.when(valid, F.substring(iso, 1, 7))


def period_start(period: Column) -> Column:
    """First day of a 'yyyy-MM' period as a DATE."""
    return F.to_date(F.concat(period, F.lit("-01")))


def shift_period(period: Column, months: int) -> Column:
    return F.date_format(F.add_months(period_start(period), months), "yyyy-MM")


def numeric(value: Column, fill: float | None = None) -> Column:
    """Double if the value parses to a finite-or-infinite number, else NULL or ``fill``."""
    d = value.try_cast("double")
    d = F.when(~F.isnan(d), d)
    return d if fill is None else F.coalesce(d, F.lit(float(fill)))


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip that keeps NULL (``greatest`` and ``least`` alone would skip it)."""
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(value.isNotNull(), out)


def log1p_clipped(value: Column) -> Column:
    return F.log1p(clip(value, low=0.0))


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean over the non-null columns of a row; NULL when all are missing."""
    total = sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0))
    present = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return F.try_divide(total, F.nullif(present, F.lit(0)))


def ratio_change(value: Column, previous: Column) -> Column:
    return F.try_divide(value, previous) - 1


def outside_band(value: Column, low: float, high: float) -> Column:
    """1 outside [low, high], 0 inside, NULL for NULL."""
    return F.when(value.isNotNull(), ((value < low) | (value > high)).cast("double"))


def months_since(period: Column, event_date: Column) -> Column:
    """Average-length months from an event to the period start; NULL if in the future."""
    months = F.datediff(period_start(period), event_date) / F.lit(DAYS_PER_MONTH)
    return F.when(months >= 0, months)


def contains_text(value: Column, text: str) -> Column:
    """Case-insensitive substring test, false for NULL."""
    return F.coalesce(F.lower(value).contains(text.lower()), F.lit(False))


def clean_code(value: Column, width: int | None = None) -> Column:
    """Trimmed upper-case code without quote marks, left-padded with zeros to ``width``."""
    code = F.upper(F.trim(F.regexp_replace(value.cast("string"), "'", "")))
    return code if width is None else F.lpad(code, width, "0")
