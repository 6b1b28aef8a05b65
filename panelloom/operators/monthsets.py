"""Sets of (entity, month) keys as bits: one 64-bit word holds 64 months of an entity.

Words are built by ``bit_or``, which combines on the map side, so an exchange carries at most one word per task, entity and 64
months, whatever the number of rows or copies of a key; set operations are bit operations on
words side by side.  Periods are 'yyyy-MM'; NULL and any other text are keys like the others, each with a word of
its own, so reports on faulty panels stay right; a NULL entity is an entity.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64


def month_number(period: Column) -> Column:
    """Months since year 0; NULL for what is no month."""
    year, month = F.substring(period, 1, 4).try_cast("int"), F.substring(period, 6, 2).try_cast("int")
    return F.when(period.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), year * 12 + month - 1)


def number_of(period: str) -> int:
    return int(period[:4]) * 12 + int(period[5:7]) - 1


def month_text(number: Column) -> Column:
    return F.when(number.isNotNull(), F.format_string("%04d-%02d", (number / 12).cast("int"), number % 12 + 1))


def bit_of(number: Column) -> Column:
    """The month's bit in its word; the first bit for NULL."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.coalesce(F.pmod(number, F.lit(WORD)), F.lit(0)).cast("int"))


def words(panels: Mapping[str, DataFrame], entity: str = "entity", period: str = "period") -> DataFrame:
    """(entity, word, other, <name>..., n_<name>...): each panel's months, as bits, and its rows, in one exchange for all panels.

    ``other`` is the text of a period that is no month.
    """
    parts = []
    for place, df in enumerate(panels.values()):
        text = F.col(period).cast("string")
        number = month_number(text)
        word = F.floor(number / WORD).cast("int").alias("word")
        parts.append(df.select(F.col(entity).alias(entity), word, F.when(number.isNull(), text).alias("other"), bit_of(number).alias("_bit"), F.lit(place).alias("_from")))
    stacked = reduce(DataFrame.union, parts)
    mine = [F.col("_from") == i for i in range(len(parts))]
    return stacked.groupBy(entity, "word", "other").agg(
        *[F.coalesce(F.bit_or(F.when(m, F.col("_bit"))), F.lit(0).cast("long")).alias(n) for m, n in zip(mine, panels)],
        *[F.count_if(m).alias(f"n_{n}") for m, n in zip(mine, panels)],
    )


def keys_of(bits: DataFrame, column: Column, entity: str = "entity", period: str = "period") -> DataFrame:
    """(entity, period) of the bits set in an expression over words."""
    held = bits.select(entity, "word", "other", column.alias("_bits")).where(F.col("_bits") != 0)
    places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.bit_get("_bits", i) == 1)
    # A word without number holds one other text or the NULL period.
    return held.select(entity, "word", "other", F.explode(places).alias("_i")).select(entity, _period().alias(period))


def _period() -> Column:
    return F.coalesce("other", month_text(F.col("word") * WORD + F.col("_i")))


def union_keys(panels: Sequence[DataFrame], entity: str = "entity", period: str = "period") -> DataFrame:
    """Distinct keys over all panels."""
    named = {f"p{i}": p for i, p in enumerate(panels)}
    return keys_of(words(named, entity, period), reduce(lambda a, b: a.bitwiseOR(b), [F.col(n) for n in named]), entity, period)


def compared_keys(a: DataFrame, b: DataFrame, entity: str = "entity", period: str = "period") -> DataFrame:
    """(side, entity, period): keys in both panels, only in the first, only in the second; all from one pass."""
    bits = words({"a": a, "b": b}, entity, period)
    sides = {"both": F.col("a").bitwiseAND(F.col("b")), "only_a": F.col("a").bitwiseAND(F.bitwise_not("b")), "only_b": F.col("b").bitwiseAND(F.bitwise_not("a"))}
    sided = bits.select(entity, "word", "other", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), v.alias("_bits")) for s, v in sides.items()])).alias("_s"))
    sided = sided.select("_s.side", entity, "word", "other", "_s._bits").where(F.col("_bits") != 0)
    places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.bit_get("_bits", i) == 1)
    return sided.select("side", entity, "word", "other", F.explode(places).alias("_i")).select("side", entity, _period().alias(period))


def range_words(
    df: DataFrame, present: Column, start: str, end: str, entity: str = "entity", period: str = "period"
) -> tuple[DataFrame, list[str], Callable[[Column], Column]]:
    """Entities with a row in [start, end] and the months where ``present`` holds, one column per word of the range.

    Also the columns' names and a test of a month's number.  The range bounds the number of words, so one exchange by entity does.
    """
    first, last = number_of(start) // WORD, number_of(end) // WORD
    number = month_number(F.col(period))
    names = [f"_w{k}" for k in range(first, last + 1)]
    marked = df.where(F.col(period).between(start, end)).select(entity, F.floor(number / WORD).cast("int").alias("_word"), F.when(present, bit_of(number)).alias("_bit"))
    rows = marked.groupBy(entity).agg(
        *[F.coalesce(F.bit_or(F.when(F.col("_word") == k, F.col("_bit"))), F.lit(0).cast("long")).alias(n) for k, n in zip(range(first, last + 1), names)]
    )

    def has(month: Column) -> Column:
        word = F.get(F.array(*[F.col(n) for n in names]), (F.floor(month / WORD) - first).cast("int"))
        return F.bit_get(word, F.pmod(month, F.lit(WORD)).cast("int"))

    return rows, names, has
