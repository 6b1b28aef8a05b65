"""Building and merging panels.

A panel has one row per (entity, period).  Keys are therefore unique on both
sides of every panel join and no key can be hot; month-level tables are bounded
by the calendar.  Raw events never meet a join here: aggregate them first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelloom.functions import scalar
from panelloom.operators import monthsets, windows


def skeleton(
    entities: DataFrame, start: str, end: str, entity: str = "entity", period: str = "period"
) -> DataFrame:
    """Every entity in every month of [start, end].

    Months are exploded next to each entity, so nothing is joined.
    """
    months = F.sequence(
        F.to_date(F.lit(start + "-01")), F.to_date(F.lit(end + "-01")), F.expr("interval 1 month")
    )
    month = F.explode(months).alias("_month")
    return (
        entities.select(entity)
        .distinct()
        .select(entity, month)
        .select(entity, F.date_format("_month", "yyyy-MM").alias(period))
    )


def day_skeleton(
    entities: DataFrame, start: str, end: str, entity: str = "entity", period: str = "period"
) -> DataFrame:
    """Every entity on every day of [start, end]."""
    days = F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 day"))
    return entities.select(entity).distinct().select(entity, F.explode(days).alias(period))


def zero_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.fillna(0, subset=[c for c in columns if c in df.columns])


def zero_fill_except(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """0 for NULL in every numeric column that is not listed."""
    return df.fillna(0, subset=[c for c in df.columns if c not in keep])


def complete_grid(
    df: DataFrame,
    start: str,
    end: str,
    activity: str | None = None,
    entity: str = "entity",
    period: str = "period",
    outside: bool = False,
) -> DataFrame:
    """The rows of a panel and, for its entities, a NULL row for every other month of [start, end].

    Each row also emits the months up to the entity's next one, the first row
    those before it.  That takes one shuffle by entity and one pass, where a
    skeleton join would read the panel twice and shuffle both sides; windows by
    entity reuse the partitioning.  ``activity`` names a 0/1 column that says
    whether the month had a row.  Keys must be unique.  With ``outside``, entities
    all of whose rows lie before or after the range get NULL rows too: the first of these rows
    stands for the start, without its values.
    """
    w = windows.history(entity, period)
    within = F.coalesce(F.col(period).between(start, end), F.lit(False))
    if outside:
        flags = {"_in": within, "_any": F.max(within).over(W.partitionBy(entity)), "_nth": F.row_number().over(w)}
        seen = df.withColumns(flags).filter(F.col("_in") | (~F.col("_any") & (F.col("_nth") == 1)))
        inside = seen.withColumn(period, F.when(F.col("_in"), F.col(period)).otherwise(F.lit(start)))
    else:
        inside = df.filter(within).withColumn("_in", F.lit(True))
    first = F.when(F.lag(period).over(w).isNull(), F.lit(start)).otherwise(F.col(period))
    following = F.add_months(scalar.period_start(F.lead(period).over(w)), -1)
    last = F.coalesce(following, scalar.period_start(F.lit(end)))
    spans = inside.withColumns({"_from": scalar.period_start(first), "_to": last})
    months = F.explode(F.sequence("_from", "_to", F.expr("interval 1 month"))).alias("_month")
    rows = spans.select("*", months).withColumn("_month", F.date_format("_month", "yyyy-MM"))
    own = (F.col("_month") == F.col(period)) & F.col("_in")
    values = [F.when(own, F.col(c)).alias(c) for c in df.columns if c not in (entity, period)]
    if activity:
        values.append(own.cast("int").alias(activity))
    return rows.select(entity, F.col("_month").alias(period), *values)


def onto_skeleton(
    aggregate: DataFrame,
    start: str,
    end: str,
    fill: Sequence[str],
    activity: str | None = None,
    entity: str = "entity",
    period: str = "period",
) -> DataFrame:
    """Complete grid of the aggregate's entities; listed columns are 0 where absent."""
    return zero_fill(complete_grid(aggregate, start, end, activity, entity, period), fill)


def left_chain(base: DataFrame, sources: Sequence[DataFrame], keys: Sequence[str] = ("entity", "period")) -> DataFrame:
    """Left join of each source in turn on the same key.

    The base keeps its hash partitioning through the chain: one exchange per
    source and one for the base.
    """
    return reduce(lambda left, right: left.join(right, list(keys), "left"), sources, base)


def outer_merge(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] = ("entity", "period"),
    fill_prefixes: Sequence[str] = (),
    fill_except: Sequence[str] = (),
) -> DataFrame:
    """Full outer join of two panels.

    A column on both sides keeps the left version.  Columns starting with a
    prefix in ``fill_prefixes`` become 0 where missing, except those listed.
    """
    overlap = [c for c in right.columns if c in left.columns and c not in keys]
    merged = left.join(right.drop(*overlap), list(keys), "full_outer")
    fill = [c for c in merged.columns if c.startswith(tuple(fill_prefixes)) and c not in fill_except]
    return zero_fill(merged, fill) if fill_prefixes and fill else merged


def merge_panels(
    panels: Sequence[DataFrame],
    entity: str = "entity",
    period: str = "period",
    partitions: int | None = None,
    unique: bool = True,
) -> DataFrame:
    """Full outer merge of any number of panels with unique keys.

    A panel with two rows at one key is an error; with ``unique`` false they are
    folded, column by column, to the largest value, for reports on faulty panels.

    The panels are stacked and folded by key: one shuffle by entity for all of
    them, where a chain of outer joins shuffles the growing result again for
    every panel.  Windows by entity reuse the partitioning.  A column in several
    panels keeps its first version, also where that is NULL.
    """
    taken: set[str] = {entity, period}
    parts = []
    for number, panel in enumerate(panels):
        own = [c for c in panel.columns if c not in taken]
        taken.update(own)
        parts.append(panel.select(entity, period, *own, F.lit(number).alias("_panel")))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    spread = stacked.repartition(partitions, entity) if partitions else stacked.repartition(entity)
    values = [c for c in stacked.columns if c not in (entity, period, "_panel")]
    counts = {f"_rows_{i}": F.count_if(F.col("_panel") == i) for i in range(len(parts))}
    # At most one panel knows a column at a key, so max picks that value.
    folded = spread.groupBy(entity, period).agg(
        *[F.max(c).alias(c) for c in values], *[v.alias(k) for k, v in counts.items()]
    )
    if not unique:
        return folded.drop(*counts)
    several = reduce(lambda a, b: a | b, [F.col(k) > 1 for k in counts])
    fault = F.raise_error(F.concat_ws(" ", F.lit("a panel has several rows for"), F.col(entity), F.col(period)))
    return folded.withColumn(period, F.when(several, fault.cast(folded.schema[period].dataType)).otherwise(F.col(period))).drop(*counts)


def spread_globals(
    df: DataFrame, columns: Sequence[str], entity: str = "entity", period: str = "period"
) -> DataFrame:
    """Give every entity the month's value of country-invariant columns.

    The value is the first non-null one in entity order.  The lookup has one
    row per month, a size the calendar bounds, so it is broadcast.
    """
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(entity))).alias(c) for c in present]
    monthly = df.groupBy(period).agg(*first)
    return df.drop(*present).join(F.broadcast(monthly), period, "left")


def attach_monthly(df: DataFrame, series: DataFrame, period: str = "period") -> DataFrame:
    """Join a series to every entity; its months must be unique, so the broadcast is bounded by the calendar."""
    return df.join(F.broadcast(unique_rows(series, [period])), period, "left")


def join_through_crosswalk(
    df: DataFrame, other: DataFrame, crosswalk: DataFrame, other_code: str, entity: str = "entity", period: str = "period"
) -> DataFrame:
    """Left join to a table keyed by another code system.

    ``crosswalk`` is (entity, code).  The other table is recoded first: it then
    shares the panel's key and the panel is shuffled once.
    """
    table = crosswalk.select(F.col("entity").alias(entity), F.col("code").alias(other_code))
    recoded = other.join(table, other_code).drop(other_code)
    return df.join(recoded, [entity, period], "left")


def annual_to_monthly(df: DataFrame, year: str = "year", period: str = "period") -> DataFrame:
    """Repeat each annual row for its twelve months (no interpolation)."""
    months = F.explode(F.sequence(F.lit(1), F.lit(12))).alias("_month")
    return df.select("*", months).withColumn(
        period, scalar.period_of_parts(F.col(year), F.col("_month"))
    ).drop("_month")


def unique_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows, failing at run time if a key occurs twice."""
    values = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.struct(*values)).alias("_row")
    )
    checked = F.when(F.col("_n") == 1, F.col("_row")).otherwise(
        F.raise_error(F.concat_ws(" ", F.lit("duplicate key"), *[F.col(k).cast("string") for k in keys]))
    )
    return grouped.select(*keys, checked.alias("_row")).select(*keys, "_row.*")


def backfill(
    df: DataFrame, lookup: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("entity", "period")
) -> DataFrame:
    """Fill NULL cells of the listed columns from a lookup with unique keys."""
    shared = [c for c in columns if c in df.columns and c in lookup.columns]
    if not shared:
        return df
    source = unique_rows(lookup.select(*keys, *shared), keys)
    source = source.withColumnsRenamed({c: f"_fill_{c}" for c in shared})
    joined = df.join(source, list(keys), "left")
    filled = {c: F.coalesce(F.col(c), F.col(f"_fill_{c}")) for c in shared}
    return joined.withColumns(filled).select(*df.columns)


def integrate_events(
    panel: DataFrame,
    events: DataFrame,
    event: str,
    columns: Sequence[str],
    cumulative: str,
    since: str,
    entity: str = "entity",
    period: str = "period",
) -> DataFrame:
    """Left join monthly event columns, 0 where absent, plus event history.

    ``cumulative`` counts event months so far, ``since`` the rows since the last.
    """
    joined = panel.join(events.select(entity, period, *columns), [entity, period], "left")
    joined = joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in columns})
    joined = windows.cumulative_events(joined, event, cumulative, entity, period)
    return windows.periods_since(joined, F.col(event) == 1, since, entity, period)


def key_overlap(panels: Mapping[str, DataFrame], entity: str = "entity", period: str = "period") -> DataFrame:
    """(metric, n): shared entities of each pair and of all, entities only in one
    panel, and duplicate keys per panel.

    Keys meet as bits, 64 months in a word; duplicates are rows beyond the bits.
    """
    names = list(panels)
    words = monthsets.words(panels, entity, period)
    per_entity = words.groupBy(entity).agg(
        *[F.bool_or(F.col(f"n_{n}") > 0).alias(f"in_{n}") for n in names],
        *[F.sum(F.col(f"n_{n}") - F.bit_count(n)).alias(f"dup_{n}") for n in names],
    )
    metrics = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            metrics[f"shared_{a}_{b}"] = F.count_if(F.col(f"in_{a}") & F.col(f"in_{b}"))
    metrics["shared_all"] = F.count_if(reduce(lambda x, y: x & y, [F.col(f"in_{n}") for n in names]))
    for n in names:
        others = reduce(lambda x, y: x | y, [F.col(f"in_{m}") for m in names if m != n])
        metrics[f"only_{n}"] = F.count_if(F.col(f"in_{n}") & ~others)
        metrics[f"duplicates_{n}"] = F.coalesce(F.sum(f"dup_{n}"), F.lit(0))
    row = per_entity.agg(*[v.cast("long").alias(k) for k, v in metrics.items()])
    return row.unpivot([], list(metrics), "metric", "n")


def overlapping_columns(panels: Mapping[str, DataFrame], keys: Sequence[str] = ("entity", "period")) -> dict[tuple[str, str], list[str]]:
    """Feature names that two panels share, by pair; reads schemas only."""
    names = list(panels)
    return {
        (a, b): sorted((set(panels[a].columns) & set(panels[b].columns)) - set(keys))
        for i, a in enumerate(names)
        for b in names[i + 1 :]
    }


def merge_validation(
    merged: DataFrame,
    panels: Mapping[str, DataFrame],
    entity: str = "entity",
    period: str = "period",
) -> DataFrame:
    """(metric, value): row counts, the union of keys and what each source brought in.

    ``merged`` is right when ``merged_rows`` equals ``union_keys``.
    """
    keys = [entity, period]
    features = {n: [c for c in p.columns if c not in keys and c in merged.columns] for n, p in panels.items()}
    aggs = {
        "merged_rows": F.count(F.lit(1)),
        "entities": F.count_distinct(entity),
        "periods": F.count_distinct(period),
    }
    for name, columns in features.items():
        aggs[f"non_null_{name}"] = F.count(columns[0])
        rate = sum((F.avg(F.col(c).isNull().cast("int")) for c in columns), F.lit(0.0)) / len(columns)
        aggs[f"missing_pct_{name}"] = rate * 100
    row = merged.agg(*[v.cast("double").alias(k) for k, v in aggs.items()])
    row = row.withColumn("max_rows", F.col("entities") * F.col("periods"))
    long = row.unpivot([], row.columns, "metric", "value")
    # Keys meet as bits; one pass over all panels counts their rows and the union.
    union = reduce(lambda a, b: a.bitwiseOR(b), [F.col(n) for n in panels])
    sums = {f"rows_{n}": F.sum(f"n_{n}") for n in panels} | {"union_keys": F.sum(F.bit_count(union))}
    sizes = monthsets.words(panels, entity, period).agg(*[F.coalesce(v, F.lit(0)).cast("double").alias(k) for k, v in sums.items()])
    return long.unionByName(sizes.unpivot([], sizes.columns, "metric", "value"))
