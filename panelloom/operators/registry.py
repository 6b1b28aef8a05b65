"""Feature registries: one metadata row per column of a finished panel."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.operators import profile


def first_match(name: Column, rules: Sequence[tuple[str, str, str]], default: str) -> Column:
    """Label of the first rule that matches a feature name.

    A rule is (kind, text, label) with kind ``prefix``, ``suffix`` or ``name``.
    """
    out = None
    for kind, text, label in rules:
        test = {"prefix": name.startswith(text), "suffix": name.endswith(text), "name": name == text}[kind]
        out = F.when(test, label) if out is None else out.when(test, label)
    return F.lit(default) if out is None else out.otherwise(default)


# Source of a conflict-panel feature by prefix.
CONFLICT_SOURCES = [("prefix", "ucdp_", "UCDP"), ("prefix", "acled_", "ACLED")]
CONFLICT_DEFAULT = "GDELT"

# Source of a structural-panel feature, first match wins.
STRUCTURAL_SOURCES = [
    ("prefix", "v2x_", "V-Dem"),
    ("prefix", "regime_type_", "V-Dem"),
    ("name", "governance_deficit", "V-Dem"),
    ("name", "repression_index", "V-Dem"),
    ("name", "libdem_yoy_change", "V-Dem"),
    ("prefix", "reign_", "REIGN"),
    ("name", "tenure_months", "REIGN"),
    ("name", "age", "REIGN"),
    ("name", "male", "REIGN"),
    ("name", "militarycareer", "REIGN"),
    ("name", "elected", "REIGN"),
    ("name", "leader_age_risk", "REIGN"),
    ("name", "months_since_election", "REIGN"),
    ("name", "regime_change", "REIGN"),
    ("name", "coup_event", "REIGN"),
    ("name", "prev_conflict", "REIGN"),
    ("name", "precip", "REIGN"),
    ("name", "months_since_structural_break", "REIGN"),
    ("name", "vdem_stale_flag", "REIGN"),
    ("prefix", "fx_", "IMF IFS"),
    ("prefix", "gdp_", "World Bank"),
    ("prefix", "food_", "FAO"),
    ("prefix", "pt_", "Powell & Thyne"),
    ("suffix", "_available", "Derived (missingness)"),
]
STRUCTURAL_DEFAULT = "V-Dem"


def panel_registry(
    df: DataFrame,
    features: Sequence[str],
    rules: Sequence[tuple[str, str, str]],
    default: str,
    log1p: Collection[str] | None = None,
    lag_months: int = 1,
    unlagged: Collection[str] = (),
) -> DataFrame:
    """(feature_name, source, dtype, missing_pct, mean, std, min, max, [log1p_applied], lag_months)."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in features])
    stats = profile.per_column(
        doubles,
        features,
        {
            "missing_pct": lambda c: F.round(F.avg(c.isNull().cast("double")) * 100, 2),
            "mean": lambda c: F.round(F.avg(c), 4),
            "std": lambda c: F.round(F.stddev_samp(c), 4),
            "min": lambda c: F.round(F.min(c), 4),
            "max": lambda c: F.round(F.max(c), 4),
        },
    )
    name = F.col("feature")
    types = F.create_map(*[F.lit(x) for f in df.schema.fields if f.name in features for x in (f.name, f.dataType.simpleString())])
    out = stats.select(
        name.alias("feature_name"),
        first_match(name, rules, default).alias("source"),
        F.element_at(types, name).alias("dtype"),
        "missing_pct", "mean", "std", "min", "max",
        *([name.isin(list(log1p)).alias("log1p_applied")] if log1p is not None else []),
        F.when(name.isin(list(unlagged)), 0).otherwise(lag_months).alias("lag_months"),
    )
    return out


def volatility_registry(
    profiles: DataFrame,
    missing: DataFrame,
    pairs: DataFrame,
    source_rules: Sequence[tuple[str, str, str]],
    default_source: str,
    daily_prefixes: Sequence[str] = (),
    redundant: Collection[str] = (),
    log1p: Collection[str] = (),
) -> DataFrame:
    """Registry rows from classified profiles, missing rates and correlated pairs.

    A feature listed as redundant is dropped, one without variance is up for
    review, others are kept.  ``correlated_with`` lists partners with |r| > 0.9.
    """
    strong = pairs.filter(F.abs("r") > 0.9)
    both = strong.select(F.col("feature_a").alias("feature"), F.col("feature_b").alias("other"), "r").unionByName(
        strong.select(F.col("feature_b").alias("feature"), F.col("feature_a").alias("other"), "r")
    )
    # Partners of a feature: at most one per column of the panel.
    partners = both.groupBy("feature").agg(
        F.array_sort(F.collect_list(F.struct("other", "r"))).alias("_p")
    )
    text = F.transform("_p", lambda p: F.concat(p["other"], F.format_string("(%.2f)", p["r"])))
    name = F.col("feature")
    listed = name.isin(list(redundant))
    still = F.col("distribution_type") == "near-zero-variance"
    daily = F.lit(False)
    for prefix in daily_prefixes:
        daily = daily | name.startswith(prefix)
    joined = profiles.join(missing.select("feature", "missing_pct"), "feature", "left").join(partners, "feature", "left")
    joined = joined.withColumn("_p", F.coalesce("_p", F.array().cast("array<struct<other:string,r:double>>")))
    first = F.when(F.size("_p") > 0, F.col("_p")[0]["other"]).otherwise("?")
    return joined.select(
        name.alias("feature_name"),
        first_match(name, source_rules, default_source).alias("source"),
        F.when(daily, "daily (agg to monthly)").otherwise("monthly").alias("original_resolution"),
        F.when(daily, "monthly mean/std/last").otherwise("none (already monthly)").alias("aggregation_method"),
        F.lit("t-1").alias("lag_applied"),
        F.when(name.isin(list(log1p)), "log1p")
        .when(F.col("transform_rec") == "raw (bounded index)", "raw (bounded)")
        .otherwise("raw")
        .alias("transform"),
        F.round("missing_pct", 2).alias("pct_missing"),
        "distribution_type",
        F.concat_ws("; ", text).alias("correlated_with"),
        F.when(listed, F.concat(F.lit("redundant (r>0.9 with "), first, F.lit(")")))
        .when(still, "near-zero variance")
        .otherwise("")
        .alias("known_issues"),
        F.when(listed, "drop").when(still, "review").otherwise("keep").alias("status"),
    )


def preprocess_registry(
    df: DataFrame, kept: Sequence[str], dropped: Sequence[str], transformed: Collection[str], already: Mapping | Collection[str]
) -> DataFrame:
    """(feature, status, log1p_applied, was_already_log1p) of kept and dropped features."""
    rows = [(c, "kept", c in transformed, c in already) for c in kept]
    rows += [(c, "dropped_redundant", False, False) for c in dropped]
    schema = "feature STRING, status STRING, log1p_applied BOOLEAN, was_already_log1p BOOLEAN"
    return df.sparkSession.createDataFrame(rows, schema)
