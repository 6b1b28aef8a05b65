"""From the merged panel to model input: selection, scaling, splits and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators import preprocess, registry
from workload import base
from workload.base import PANEL, query
from workload.merges import MERGED, stored_merge

TRAIN_END = "1999-12"
VAL_END = "2000-06"
FEATURES = ["event_count", "returned_value", "mean_tone", "rate", "index_mean"]
ROLL_TARGET = "fatalities_best"


def skewed(spark, sf):
    """Merged panel with one heavy-tailed, one constant and one redundant column."""
    df = stored_merge(spark, sf)
    return df.select(
        "entity", "period", *FEATURES, ROLL_TARGET,
        F.exp(F.col(ROLL_TARGET) / 300).alias("heavy"),
        F.when(F.col("period") <= TRAIN_END, 7.0).otherwise(F.col("event_count").cast("double")).alias("still"),
        (F.col("returned_value") * 2).alias("twice"),
    )


SKEWED = f"""{MERGED}, skewed AS (SELECT entity, period, {', '.join(FEATURES)}, fatalities_best, exp(fatalities_best / 300) AS heavy,
   CASE WHEN period <= '{TRAIN_END}' THEN 7.0 ELSE event_count END AS still, returned_value * 2 AS twice FROM merged)"""
ALL = ["event_count", "heavy", "index_mean", "mean_tone", "rate", "returned_value", "still", "twice"]


@query(
    f"WITH {SKEWED} SELECT *, coalesce(min >= 0 AND max > 100 AND skewness > 3, false) AS is_candidate FROM ("
    + " UNION ALL ".join(
        f"(SELECT '{c}' AS feature, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, skewness({c}) AS skewness FROM skewed)"
        for c in ALL
        if c != "still"
    )
    + ")",
    doubles="min max skewness",
)
def log1p_candidates(spark, sf):
    return preprocess.log1p_candidate_stats(skewed(spark, sf), [c for c in ALL if c != "still"])


Z_SQL = ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in FEATURES)
STATS_SQL = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in FEATURES)
ZSCORED = f"""{MERGED}, st AS (SELECT {STATS_SQL} FROM merged WHERE period <= '{TRAIN_END}'),
z AS (SELECT entity, period, {Z_SQL} FROM merged, st)"""


def zscored(spark, sf):
    return preprocess.zscore_train(stored_merge(spark, sf).select("entity", "period", *FEATURES), FEATURES, TRAIN_END)


@query(f"WITH {ZSCORED} SELECT * FROM z", doubles=" ".join(FEATURES))
def zscore_train(spark, sf):
    return zscored(spark, sf)


@query(f"WITH {SKEWED} SELECT entity, period, event_count, rate, returned_value FROM skewed", doubles="rate returned_value")
def drop_constant(spark, sf):
    """The column without spread in the training months goes."""
    df = skewed(spark, sf).select("entity", "period", "event_count", "still", "rate", "returned_value")
    return preprocess.drop_constant(df, ["event_count", "still", "rate", "returned_value"], TRAIN_END)


LIMIT = 2.0


@query(
    f"WITH {ZSCORED} SELECT entity, period, "
    + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN greatest(-{LIMIT}, least({LIMIT}, {c})) END AS {c}" for c in FEATURES)
    + ", (SELECT CAST("
    + " + ".join(f"count(*) FILTER (abs({c}) > {LIMIT})" for c in FEATURES)
    + " AS BIGINT) FROM z) AS n_clipped FROM z",
    doubles=" ".join(FEATURES),
)
def clip_sigma(spark, sf):
    """Clipped scores and the number of clipped cells (a scalar subquery)."""
    z = zscored(spark, sf)
    n = preprocess.count_beyond(z, FEATURES, LIMIT).scalar()
    return preprocess.clip_sigma(z, FEATURES, LIMIT).withColumn("n_clipped", n)


@query(
    f"WITH {ZSCORED} SELECT entity, period, "
    + ", ".join(f"coalesce({c}, 0) AS {c}" for c in FEATURES)
    + ", (SELECT CAST("
    + " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in FEATURES)
    + " AS BIGINT) FROM z) AS n_missing FROM z",
    doubles=" ".join(FEATURES),
)
def fill_mean_zero(spark, sf):
    z = zscored(spark, sf)
    missing = preprocess.count_missing(z, FEATURES).select("n_missing").scalar()
    return preprocess.fill_mean_zero(z, FEATURES).withColumn("n_missing", missing)


KEPT = ["event_count", "heavy", "index_mean", "mean_tone", "rate", "returned_value"]
ALREADY = ["event_count", "index_mean", "mean_tone", "rate", "returned_value", "twice", "still"]
P_BASE = f"""{SKEWED}, pl AS (SELECT entity, period, {', '.join(c for c in KEPT if c != 'heavy')}, ln(1 + heavy) AS heavy, fatalities_best FROM skewed),
ps AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in KEPT)} FROM pl WHERE period <= '{TRAIN_END}')"""


def preprocessed(spark, sf):
    return preprocess.preprocess_panel(
        skewed(spark, sf), ROLL_TARGET, TRAIN_END, already_log1p=ALREADY, redundant=["twice"]
    )


@query(
    f"WITH {P_BASE} SELECT entity, period, "
    + ", ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE greatest(-10, least(10, ({c} - m_{c}) / s_{c})) END AS {c}" for c in KEPT)
    + ", fatalities_best FROM pl, ps",
    doubles=" ".join([*KEPT, ROLL_TARGET]),
)
def preprocess_panel(spark, sf):
    """Candidates to log1p, redundant and constant columns out, training z-scores, clip, fill."""
    return preprocessed(spark, sf).panel


def _registry_sql(c: str) -> str:
    """One feature: gone if constant in training, dropped if redundant, else kept."""
    already = str(c in ALREADY).lower()
    candidate = "false" if c in ALREADY else f"coalesce(min({c}) >= 0 AND max({c}) > 100 AND skewness({c}) > 3, false)"
    if c == "twice":
        return "(SELECT 'twice' AS feature, 'dropped_redundant' AS status, false AS log1p_applied, false AS was_already_log1p FROM skewed HAVING count(*) > 0)"
    return f"""(SELECT '{c}' AS feature, 'kept' AS status, {candidate} AS log1p_applied, {already} AS was_already_log1p FROM skewed
      HAVING NOT coalesce(stddev_samp({c}) FILTER (period <= '{TRAIN_END}') < 1e-10, false))"""


@query(f"WITH {SKEWED} " + " UNION ALL ".join(_registry_sql(c) for c in ALL))
def preprocess_registry(spark, sf):
    """Registry of what preprocessing decided on the data."""
    done = preprocessed(spark, sf)
    return registry.preprocess_registry(done.panel, done.features, done.redundant, done.log1p, ALREADY)


PRUNE = ["event_count", "heavy", "rate", "returned_value", "twice", "target_like"]
PRUNE_LIMIT = 0.3


def _prune_source(spark, sf):
    return skewed(spark, sf).withColumn("target_like", F.col(ROLL_TARGET) + F.col("event_count") * 3)


# Strong pairs in column order, then the walk over them one by one.
@query(
    f"""WITH RECURSIVE {SKEWED}, src AS (SELECT *, {ROLL_TARGET} + event_count * 3 AS target_like FROM skewed),
    strength(name, place, s) AS ({" UNION ALL ".join(f"SELECT '{c}', {i}, coalesce(abs(corr({c}, {ROLL_TARGET})), 0) FROM src" for i, c in enumerate(PRUNE))}),
    pairs(a, b, r) AS ({" UNION ALL ".join(f"SELECT '{a}', '{b}', corr({a}, {b}) FROM src" for i, a in enumerate(PRUNE) for b in PRUNE[i + 1:])}),
    edges AS (SELECT row_number() OVER (ORDER BY x.place, y.place) AS k, a, b, r, x.s >= y.s AS keeps FROM pairs
      JOIN strength x ON a = x.name JOIN strength y ON b = y.name WHERE abs(r) > {PRUNE_LIMIT}),
    walk(k, turn, idle, gone, loser, winner, r) AS (
      SELECT 0::BIGINT, '', false, []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE UNION ALL
      SELECT k, turn, idle, CASE WHEN hit THEN list_append(gone, lost) ELSE gone END,
             CASE WHEN hit THEN lost END, CASE WHEN hit THEN won END, CASE WHEN hit THEN r END
      FROM (SELECT *, NOT idle AND NOT list_contains(gone, b) AND NOT list_contains(gone, lost) AS hit FROM (
        SELECT e.k, e.a AS turn, CASE WHEN e.a = w.turn THEN w.idle ELSE list_contains(w.gone, e.a) END AS idle, w.gone, e.b, e.r,
               CASE WHEN keeps THEN e.b ELSE e.a END AS lost, CASE WHEN keeps THEN e.a ELSE e.b END AS won
        FROM walk w JOIN edges e ON e.k = w.k + 1)))
    SELECT loser AS feature, winner AS partner, r FROM walk WHERE loser IS NOT NULL""",
    doubles="r",
)
def redundancy_prune(spark, sf):
    """Of two columns with a strong correlation the one closer to the target stays."""
    df = _prune_source(spark, sf)
    _, dropped = preprocess.redundancy_prune(df, PRUNE, ROLL_TARGET, PRUNE_LIMIT)
    return df.sparkSession.createDataFrame(dropped, "feature STRING, partner STRING, r DOUBLE")


@query(
    f"""WITH {PANEL} SELECT CASE WHEN period <= '{TRAIN_END}' THEN 'train' WHEN period <= '{VAL_END}' THEN 'val' ELSE 'test' END AS split,
    count(*) AS n, min(period) AS first_period, max(period) AS last_period FROM panel GROUP BY 1"""
)
def time_split(spark, sf):
    split = preprocess.time_split(base.conflict_panel(spark, sf), TRAIN_END, VAL_END)
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("period").alias("first_period"), F.max("period").alias("last_period")
    )


@query(
    f"""WITH {PANEL} SELECT entity, period, CAST(CASE WHEN fatalities_best > 2500 THEN 10 WHEN fatalities_best > 1500 THEN 5
    WHEN fatalities_best > 0 THEN 3 ELSE 1 END AS DOUBLE) AS weight FROM panel"""
)
def strata_weights(spark, sf):
    weight = preprocess.strata_weight(F.col("fatalities_best"), ((2500.0, 10.0), (1500.0, 5.0), (0.0, 3.0)))
    return base.conflict_panel(spark, sf).select("entity", "period", weight.alias("weight"))


def _stream_sql(source: str, text: str, counter: str, step: str) -> str:
    """Numbers u in (0, 1) with 53 bits, from counter-named pairs of 32 bits."""
    key = base.philox_sql(source, base.keyed_sql(1, text), counter, base.keyed_sql(9, text), ("_a", "_b"), f"{step}_pair")
    return f"{key}, {step} AS (SELECT *, (floor(_a * 4294967296.0) * 2097152.0 + floor(_b * 2097152.0) + 0.5) / 9007199254740992.0 AS u FROM {step}_pair)"


@query(
    f"""WITH {PANEL}, w AS (SELECT entity, period, fatalities_best, CASE WHEN fatalities_best > 500 THEN 10.0::DOUBLE WHEN fatalities_best > 50 THEN 5.0
      WHEN fatalities_best > 0 THEN 3.0 ELSE 1.0 END AS weight, md5('42|' || entity || '|' || period) AS digest FROM panel),
    t AS (SELECT count(*) AS n, greatest(1, ceil(log2(count(*)) / 8))::INTEGER AS digits FROM w),
    r AS (SELECT *, digest[1:digits] AS bucket FROM w, t),
    b AS (SELECT bucket, sum(weight) AS held FROM r GROUP BY bucket),
    bs AS (SELECT *, coalesce(sum(held) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(held) OVER () AS total FROM b),
    first0 AS (SELECT unnest(range(0, n)) AS i FROM t),
    {_stream_sql('first0', "'42|buckets'", 'i', 'first1')},
    first2 AS (SELECT u * (SELECT max(total) FROM bs) AS place FROM first1),
    c AS (SELECT bucket, count(*) AS draws FROM first2 ASOF JOIN bs ON place >= start GROUP BY bucket),
    second0 AS (SELECT bucket, held, unnest(range(0, draws)) AS j FROM c JOIN b USING (bucket)),
    {_stream_sql('second0', "'42|' || bucket", 'j', 'second1')},
    second2 AS (SELECT bucket, u * held AS place FROM second1),
    rs AS (SELECT *, coalesce(sum(weight) OVER (PARTITION BY bucket ORDER BY digest, entity, period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM r),
    d AS (SELECT entity, period, fatalities_best, weight, count(*) AS copies
          FROM second2 ASOF JOIN rs ON second2.bucket = rs.bucket AND place >= start GROUP BY entity, period, fatalities_best, weight)
    SELECT entity, period, fatalities_best, weight, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS draw FROM d""",
    doubles="fatalities_best",
)
def weighted_resample(spark, sf):
    """Rows drawn with replacement in proportion to their stratum weight."""
    df = base.conflict_panel(spark, sf).select("entity", "period", "fatalities_best")
    weighted = df.withColumn("weight", preprocess.strata_weight(F.col("fatalities_best")))
    return preprocess.weighted_resample(weighted, "weight", ["entity", "period"])
