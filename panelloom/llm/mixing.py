"""Mixing sources to target weights by temperature.

Source shares p of the tokens become weights p**a / sum(p**a).  The exponent a in
[0, 1] is the largest that reaches a target entropy, a share of the logarithm of the number of
sources, raised where needed so that no source is repeated more often than a limit.
Both conditions are monotone in a; the exponent is found by splitting its bracket again and
again, many exponents per pass over the table of sources, which stays distributed.

A source's weight is its token budget.  It is realised as a stream: epoch after epoch
over its documents, each epoch in a new order, until the budget is used up.  An
epoch's order is a block permutation: documents fall into about sqrt(n) blocks by a keyed hash, the
blocks are permuted and so are the documents within each.  Token
offsets need sums within blocks and over blocks only, so a source with a third of
all rows is spread over its blocks.  Stretches of equal fractions of all streams make up the
mixed blocks: each of them holds every source in proportion to its weight.

Edge cases: a null source is the source with the empty name; null and empty texts have 0 tokens and stay in the order;
sources without any tokens get weight 0 and are not drawn; repeated rows are documents of their
own; null ids are ordered by the hash of nothing; an empty table gives an empty result.  A
document that would overrun the budget of its source ends the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stages import Stages, read

ENTROPY = 0.95  # of the maximum
REPETITION = 4.0  # epochs
BLOCK_TOKENS = 1 << 20  # of a mixed block
SEED = "mix"
PARTS = 16  # of the bracket per pass
DIGITS = 6  # of the exponent
WORD = "[^\\x09-\\x0D\\x20]+"


def tokens(docs: DataFrame, text_col: str):
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")


def draw(*parts):
    """Keyed pseudo-random order: a hexadecimal digest."""
    return F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]))


def find_exponent(shares: DataFrame, entropy: float, repetition: float) -> float:
    """``shares`` has one row per source: p > 0; ``repetition`` is relative to the budget in epochs of everything."""
    size = shares.count()
    if size == 0:
        return 1.0
    goal = entropy * F.log(F.lit(float(size)))

    def holds(a: float, condition: str):
        weight = F.pow("p", F.lit(a))
        total = F.sum(weight)
        if condition == "entropy":  # still flat enough
            return F.log(total) - a * F.sum(weight * F.log("p")) / total >= goal
        return F.max(F.pow("p", F.lit(a - 1))) / total > F.lit(repetition)  # still too flat

    brackets = {"entropy": (0.0, 1.0), "repetition": (0.0, 1.0)}
    while max(hi - lo for lo, hi in brackets.values()) > 1e-10:
        grid = {c: [lo + (hi - lo) * i / PARTS for i in range(1, PARTS)] for c, (lo, hi) in brackets.items()}
        row = shares.agg(*[holds(a, c).alias(f"{c}_{i}") for c, g in grid.items() for i, a in enumerate(g)]).first()  # one row
        for c, g in grid.items():
            n = sum(bool(row[f"{c}_{i}"]) for i in range(PARTS - 1))
            points = [brackets[c][0], *g, brackets[c][1]]
            brackets[c] = points[n], points[n + 1]
    return round(max((lo + hi) / 2 for lo, hi in brackets.values()), DIGITS)


def weights(rows: DataFrame, entropy: float, repetition: float, factor: float, stages: Stages) -> DataFrame:
    """Per source: docs, total, weight, budget; ``rows`` has source, tokens."""
    sources = stages.put(rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("total")), "sources")
    everything = sources.agg(F.sum("total")).first()[0] or 0  # one row
    shares = sources.where("total > 0").withColumn("p", F.col("total") / F.lit(float(max(everything, 1))))
    a = find_exponent(shares, entropy, repetition / factor)
    norm = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0  # one row
    weighted = shares.withColumn("weight", F.pow("p", F.lit(a)) / F.lit(norm))
    return weighted.withColumn("budget", F.floor(F.col("weight") * F.lit(float(everything * factor)) + 0.001).cast("long")).drop("p")


def schedule(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    entropy: float = ENTROPY,
    repetition: float = REPETITION,
    factor: float = 1.0,
) -> DataFrame:
    """One row per drawing of a document: id, source, tokens, weight, epoch, place, mixed_block, draw.

    ``place`` is the token offset in the source's stream.  Reading by (mixed_block, draw) gives the mixed stream.  The budget is
    ``factor`` times all tokens.
    """
    stages = Stages(docs.sparkSession, "mixing")
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), tokens(docs, text_col).alias("tokens")
    )
    rows = stages.put(rows, "rows")
    table = stages.put(weights(rows, entropy, repetition, factor, stages), "weights")
    # A source's row is joined to its documents; adaptive execution splits a hot source.
    known = rows.join(table, "source")
    epochs = F.floor(F.col("budget") / F.col("total")).cast("int")
    opened = known.withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs)))
    blocks = F.ceil(F.sqrt("docs")).cast("long")
    number = F.conv(F.substring(draw("id"), 1, 8), 16, 10).cast("long")
    opened = opened.withColumn("block", number % blocks).withColumn("draw", draw("id", "epoch"))
    inner = Window.partitionBy("source", "epoch", "block").orderBy("draw", "id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    opened = opened.withColumn("within", F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
    sums = opened.groupBy("source", "epoch", "block").agg(F.sum("tokens").alias("held"))
    outer = Window.partitionBy("source", "epoch").orderBy(draw("source", "epoch", "block")).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "epoch", "block", F.coalesce(F.sum("held").over(outer), F.lit(0)).alias("start"))
    placed = opened.join(starts, ["source", "epoch", "block"]).withColumn(
        "place", F.col("epoch") * F.col("total") + F.col("start") + F.col("within")
    )
    drawn = placed.where(F.col("place") + F.col("tokens") <= F.col("budget"))
    everything = table.agg(F.sum("budget")).first()[0] or 0  # one row
    mixed = max(1, -(-everything // BLOCK_TOKENS))
    share = F.col("place") / F.greatest(F.col("budget"), F.lit(1))
    return drawn.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "tokens", "weight", "epoch", "place",
        F.least(F.floor(share * mixed), F.lit(mixed - 1)).cast("long").alias("mixed_block"), "draw",
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Every document as often as it is drawn, all columns.

    Rows that are equal in id, source and text share their drawings evenly; what is left over falls on the first ones.
    """
    stages = Stages(docs.sparkSession, "mixed")
    key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (id_col, source_col, text_col)])
    keyed = docs.withColumn("mixing key", key)
    drawn = schedule(keyed, "mixing key", source_col, text_col).groupBy("mixing key").agg(F.count("*").alias("drawings"))
    rows = keyed.groupBy("mixing key").agg(F.count("*").alias("rows"))
    shares = drawn.join(rows, "mixing key").select(
        "mixing key",
        F.floor(F.col("drawings") / F.col("rows")).cast("int").alias("mixing share"),
        (F.col("drawings") % F.col("rows")).alias("mixing rest"),
    )
    shares = stages.put(shares, "shares")

    def repeated(df: DataFrame, times) -> DataFrame:
        return df.select(
            *[F.col(c) for c in docs.columns], F.explode(F.array_repeat(F.lit(1), times)).alias("mixing copy")
        ).drop("mixing copy")

    out = repeated(keyed.join(shares, "mixing key").where("`mixing rest` = 0"), F.col("mixing share"))
    uneven = shares.where("`mixing rest` > 0")
    if uneven.isEmpty():
        return out
    # Equal rows are numbered within the parts of a stored table, and the parts by their counts.
    row = F.monotonically_increasing_id()
    several = stages.put(keyed.join(uneven, "mixing key").withColumn("mixing row", row), "uneven")
    several = several.withColumn("mixing part", F.shiftright("mixing row", 33))
    parts = several.groupBy("mixing key", "mixing part").agg(F.count("*").alias("held"))
    earlier = Window.partitionBy("mixing key").orderBy("mixing part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("mixing key", "mixing part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("mixing start"))
    inner = Window.partitionBy("mixing key", "mixing part").orderBy("mixing row")
    placed = several.withColumn("mixing place", F.row_number().over(inner)).join(parts, ["mixing key", "mixing part"])
    more = (F.col("mixing start") + F.col("mixing place") <= F.col("mixing rest")).cast("int")
    return out.unionByName(repeated(placed, F.col("mixing share") + more))


def op1_mixing_sources(spark, sf_dir: str) -> DataFrame:
    out = schedule(read(spark, sf_dir, "documents"))
    return out.withColumn("weight", F.round("weight", 9))


_P = "list_transform(ps, lambda x: pow(x, {a}))"
_Z = f"list_sum({_P})"
_FLAT = f"ln({_Z}) - {{a}} * list_sum(list_transform(ps, lambda x: pow(x, {{a}}) * ln(x))) / {_Z} >= {ENTROPY} * ln(len(ps))"
_MANY = f"list_max(list_transform(ps, lambda x: pow(x, {{a}} - 1))) / {_Z} > {REPETITION}"


def _bisect(name: str, condition: str) -> str:
    test = condition.format(a="((lo + hi) / 2)")
    return f"""{name}(ps, lo, hi, k) AS (SELECT ps, 0.0::DOUBLE, 1.0::DOUBLE, 0 FROM shares UNION ALL
  SELECT ps, CASE WHEN {test} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {test} THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM {name} WHERE k < 45)"""


def _draw(*parts: str) -> str:
    return "md5(" + " || '|' || ".join([f"'{SEED}'", *[f"coalesce({p}::VARCHAR, '')" for p in parts]]) + ")"


OP1_SQL = f"""WITH RECURSIVE
d AS (SELECT doc_id AS id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x20]+')) AS tokens FROM documents),
s AS (SELECT source, count(*) AS docs, sum(tokens)::BIGINT AS total FROM d GROUP BY source HAVING sum(tokens) > 0),
whole AS (SELECT sum(total)::BIGINT AS n FROM s),
shares AS (SELECT list(total / n::DOUBLE) AS ps FROM s, whole),
{_bisect('flat', _FLAT)},
{_bisect('many', _MANY)},
a AS (SELECT round(greatest((f.lo + f.hi) / 2, (m.lo + m.hi) / 2), {DIGITS}) AS a FROM flat f, many m WHERE f.k = 45 AND m.k = 45),
norm AS (SELECT a, list_sum({_P.format(a='a')}) AS z FROM a, shares),
w AS (SELECT source, docs, total, pow(total / n::DOUBLE, a) / z AS weight, floor(pow(total / n::DOUBLE, a) / z * n + 0.001)::BIGINT AS budget
      FROM s, whole, norm),
o AS (SELECT id, source, tokens, docs, total, weight, budget, unnest(range(0, budget // total + 1)) AS epoch FROM d JOIN w USING (source)),
b AS (SELECT *, ('0x' || substr({_draw('id')}, 1, 8))::BIGINT % ceil(sqrt(docs))::BIGINT AS block, {_draw('id', 'epoch')} AS draw FROM o),
i AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source, epoch, block ORDER BY draw, id, tokens
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM b),
h AS (SELECT source, epoch, block, sum(tokens) AS held FROM b GROUP BY ALL),
t AS (SELECT source, epoch, block, coalesce(sum(held) OVER (PARTITION BY source, epoch ORDER BY {_draw('source', 'epoch', 'block')}
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM h),
p AS (SELECT i.*, (i.epoch * total + start + inside)::BIGINT AS place FROM i JOIN t USING (source, epoch, block)),
m AS (SELECT greatest(1, ceil(sum(budget) / {BLOCK_TOKENS}.0))::BIGINT AS mixed FROM w)
SELECT id AS doc_id, source, tokens, round(weight, 9) AS weight, epoch, place,
       least(floor(place / greatest(budget, 1) * mixed), mixed - 1)::BIGINT AS mixed_block, draw
FROM p, m WHERE place + tokens <= budget"""
