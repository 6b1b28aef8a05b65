"""Line dedup: repeated runs of lines by prefix doubling, with DataFrame operations only.

A document is its sequence of non-blank lines.  A *run* is a stretch of lines with
``min_words`` words or more; a run of which an equal one stands earlier (in an earlier
document by id, or further up) is deleted.

Ranks of suffixes by their first 2**k lines are built for k = 0, 1, ...: at k = 0 a
line's rank is the place of its content among all repeated lines, and the rank at
k + 1 orders the pairs (rank here, rank 2**k lines further on).  Ranks come from a range sort of
the distinct pairs, so equal suffixes share one and order is kept.  A suffix whose prefix occurs once is
settled and leaves, as does one that reaches the end of its document; what stays
shrinks quickly.  Two suffixes have a longest common prefix of at least L lines, 2**k <= L < 2**(k+1),
exactly if their ranks at level k agree at both ends, at 0 and at L - 2**k; so
every suffix looks up the interval of the suffix array that shares the L lines it
needs for ``min_words`` words, and the interval's first member stays.  Deleting that stretch
of every other member deletes every maximal repeated run whole, because a longer
run is the union of such stretches; as L <= min_words, the levels are few.

Skew: hot lines are counted before they are shuffled, distinct pairs are sorted, and
joins back to the lines are plain equi-joins that adaptive execution splits; no line or
run is gathered anywhere.  Every level is a stage in the shared folder.

Edge cases: null and empty texts have no lines and come back unchanged (null as empty);
blank lines never count or vanish, and do not break a run; equal documents lose all their
lines but those of the first, if they have ``min_words`` words; repeated rows (equal id and text) are one document
and come back once per row; null ids come first; an empty table gives an empty result.
Only the two named columns are read; further ones are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stages import Stages, read

BLANK = "^[\\x09-\\x0D\\x20]*$"
WORD = "[^\\x09-\\x0D\\x20]+"
DOC = ["doc", "content"]


def same_doc(left: str, right: str, *columns: str):
    """Join condition on the document (ids may be null) and more columns."""
    first = F.col(f"{left}.doc").eqNullSafe(F.col(f"{right}.doc"))
    return reduce(lambda c, n: c & (F.col(f"{left}.{n}") == F.col(f"{right}.{n}")), ["content", *columns], first)


def ordered(pairs: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows with a number that keeps their order; to be stored before it is used."""
    return pairs.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("rank", F.monotonically_increasing_id())


def lines_of(docs: DataFrame) -> DataFrame:
    """doc, content, seq (place among the non-blank lines), digest, words."""
    some = F.filter(F.split("text", "\n", -1), lambda x: ~x.rlike(BLANK))
    rows = docs.select(*DOC, F.posexplode(some).alias("seq", "line"))
    return rows.select(
        *DOC, "seq", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
        F.regexp_count("line", F.lit(WORD)).alias("words"),
    )


def needed_lines(first: DataFrame, min_words: int) -> DataFrame:
    """Per suffix the lines up to ``min_words`` words: depth (their number) and level; without suffixes too short or not all repeated."""
    order = Window.partitionBy(*DOC).orderBy("seq")
    start = first.withColumn(
        "start", F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    reach = Window.partitionBy(*DOC).orderBy("start").rangeBetween(0, min_words - 1)
    out = start.select(
        *DOC, "seq",
        F.count("*").over(reach).alias("depth"), F.sum("words").over(reach).alias("total"), F.max("seq").over(reach).alias("last"),
    )
    whole = out.where((F.col("total") >= min_words) & (F.col("last") - F.col("seq") + 1 == F.col("depth")))
    return whole.withColumn("level", F.floor(F.log2("depth") + 1e-9).cast("int")).drop("total")


def repeated_lines(docs: DataFrame, min_words: int, stages: Stages) -> DataFrame:
    """doc, content, seq of every line to delete; ``docs`` has doc, content, text."""
    lines = stages.put(lines_of(docs), "lines")
    repeated = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    table = stages.put(ordered(repeated, "h1", "h2"), "ranks-0")
    first = stages.put(lines.join(table, ["h1", "h2"]).select(*DOC, "seq", "words", "rank").distinct(), "level-0")
    stages.drop("lines", "ranks-0")
    wanted = stages.put(needed_lines(first, min_words), "wanted")
    deepest = wanted.agg(F.max("level")).first()[0]  # one row
    if deepest is None:
        return wanted.select(*DOC, "seq")

    levels = [first.select(*DOC, "seq", "rank")]
    for level in range(deepest):
        further = Window.partitionBy(*DOC).orderBy("seq").rangeBetween(1 << level, 1 << level)
        pairs = levels[-1].withColumn("beyond", F.first("rank").over(further)).where("beyond IS NOT NULL")
        shared = pairs.groupBy("rank", "beyond").agg(F.count("*").alias("n")).where("n > 1")
        shared = shared.select(F.col("rank").alias("here"), "beyond")
        table = stages.put(ordered(shared, "here", "beyond"), f"ranks-{level + 1}")
        both = pairs.withColumnRenamed("rank", "here").join(table, ["here", "beyond"])
        levels.append(stages.put(both.select(*DOC, "seq", "rank"), f"level-{level + 1}"))
        stages.drop(f"ranks-{level + 1}")
    ranks = reduce(DataFrame.unionByName, [x.withColumn("level", F.lit(k)) for k, x in enumerate(levels)])

    # The suffix-array interval of each suffix at its depth.
    at = wanted.withColumn("tail", F.col("last") - F.call_function("shiftleft", F.lit(1), F.col("level")) + 1)
    head = at.alias("w").join(ranks.alias("r"), same_doc("w", "r", "level", "seq")).select("w.*", F.col("r.rank").alias("low"))
    tail = F.col("w.doc").eqNullSafe(F.col("r.doc")) & (F.col("w.content") == F.col("r.content"))
    tail = tail & (F.col("w.level") == F.col("r.level")) & (F.col("w.tail") == F.col("r.seq"))
    placed = head.alias("w").join(ranks.alias("r"), tail).select("w.*", F.col("r.rank").alias("high"))
    placed = stages.put(placed.withColumn("place", F.struct("doc", "content", "seq")), "placed")
    interval = ["depth", "low", "high"]
    firsts = placed.groupBy(*interval).agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = placed.join(firsts, interval).where(F.col("place") > F.col("first"))
    return later.select(*DOC, F.explode(F.sequence("seq", "last")).alias("seq")).distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """Per row: id, text (without later copies of repeated runs), n_lines, n_deleted (non-blank lines), n_runs (deleted stretches)."""
    stages = Stages(docs.sparkSession, "lines")
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(
        "content", F.xxhash64("text")
    )
    gone = stages.put(
        repeated_lines(rows, min_words, stages).groupBy(*DOC).agg(F.array_sort(F.collect_list("seq")).alias("gone")), "gone"
    )
    # The texts are shuffled once, at every size: what is to be deleted grows with them.
    joined = rows.alias("d").join(gone.hint("merge").alias("g"), same_doc("d", "g"), "left").select("d.doc", "d.text", "g.gone")
    lines = F.split("text", "\n", -1)
    solid = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("pos"), x.alias("line"))), lambda s: ~s["line"].rlike(BLANK))
    counted = joined.select("doc", "text", "gone", F.size(solid).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNotNull(), F.filter(solid, lambda s, j: F.array_contains("gone", j))["pos"]).alias("places"),
        F.coalesce(F.size(F.filter("gone", lambda j: ~F.array_contains("gone", j - 1))), F.lit(0)).cast("long").alias("n_runs"),
    )
    left = F.filter(lines, lambda x, i: ~F.array_contains("places", i))
    some = F.col("places").isNotNull()
    return counted.select(
        F.col("doc").alias(id_col),
        F.when(some, F.array_join(left, "\n")).otherwise(F.col("text")).alias(text_col),
        "n_lines",
        F.when(some, F.size("places")).otherwise(0).cast("long").alias("n_deleted"),
        F.when(some, F.col("n_runs")).otherwise(0).alias("n_runs"),
    )


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Digest of the texts that remain."""
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_deleted", "n_runs", F.char_length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


# Every stretch is spelled out as text and the first of equal ones kept.
OP6_SQL = """WITH split AS (SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line FROM
    (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
solid AS (SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\\x09-\\x0D\\x20]+')) AS words FROM split
          WHERE NOT regexp_full_match(line, '[\\x09-\\x0D\\x20]*')),
ends AS (SELECT *, row_number() OVER w AS seq, sum(words) OVER w AS upto FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
stretch AS (SELECT a.doc_id, a.seq, min(b.seq) AS last FROM ends a JOIN ends b ON a.doc_id = b.doc_id AND b.upto >= a.upto - a.words + 50
            GROUP BY a.doc_id, a.seq),
spelled AS (SELECT s.doc_id, s.seq, s.last, string_agg(e.line, chr(10) ORDER BY e.seq) AS words FROM stretch s
            JOIN ends e ON e.doc_id = s.doc_id AND e.seq BETWEEN s.seq AND s.last GROUP BY s.doc_id, s.seq, s.last),
later AS (SELECT doc_id, seq, last FROM spelled QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, seq) > 1),
gone AS (SELECT DISTINCT e.doc_id, e.pos, e.seq FROM ends e JOIN later l ON e.doc_id = l.doc_id AND e.seq BETWEEN l.seq AND l.last),
runs AS (SELECT doc_id, count(*) AS n_deleted, count(*) FILTER (prior IS NULL OR prior <> seq - 1) AS n_runs
         FROM (SELECT *, lag(seq) OVER (PARTITION BY doc_id ORDER BY seq) AS prior FROM gone) GROUP BY doc_id),
kept AS (SELECT s.doc_id, string_agg(s.line, chr(10) ORDER BY s.pos) AS text FROM split s ANTI JOIN gone g ON s.doc_id = g.doc_id AND s.pos = g.pos
         GROUP BY s.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_lines, coalesce(r.n_deleted, 0) AS n_deleted, coalesce(r.n_runs, 0) AS n_runs,
       len(coalesce(k.text, '')) AS n_chars, md5(coalesce(k.text, '')) AS text_md5
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM ends GROUP BY doc_id) n USING (doc_id)
LEFT JOIN runs r USING (doc_id) LEFT JOIN kept k USING (doc_id)"""
