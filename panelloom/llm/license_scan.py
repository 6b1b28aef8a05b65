"""License scans with ordered signature rules, as expressions only.

The text is brought into words once; documents without any keyword of any
rule stop there.  For the rest, the rules whose keyword is among the document's
words are picked from the table (an array literal, so nothing is
joined or shuffled), their regular expressions run, and every match becomes an
interval of word numbers.  A match inside a match of a rule of higher priority (an
earlier one in the table), or strictly inside any longer match, is suppressed; the
labels of the others stay.  The base phrases are found by themselves and are never suppressed.

Everything is a projection over one row: no shuffle, no hot group.

Edge cases: null and empty texts have no words and no labels; a word is found at any length of
text; overlapping places of a base phrase all count; equal matches of two
rules keep the earlier rule; repeated rows and null ids come back once per row; an empty table gives an
empty result.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import BASE, RULES, Rule, pattern
from .stages import read

WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """Words in lower case, each between two spaces of its own."""
    inner = F.regexp_replace(F.translate(text, UPPER, LOWER), GAP, "  ")
    return F.concat(F.lit(" "), F.trim(inner), F.lit(" "))


def telling(rules: list[Rule]) -> Column:
    """All keywords, and the first word of every base phrase."""
    return F.array(*[F.lit(w) for w in sorted({r.keyword for r in rules} | {phrase.split(" ")[0] for phrase in BASE})])


def word_number(text: Column, place: Column) -> Column:
    """Words that begin before a place (from 1) of the spaced text."""
    before = F.substring(text, F.lit(1), place - 1)
    return ((F.length(before) - F.length(F.replace(before, F.lit(" "))) + 1) / 2).cast("int")


def rule_table(rules: list[Rule]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(r.label).alias("label"),
                F.lit(r.priority).alias("priority"),
                F.lit(r.keyword).alias("keyword"),
                F.lit(pattern(r.words)).alias("pattern"),
                F.lit(r.weight).alias("weight"),
            )
            for r in rules
        ]
    )


def places(text: Column, found: Column) -> Column:
    """Start of each of the given matches of one expression, which are in order and do not overlap."""
    state = F.aggregate(
        found,
        F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("starts")),
        lambda s, m: F.struct(
            (F.call_function("locate", m, text, s["next"]) + F.length(m)).alias("next"),
            F.concat(s["starts"], F.array(F.call_function("locate", m, text, s["next"]))).alias("starts"),
        ),
    )
    return state["starts"]


def matches(text: Column, present: Column, rules: list[Rule]) -> Column:
    """All matches of the rules whose keyword is present: label, priority, weight, first and last place."""
    live = F.filter(rule_table(rules), lambda r: F.array_contains(present, r["keyword"]))

    def of(r):
        found = F.regexp_extract_all(text, r["pattern"], F.lit(0))
        return F.transform(
            F.arrays_zip(places(text, found).alias("first"), found.alias("words")),
            lambda m: F.struct(
                r["label"].alias("label"),
                r["priority"].alias("priority"),
                r["weight"].alias("weight"),
                m["first"].alias("first"),
                (m["first"] + F.length(m["words"])).alias("end"),
            ),
        )

    return F.flatten(F.transform(live, of))


def surviving(found: Column) -> Column:
    """Matches not contained in one of higher priority, nor strictly contained in any."""

    def inside(m):
        def covers(o):
            longer = (o["end"] - o["first"]) > (m["end"] - m["first"])
            return (o["first"] <= m["first"]) & (o["end"] >= m["end"]) & (longer | (o["priority"] < m["priority"]))

        return covers

    return F.filter(found, lambda m: ~F.exists(found, inside(m)))


def base_counts(text: Column) -> tuple[Column, Column, Column, Column]:
    """Places of the base phrases: number, first and last word, labels."""
    number, first, last, labels = F.lit(0).cast("long"), [], [], []
    turned = F.reverse(text)
    for phrase, label in BASE.items():
        form = pattern(phrase)
        # Every word owns its spaces, and no phrase overlaps itself, so matches do not hide one another.
        number = number + F.regexp_count(text, F.lit(form)).cast("long")
        at, back = F.instr(text, F.lit(form)), F.instr(turned, F.lit(form[::-1]))
        first.append(F.when(at > 0, word_number(text, at)))
        last.append(F.when(back > 0, word_number(text, F.length(text) - back + 1 - len(form) + 1)))
        labels.append(F.when(at > 0, F.lit(label)))
    return number, F.least(*first), F.greatest(*last), F.array_compact(F.array(*labels))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` are the surviving matches with their label and first and last word; the score is
    the weight of the surest of them, or 0.75 for a base phrase alone.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    # The words once, for their number and the gate; other letters than A-Z do not matter to either.
    words = docs.select(F.col(id_col).alias("id"), raw.alias("raw"), F.regexp_extract_all(F.lower(raw), F.lit(WORD), F.lit(0)).alias("words"))
    rows = words.select(
        "id", "raw", F.size("words").cast("long").alias("n_words"), F.array_intersect(telling(rules), "words").alias("present")
    ).select("id", "n_words", "present", F.when(F.size("present") > 0, spaced(F.col("raw"))).alias("text"))
    text = F.col("text")
    number, first, last, labels = base_counts(text)
    rows = rows.select(
        "id", "n_words", "text",
        number.alias("n_base"), first.alias("first_word"), last.alias("last_word"), labels.alias("base"),
        F.when(text.isNotNull(), matches(text, F.col("present"), rules)).alias("found"),
    ).select("*", surviving(F.col("found")).alias("kept"))
    empty = F.array().cast("array<string>")
    base = F.array_sort(F.array_distinct(F.coalesce("base", empty)))
    own = F.coalesce(F.transform("kept", lambda m: m["label"]), empty)
    surest = F.coalesce(F.array_max(F.transform("kept", lambda m: m["weight"])), F.lit(0.0))
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.concat_ws(",", base).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(base, own))).alias("labels"),
        F.greatest(surest, F.when(F.size(base) > 0, 0.75).otherwise(0.0)).alias("score"),
        F.transform(
            F.coalesce("kept", F.array()),
            lambda m: F.struct(
                m["label"].alias("label"),
                word_number(text, m["first"]).alias("first_word"),
                (word_number(text, m["end"]) - 1).alias("last_word"),
            ),
        ).alias("spans"),
    )


def op7_license_scans(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).drop("spans")


def oracle_sql(rules: list[Rule] = RULES) -> str:
    """The same scan in SQL: matches step by step, suppression by an anti join."""

    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    table = ", ".join(f"({q(r.label)}, {r.priority}, {q(f' {r.keyword} ')}, {q(pattern(r.words))}, {r.weight})" for r in rules)
    base = ", ".join(f"({q(pattern(p))}, {q(label)}, {len(p.split())})" for p, label in BASE.items())
    return f"""WITH RECURSIVE
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
t AS (SELECT doc_id, len(w) AS n_words, ' ' || array_to_string(w, '  ') || ' ' AS s FROM words),
rules(label, priority, keyword, pattern, weight) AS (VALUES {table}),
base(form, label, size) AS (VALUES {base}),
found AS (SELECT doc_id, s, label, priority, weight, regexp_extract_all(s, pattern) AS m FROM t JOIN rules ON contains(s, keyword)),
steps AS (
  SELECT doc_id, s, label, priority, weight, m, 1 AS k, strpos(s, m[1]) AS first FROM found WHERE len(m) > 0
  UNION ALL
  SELECT doc_id, s, label, priority, weight, m, k + 1, first + len(m[k]) - 1 + strpos(substr(s, first + len(m[k])), m[k + 1])
  FROM steps WHERE k < len(m)),
spans AS (SELECT doc_id, label, priority, weight, first, first + len(m[k]) AS stop FROM steps),
kept AS (SELECT * FROM spans a WHERE NOT EXISTS (SELECT 1 FROM spans o WHERE o.doc_id = a.doc_id AND o.first <= a.first AND o.stop >= a.stop
          AND (o.stop - o.first > a.stop - a.first OR o.priority < a.priority))),
basic AS (SELECT doc_id, label, n_words, size, string_split(s, form) AS parts FROM t JOIN base ON contains(s, form)),
basics AS (SELECT doc_id, label, len(parts) - 1 AS n,
    (len(parts[1]) - len(replace(parts[1], ' ', ''))) // 2 AS lo,
    n_words - size - (len(parts[-1]) - len(replace(parts[-1], ' ', ''))) // 2 AS hi FROM basic),
summed AS (SELECT doc_id, sum(n)::BIGINT AS n_base, min(lo) AS first_word, max(hi) AS last_word, list(label) AS labels FROM basics GROUP BY doc_id),
ours AS (SELECT doc_id, list(label) AS labels, max(weight) AS weight FROM kept GROUP BY doc_id)
SELECT t.doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(list_distinct(b.labels)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(o.labels, [])))), ','), '') AS labels,
  greatest(coalesce(o.weight, 0), CASE WHEN b.labels IS NULL THEN 0 ELSE 0.75 END)::DOUBLE AS score
FROM t LEFT JOIN summed b USING (doc_id) LEFT JOIN ours o USING (doc_id)"""


OP7_SQL = oracle_sql()
