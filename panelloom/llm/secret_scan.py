"""Secret scans over a trigram inverted index.

Every rule's regular expression gives a Boolean query of trigrams (``trigrams``).  The
index is partitioned by documents: each segment, some megabytes of text, holds for every trigram
that any rule asks for the sorted list of its documents with it.  A query
intersects and unites these lists; the documents it leaves are verified by
the expression itself on the whole text.  Rules without mandatory trigrams verify
every document.  As a segment's postings are made, used and dropped in one task,
nothing is shuffled or collected, and no term or document is too frequent for
memory: a list is never longer than its segment.

Postings of all segments are a table of their own in ``postings``, for rules that change
more often than the corpus; ``candidates`` evaluates queries on it by joins.

Edge cases: null and empty texts have no spans; texts of any length are
scanned whole (a long one is a segment of its own); trigrams never cross from one text into
the next; equal spans of two kinds both stay; repeated rows and null
ids come back once per row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .secret_rules import BASE, RULES, Secret
from .stages import read
from .trigrams import Query, mentioned, query_of

PIECE = 1 << 20  # bytes whose trigrams are numbered at once
SPANS = "array<struct<kind:string,start:bigint,stop:bigint>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32


def number(trigram: str) -> int:
    a, b, c = trigram.encode("latin-1")
    return a << 16 | b << 8 | c


class Index:
    """Which trigrams matter; built once per task."""

    def __init__(self, wanted: set[str]):
        self.wanted = np.array(sorted(number(t) for t in wanted), dtype=np.int64)
        self.flags = np.zeros(1 << 24, dtype=bool)
        self.flags[self.wanted] = True

    def segment(self, raw: np.ndarray, offsets: np.ndarray) -> "Segment":
        """Postings of the texts that lie in ``raw`` between the offsets."""
        pairs = [np.zeros(0, np.int64)]
        n = len(offsets) - 1
        for at in range(0, max(len(raw) - 2, 0), PIECE):
            piece = FOLD[raw[at : at + PIECE + 2]].astype(np.int32)
            numbers = piece[:-2] << 16 | piece[1:-1] << 8 | piece[2:]
            place = np.flatnonzero(self.flags[numbers])
            doc = np.searchsorted(offsets, place + at, side="right") - 1
            inside = place + at + 3 <= offsets[doc + 1]
            term = np.searchsorted(self.wanted, numbers[place[inside]])
            pairs.append(np.unique(term * n + doc[inside]))
        pairs = np.unique(np.concatenate(pairs))
        return Segment(n, self.wanted, pairs // max(n, 1), pairs % max(n, 1))


class Segment:
    """For each wanted trigram the ascending numbers of the texts that have it."""

    def __init__(self, size: int, wanted: np.ndarray, term: np.ndarray, doc: np.ndarray):
        self.size, self.wanted, self.doc = size, wanted, doc
        self.bounds = np.searchsorted(term, np.arange(len(wanted) + 1))

    def postings(self, trigram: str) -> np.ndarray:
        i = int(np.searchsorted(self.wanted, number(trigram)))
        return self.doc[self.bounds[i] : self.bounds[i + 1]]

    def find(self, query: Query) -> np.ndarray:
        if query is None:
            return np.arange(self.size)
        if isinstance(query, str):
            return self.postings(query)
        parts = sorted((self.find(q) for q in query[1]), key=len)
        merge = np.intersect1d if query[0] == "and" else np.union1d
        return reduce(lambda a, b: merge(a, b) if query[0] == "or" or len(a) else a, parts)


def compiled(rule: Secret) -> re.Pattern:
    return re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.folded else 0))


def spans_of(text: str, rule: Secret, form: re.Pattern) -> list[tuple[int, int]]:
    """Leftmost matches that do not overlap; those whose group is too short are dropped afterwards."""
    return [m.span() for m in form.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.minimum]


def scanned(rules: list[Secret]):
    """Arrow function: id, text -> id, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [query_of(r.pattern) for r in rules]
        forms = [compiled(r) for r in rules]
        index = Index(set().union(*[mentioned(q) for q in queries]))
        for batch in batches:
            for lo, hi, raw, offsets in H.slices(batch.column(1)):
                segment, texts = index.segment(raw, offsets), {}
                found: list[list[dict]] = [[] for _ in range(hi - lo)]
                for rule, query, form in zip(rules, queries, forms):
                    for d in segment.find(query).tolist():
                        if d not in texts:
                            texts[d] = raw[offsets[d] : offsets[d + 1]].tobytes().decode()
                        found[d] += [{"kind": rule.kind, "start": a, "stop": b} for a, b in spans_of(texts[d], rule, form)]
                for spans in found:
                    spans.sort(key=lambda s: s["start"])  # stable: kinds stay in the order of the rules
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(found, SPAN_TYPE)], names=["id", "spans"])

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Secret] = RULES) -> DataFrame:
    """Per row: the id and its spans (kind, start, stop in code points), by start and then by the order of the rules."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(scanned(rules), f"id {id_type}, spans {SPANS}").withColumnRenamed("id", id_col)


def postings(docs: DataFrame, id_col: str, text_col: str = "text", rules: list[Secret] = RULES) -> DataFrame:
    """The index as a table: (trigram, ids), one row per segment and trigram; rows without an id have no place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sorted(set().union(*[mentioned(query_of(r.pattern)) for r in rules]))
        index = Index(set(terms))
        for batch in batches:
            for lo, hi, raw, offsets in H.slices(batch.column(1)):
                segment, ids = index.segment(raw, offsets), batch.column(0).slice(lo, hi - lo)
                lists = [segment.postings(t) for t in terms]
                counts = np.array([len(x) for x in lists], dtype=np.int64)
                flat = ids.take(pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)))
                at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                held = np.flatnonzero(counts > 0)
                out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.ListArray.from_arrays(at, flat)], names=["trigram", "ids"])
                yield out.take(pa.array(held))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    return rows.mapInArrow(run, f"trigram string, ids array<{rows.schema['id'].dataType.simpleString()}>")


def candidates(index: DataFrame, rules: list[Secret] = RULES) -> DataFrame:
    """(kind, id) that the stored index cannot rule out, for the rules with mandatory trigrams.

    Each id carries the set of its trigrams among those asked for, which the rules bound; queries become expressions.
    """
    held = index.select("trigram", F.explode("ids").alias("id")).groupBy("id").agg(F.collect_set("trigram").alias("held"))

    def holds(query: Query) -> Column:
        if isinstance(query, str):
            return F.array_contains("held", query)
        parts = [holds(q) for q in query[1]]
        return reduce(lambda a, b: a & b if query[0] == "and" else a | b, parts)

    asked = [(r.kind, query_of(r.pattern)) for r in rules]
    kinds = F.array_compact(F.array(*[F.when(holds(q), F.lit(kind)) for kind, q in asked if q is not None]))
    return held.select(F.explode(kinds).alias("kind"), "id")


def op13_secret_scans(spark, sf_dir: str) -> DataFrame:
    base = [r.kind for r in BASE]
    found = find_secrets(read(spark, sf_dir, "documents"))
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    plain = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *[count(k) for k in base], F.sha2(listed(plain), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def oracle_sql(rules: list[Secret] = RULES) -> str:
    """Every rule on every text, matches placed one after the other."""

    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    table = ", ".join(
        f"({i}, {q(r.kind)}, {q(r.pattern)}, {r.group}, {r.minimum}, {str(r.folded).lower()}, {str(i < len(BASE)).lower()})"
        for i, r in enumerate(rules)
    )
    fold = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE
rules(place, kind, pattern, grp, minimum, folded, base) AS (VALUES {table}),
t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
r AS (SELECT row, place, kind, grp, minimum, base, pattern, CASE WHEN folded THEN {fold.format('text')} ELSE text END AS s FROM t, rules),
m AS (SELECT row, place, kind, minimum, base, s, regexp_extract_all(s, pattern) AS found,
        CASE grp WHEN 0 THEN regexp_extract_all(s, pattern) ELSE regexp_extract_all(s, pattern, 2) END AS part FROM r),
steps AS (
  SELECT row, place, kind, minimum, base, s, found, part, 1 AS k, strpos(s, found[1]) AS first FROM m WHERE len(found) > 0
  UNION ALL
  SELECT row, place, kind, minimum, base, s, found, part, k + 1, first + len(found[k]) - 1 + strpos(substr(s, first + len(found[k])), found[k + 1])
  FROM steps WHERE k < len(found)),
spans AS (SELECT row, place, kind, base, first - 1 AS start, kind || ':' || (first - 1) || ':' || (first - 1 + len(found[k])) AS span
          FROM steps WHERE len(part[k]) >= minimum),
summed AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY start, place) FILTER (base) AS plain, string_agg(span, ',' ORDER BY start, place) AS spans FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(plain, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN summed USING (row)"""


OP13_SQL = oracle_sql()
