"""Benchmark decontamination by size-partitioned MinHash containment search.

An item leaks into a document when at least ``percent`` of its distinct word
shingles occur there.  Items are partitioned by size class (powers of two); each
class keeps, per item, as many minimum hashes as its largest item may miss
plus one.  A document that holds the item must hold at least one of these
minima, whatever its own length, so the search loses nothing; the usual banded
MinHash would, because the Jaccard similarity of a short item and a long
document is near zero.  Candidates are verified by exact shingle containment.

Documents stream through once, as shingle hashes.  Two bitmaps of a fixed number of
bits go to every task: all minima, and all item shingles.  A document that
hits the first sends the shingles that hit the second to the join; with a benchmark
so large that the bitmaps fill up, more shingles reach the join, which stays exact.
Hits are counted per (document, item) with a partial count before the shuffle.

Edge cases: null, empty and blank texts (documents or items) never match; an
item with fewer words than a shingle has its whole sequence as its only one and matches
documents that consist of it; items with equal sets all match; repeated rows of
a document or an item count once; rows that share a document id are one document; documents
without an id are searched like others, each text for itself, and come back with a null id; items that share
an id, or have none, are items for themselves; empty tables give no rows.  Only the named columns are read.
``without_leaks`` judges every row by its own text, whatever its id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .bitmaps import ROW_KEY, bitmap, row_key, within, without
from .stages import Stages, read


def item_rows(size: int, percent: int, kind: str):
    """Arrow function: columns, text -> the columns, set size, hash, whether it is one of the minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, texts = batch.columns
            for lo, hi, raw, offsets in H.slices(texts):
                sets, counts = H.sorted_sets(*H.shingles(*H.words(raw, offsets, kind), size))
                owner = np.repeat(np.arange(lo, hi), counts)
                # Largest size of the item's class, and the shingles such an item may miss.
                upper = (1 << np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64)).astype(np.int64)
                minima = upper - (upper * percent + 99) // 100 + 1
                place = np.arange(len(sets)) - np.repeat(np.cumsum(counts) - counts, counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.take(pa.array(owner)) for c in columns],
                        pa.array(np.repeat(counts, counts)),
                        pa.array(H.signed(sets)),
                        pa.array(place < np.repeat(minima, counts)),
                    ],
                    names=[*batch.schema.names[:-1], "n_item", "hash", "minimum"],
                )

    return run


def hit_rows(size: int, kind: str, minima, shingles):
    """Arrow function: columns, text -> the columns, hash of the item shingles in texts that hold a minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, all_of = minima.value, shingles.value
        for batch in batches:
            *columns, texts = batch.columns
            for lo, hi, raw, offsets in H.slices(texts):
                hashes, counts = H.shingles(*H.words(raw, offsets, kind), size)
                owner = np.repeat(np.arange(hi - lo), counts)
                found = np.flatnonzero(within(all_of, hashes))
                hashes, owner = hashes[found], owner[found]
                holds = np.zeros(hi - lo, dtype=bool)
                holds[owner[within(first, hashes)]] = True
                keep = holds[owner]
                hashes, owner = hashes[keep], owner[keep]
                if len(hashes):
                    order = np.lexsort((hashes, owner))
                    hashes, owner = hashes[order], owner[order]
                    fresh = np.ones(len(hashes), dtype=bool)
                    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                    rows = pa.array(owner[fresh] + lo)
                    yield pa.RecordBatch.from_arrays(
                        [*[c.take(rows) for c in columns], pa.array(H.signed(hashes[fresh]))], names=[*batch.schema.names[:-1], "hash"]
                    )

    return run


def shared_shingles(rows: DataFrame, wanted: DataFrame, size: int, percent: int, kind: str) -> DataFrame:
    """Columns of the rows and items (their text last) with n_shared and n_item, where a text holds ``percent`` of an item."""
    spark = rows.sparkSession
    stages = Stages(spark, "leaks")
    *row_names, _ = rows.columns
    *item_names, _ = wanted.columns

    def schema(df: DataFrame, added: str) -> str:
        return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]], added])

    items = stages.put(
        wanted.mapInArrow(item_rows(size, percent, kind), schema(wanted, "n_item bigint, hash bigint, minimum boolean")).distinct(), "items"
    )
    share = spark.sparkContext.broadcast
    hits = rows.mapInArrow(
        hit_rows(size, kind, share(bitmap(items.where("minimum"))), share(bitmap(items))), schema(rows, "hash bigint")
    )
    met = hits.distinct().join(items, "hash")
    counted = met.groupBy(*row_names, *item_names, "n_item").agg(F.count("*").alias("n_shared"), F.max("minimum").alias("candidate"))
    return counted.where(F.col("candidate") & (F.col("n_shared") * 100 >= F.col("n_item") * percent))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    size: int = 5,
    percent: int = 80,
    kind: str = "alnum",
) -> DataFrame:
    """(doc, item, n_shared, n_item) of every document that holds ``percent`` of an item's shingles."""
    unnamed = F.when(F.col(id_col).isNull(), row_key(id_col, text_col))
    rows = docs.select(F.col(id_col).alias("id"), unnamed.alias("id_key"), F.col(text_col).alias("text"))
    wanted = benchmark.select(F.col(item_col).alias("item"), row_key(item_col, item_text).alias("item_key"), F.col(item_text).alias("text"))
    found = shared_shingles(rows, wanted, size, percent, kind)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_shared", "n_item")


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_text: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """The rows whose text holds no benchmark item, all columns; ids need not be unique or present."""
    keyed = docs.withColumn(ROW_KEY, row_key(id_col, text_col))
    wanted = benchmark.select(F.md5(item_text).alias("item_key"), F.col(item_text).alias("text"))
    found = shared_shingles(keyed.select(ROW_KEY, F.col(text_col).alias("text")), wanted, size, percent, "alnum")
    return without(keyed, ROW_KEY, found.select(ROW_KEY).distinct()).select(docs.columns)


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """One row per (document, item) leak."""
    found = leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 9))


def _shingle_sql(table: str, ident: str, other: str) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""(SELECT DISTINCT {ident}, {ident}_key, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ') || ' ' || len(w)]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS x
      FROM (SELECT {ident}, {other} AS {ident}_key, regexp_extract_all({lower}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM {table}))"""


OP5_SQL = f"""WITH items AS {_shingle_sql('benchmark', 'item_id', 'text')},
sized AS (SELECT item_id, item_id_key, x, count(*) OVER (PARTITION BY item_id, item_id_key) AS n_item FROM items),
held AS {_shingle_sql('documents', 'doc_id', 'CASE WHEN doc_id IS NULL THEN text END')}
SELECT doc_id, item_id, count(*) AS n_shared, n_item, round(count(*) / n_item, 9) AS containment
FROM held JOIN sized USING (x) GROUP BY doc_id, doc_id_key, item_id, item_id_key, n_item HAVING count(*) * 100 >= n_item * 80"""
