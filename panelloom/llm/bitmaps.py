"""Bitmaps of hashes, of a fixed size, that spare most rows a shuffle.

A set of any size becomes 2**BITS bits (2 MB), small enough for every task.  Rows
whose bit is not set are surely not in the set; only the others need the exact
join.  With a set so large that the bitmap fills up, more rows take the join and
the result stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U = np.uint64
BITS = 24
HASH = "hash of the bitmap"
ROW_KEY = "key of the row"


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits of id and text, null as a value: what names a row where ids are shared or missing."""
    ident = F.coalesce(F.concat(F.lit("1"), F.col(id_col).cast("string")), F.lit("0"))
    text = F.coalesce(F.concat(F.lit("1"), F.col(text_col)), F.lit("0"))
    return F.md5(F.concat(F.length(ident).cast("string"), F.lit(":"), ident, text))


def slot(hash_col: Column) -> Column:
    """Top bits of a hash, counted from 1 as the bitmap functions do."""
    return F.shiftrightunsigned(hash_col, 64 - BITS) + 1


def bitmap(items: DataFrame, hash_col: str = "hash") -> np.ndarray:
    """Packed bits of the slots in use; at most 2**BITS bits, built in pieces of 32,768."""
    pieces = (
        items.select(slot(F.col(hash_col)).alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    )
    packed = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    for bucket, bits in pieces.collect():  # at most 2**BITS / 32768 rows of 4 KB
        at = (bucket - 1) * 4096
        packed[at : at + 4096] = np.frombuffer(bits, dtype=np.uint8)
    return packed


def within(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> U(64 - BITS)
    return (packed[(place >> U(3)).astype(np.int64)] >> (place & U(7)).astype(np.uint8)) & 1 == 1


def rows_where(shared, found: bool):
    """Arrow function: hash last of the columns -> the other columns of the rows whose bit is, or is not, set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value
        for batch in batches:
            hashes = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(U)
            rest = pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1])
            yield rest.filter(pa.array(within(packed, hashes) == found))

    return run


def split(df: DataFrame, key: str, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be among ``members`` (one column of that name), and rows whose key is not."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(bitmap(members.select(F.xxhash64(key).alias("hash"))))
    marked = df.withColumn(HASH, F.xxhash64(key))
    maybe, never = (marked.mapInArrow(rows_where(shared, found), df.schema) for found in (True, False))
    return maybe, never


def without(df: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """The rows whose key is not among ``members``; null keys stay."""
    maybe, never = split(df, key, members)
    return never.unionByName(maybe.join(members, key, "left_anti").select(df.columns))
