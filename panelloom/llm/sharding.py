"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime size, an
arithmetic progression from two hashes of its name.  Shards take turns, each
claiming the first slot of its order that is still free, until the table is full; so shards
hold equal numbers of slots up to one, and adding or removing a shard moves few.  A
row's key is hashed to a slot, and the slot names the shard: one look into a table of fixed
size, which is broadcast.  Rows are placed where they are, without a shuffle.

Edge cases: rows without an id are placed by their text, without both as empty text; equal keys
share a shard, so repeated rows stay together; extra columns stay as they are, but one named like an added column is
replaced; an empty table gives an empty result; more shards than slots are an error.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stages import read

SLOTS = 65_537  # prime; fixes the size of what is broadcast
SHARDS = 256


def number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Index of the shard that owns each slot."""
    if len(shards) > slots or not shards:
        raise ValueError("between one shard and as many as slots are needed")
    place = [number(f"offset|{s}") % slots for s in shards]
    stride = [number(f"stride|{s}") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    claimed = 0
    while True:
        for i in range(len(shards)):
            while owner[place[i]] >= 0:
                place[i] = (place[i] + stride[i]) % slots
            owner[place[i]] = i
            claimed += 1
            if claimed == slots:
                return owner


def slot_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    owner = fill(shards, slots)
    return spark.createDataFrame(pd.DataFrame({"slot": range(slots), "shard": owner}), "slot bigint, shard int")


def with_shards(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS
) -> DataFrame:
    """All columns, with slot and shard (0 to shards - 1)."""
    table = slot_table(docs.sparkSession, [f"shard-{i}" for i in range(shards)], slots)
    key = F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))
    digest = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")
    rows = docs.drop("slot", "shard").withColumn("slot", digest % slots)
    # The table has a fixed number of slots.
    return rows.join(F.broadcast(table), "slot", "left").select(*[c for c in rows.columns if c != "slot"], "slot", "shard")


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    return with_shards(read(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")
