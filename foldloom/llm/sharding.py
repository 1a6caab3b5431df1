"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

The shard of a row depends on its key and the shard count alone. Growing from n to n + 1 shards moves rows only into
the new shard. No ring table is kept or broadcast.

Defined results: null keys all share one key value; a null text has no bytes and the CRC of no bytes; equal rows each
get their own slot; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.llm.common import stored

_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shards 0 to n_shards - 1 of 64-bit keys; every key jumps ahead until its next jump would leave the range."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        shard[moving] = ahead[moving]
        state[moving] = state[moving] * _STEP + np.uint64(1)
        draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[moving] = ((shard[moving] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        moving = moving[ahead[moving] < n_shards]
    return shard.astype(np.int32)


def shard_of(key: Column, n_shards: int) -> Column:
    """The shard of a key of any type."""

    @F.pandas_udf("int")
    def jump(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(hashed.to_numpy(np.int64), n_shards))

    return jump(F.xxhash64(key))


def shard_documents(docs: DataFrame, n_shards: int = 16, rows_per_bucket: int = 100_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    Slots are numbered without sorting a whole shard in one task: rows fall into small buckets within their shard, a
    window numbers each bucket, and the bucket counts (a small table) give each bucket its first slot.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = stored(
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")).select(
            "*", shard_of(F.col("doc_id"), n_shards).alias("shard"), shard_of(F.col("doc_id"), n_shards + 1).alias("grown_shard")
        )
    )
    buckets = max(64, -(-rows.count() // (n_shards * rows_per_bucket)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit("slot")), F.lit(buckets)))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("place", F.row_number().over(within)).join(first, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard")
