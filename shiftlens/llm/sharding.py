"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..N-1 in an order that depends on the data only: a fixed
number of hash ranges is counted, the counts become offsets, and rows are
numbered inside their range.  A balanced Feistel network over the smallest
even-bit domain holding N, walked until the value is below N, permutes the
numbers; position p lands in shard ``p mod shards`` at slot ``p div shards``.
Shard counts differ by at most one and (shard, slot) can be computed, and
inverted, without data.

Defined results: null text has zero bytes and the CRC of the empty string;
null doc_ids are numbered like others; identical rows take neighbouring
numbers in any order; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 4096
ROUNDS = 6
SHARDS = 24
SEED = 20240


def _half_bits(n: int) -> int:
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def _round(half: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    x = (half + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) & mask


def _keys(seed: int) -> list[int]:
    return [(seed * 1_000_003 + 7919 * (r + 1)) & 0xFFFFFFFF for r in range(ROUNDS)]


def _network(x: np.ndarray, bits: int, seed: int, inverse: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> shift, x & mask
    for key in (reversed(_keys(seed)) if inverse else _keys(seed)):
        if inverse:
            left, right = right ^ _round(left, key, mask), left
        else:
            left, right = right, left ^ _round(right, key, mask)
    return (left << shift) | right


def permute(numbers, n: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """Permutation of 0..n-1 (or its inverse) by cycle walking."""
    x = np.asarray(numbers, dtype=np.uint64)
    if n <= 1:
        return x.astype(np.int64)
    bits = _half_bits(n)
    out = _network(x, bits, seed, inverse)
    outside = np.flatnonzero(out >= np.uint64(n))
    while len(outside):
        out[outside] = _network(out[outside], bits, seed, inverse)
        outside = outside[out[outside] >= np.uint64(n)]
    return out.astype(np.int64)


def locate(number: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of a global row number."""
    p = int(permute([number], n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """Global row number stored at (shard, slot)."""
    return int(permute([slot * shards + shard], n, seed, inverse=True)[0])


def number_rows(df: DataFrame, *order: Column, name: str = "row_number") -> DataFrame:
    """Add gapless global numbers in (range, order) order, and return with the total count.

    Only the per-range counts (at most RANGES rows) pass through one task and
    a broadcast.
    """
    ranged = df.withColumn("__range", F.pmod(F.xxhash64(*order), F.lit(RANGES)))
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
               .select("__range", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before")))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return (ranged.join(F.broadcast(offsets), "__range")
            .withColumn(name, F.col("__before") + inside).drop("__range", "__before"))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number per row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (F.octet_length(text).cast("long") + 8).alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    n = docs.select(F.lit(1)).count()

    @F.pandas_udf("long")
    def position(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    numbered = number_rows(rows, F.col("doc_id"), F.col("text_crc32"), F.col("size"))
    return (numbered.withColumn("__p", position("row_number"))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
                    (F.col("__p") % shards).cast("int").alias("shard"),
                    F.floor(F.col("__p") / shards).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "row_number"))
