"""Exact deduplication through a minimal perfect hash over historical digests.

The digests of the history are dealt into buckets; each bucket becomes one
index row: a multi-level bitmap hash without collisions (level by level, the
digests that own a position alone are placed and the others go on) whose slots
``0..n-1`` hold the full 32-byte digest, the winner's doc_id and the number of
historical rows.  A lookup computes the slot and compares all 32 bytes, so a
digest outside the history is never taken for a member.  Winners travel as
decimal strings: pandas turns a long column that holds a null into floats.

Defined results: null text counts as empty; a null doc_id never wins while its
group has another id, and sorts as an arrival; rows repeating the winner's id
and text share its verdict; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, join_groups, landed

BUCKET_DIGESTS = 4096
LEVEL_LOAD = 2.0
INDEX_SCHEMA = ("bucket long, n long, levels array<long>, bits binary, digests binary, "
                "winners array<string>, counts array<long>")
FOUND_SCHEMA = "digest binary, keep_id string, group_size long, in_history boolean"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _position(words: np.ndarray, level: int, width: int) -> np.ndarray:
    """Position of each digest (rows of four 64-bit words) in one level's bitmap."""
    h = np.full(len(words), level + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for c in range(4):
        h = _mix(h + words[:, c])
    return (h % np.uint64(width)).astype(np.int64)


def _words(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def build_slots(words: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(level widths, concatenated bitmaps, slot of each digest) for distinct digests."""
    left, levels, maps = np.arange(len(words)), [], []
    home = np.empty(len(words), dtype=np.int64)
    base = 0
    while len(left):
        width = max(8, int(LEVEL_LOAD * len(left)))
        pos = _position(words[left], len(levels), width)
        hits = np.bincount(pos, minlength=width)
        alone = hits[pos] == 1
        maps.append(hits == 1)
        home[left[alone]] = base + pos[alone]
        left = left[~alone]
        levels.append(width)
        base += width
    bits = np.concatenate(maps) if maps else np.zeros(0, dtype=bool)
    rank = np.cumsum(bits) - 1
    return levels, bits, rank[home]


def find_slots(words: np.ndarray, levels, bits: np.ndarray) -> np.ndarray:
    """Slot per digest; -1 where every level says nonmember."""
    slot = np.full(len(words), -1, dtype=np.int64)
    rank = np.cumsum(bits) - 1
    base = 0
    for level, width in enumerate(levels):
        open_ = np.flatnonzero(slot < 0)
        if not len(open_):
            break
        at = base + _position(words[open_], level, int(width))
        hit = bits[at]
        slot[open_[hit]] = rank[at[hit]]
        base += int(width)
    return slot


def _build_bucket(key, part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("digest", ignore_index=True)
    levels, bits, slot = build_slots(_words(part["digest"]))
    order = np.argsort(slot)
    return pd.DataFrame({
        "bucket": [key[0]], "n": [len(part)], "levels": [levels],
        "bits": [np.packbits(bits).tobytes()],
        "digests": [b"".join(part["digest"].iloc[order])],
        "winners": [[None if pd.isna(v) else v for v in part["winner"].iloc[order]]],
        "counts": [part["rows"].iloc[order].tolist()],
    })


def _look_up(key, index: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
    """Arrivals of one bucket against its index row, plus untouched members."""
    winner, rows, member = {}, {}, {}
    found: list[tuple] = []
    if len(index):
        row = index.iloc[0]
        bits = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8)).astype(bool)[: int(sum(row["levels"]))]
        stored = row["digests"]
        extra = np.zeros(int(row["n"]), dtype=np.int64)
        if len(part):
            slots = find_slots(_words(part["digest"]), row["levels"], bits)
            for i, (digest, s) in enumerate(zip(part["digest"], slots)):
                if s >= 0 and stored[32 * s:32 * s + 32] == digest:
                    extra[s] += part["rows"].iat[i]
                    member[i] = True
        for s in range(int(row["n"])):
            found.append((stored[32 * s:32 * s + 32], row["winners"][s],
                          int(row["counts"][s] + extra[s]), True))
    for i in range(len(part)):
        if i not in member:
            w = part["winner"].iat[i]
            found.append((part["digest"].iat[i], None if pd.isna(w) else w,
                          int(part["rows"].iat[i]), False))
    return pd.DataFrame(found, columns=["digest", "keep_id", "group_size", "in_history"])


def digest_table(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the normalised text, landed once."""
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE, " ")
    return landed(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                              F.unhex(F.sha2(text, 256)).alias("digest")), "digests")


def _distinct(digests: DataFrame, buckets: int) -> DataFrame:
    first = F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long")
    return (digests.groupBy("digest")
            .agg(F.min("doc_id").cast("string").alias("winner"), F.count(F.lit(1)).alias("rows"))
            .withColumn("bucket", F.pmod(first, F.lit(buckets).cast("long"))))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """One landed index row per bucket of a history (doc_id, digest)."""
    return landed(_distinct(history, buckets).groupBy("bucket")
                  .applyInPandas(_build_bucket, INDEX_SCHEMA), "mph-index")


def resolve(arrivals: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """One row per distinct digest of history and arrivals with winner and size.

    Every historical doc_id must be smaller than every arrival's.
    """
    return (index.groupBy("bucket").cogroup(_distinct(arrivals, buckets).groupBy("bucket"))
            .applyInPandas(_look_up, FOUND_SCHEMA).withColumn("keep_id", F.col("keep_id").cast("long")))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, in_history for every row.

    The older half of the ids (up to the median doc_id) is the history and the
    newer half the arrivals looked up against it.
    """
    digests = digest_table(docs)
    n, pivot = digests.agg(F.count(F.lit(1)), F.percentile_approx("doc_id", 0.5)).first()
    buckets = max(1, -(-n // BUCKET_DIGESTS))
    old = F.coalesce(F.col("doc_id") <= F.lit(pivot).cast("long"), F.lit(False))
    index = build_index(digests.where(old), buckets)
    groups = landed(resolve(digests.where(~old), index, buckets), "dedup-groups")
    return join_groups(digests, groups, "digest", "group_size").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "in_history")
