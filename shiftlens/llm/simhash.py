"""SimHash near-duplicates: fingerprints linked through sharded BK-trees.

Every row's text is reduced to a 64-bit fingerprint (native shingle hashes,
bit counts in numpy).  Distinct fingerprints are dealt to shards: the 64 bits
are cut into ``radius + 3`` blocks, and two fingerprints within the radius
agree on at least three whole blocks, so each triple of blocks is a shard
key and no link is lost.  The blocks do the pruning, the trees finish it.  In a shard a BK-tree (children keyed by integer
Hamming distance to the parent) is searched following only edges within the
radius.  Large shards are cut into chunks of ``CHUNK`` fingerprints and every
pair of chunks is its own task group: one chunk is the tree, the other
queries it.  A task reports at most one link per fingerprint (to its local
component's smallest fingerprint); components grow by minimum labels with
pointer jumping over tables landed after every round.

Defined results: null or wordless text has fingerprint zero and links like any
other; a null doc_id never names a component that has another id; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, join_groups, landed, let, split_words

SHINGLE = 3
RADIUS = 2
CHUNK = 1024
COUNT_STEP = 1 << 16


def shingle_hashes(text: Column, length: int = SHINGLE) -> Column:
    """Signed XXH64 (seed 42) of every ``length``-word shingle, repeats included."""
    words = split_words(ascii_lower(text), SPACE)
    return let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (length - 1), F.lit(1))),
                    lambda i: F.xxhash64(F.concat_ws(" ", F.slice(w, i, length))))))


def fold_bits(hashes: np.ndarray) -> int:
    """Fingerprint (signed) whose bits are set in over half the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), COUNT_STEP):
        step = np.ascontiguousarray(hashes[at:at + COUNT_STEP]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(step, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints beside the untouched doc_id column (pandas would turn longs with a null into floats)."""
    for batch in batches:
        hashes = batch.column("hashes")
        flat, ends = hashes.flatten().to_numpy(), hashes.offsets.to_numpy()
        ends = ends - ends[0]
        fp = [fold_bits(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, length: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (signed long) of every row, landed once."""
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         shingle_hashes(F.col("text"), length).alias("hashes"))
    return landed(hashed.mapInArrow(_fold, "doc_id long, fp long"), "simhash")


class BKTree:
    """Nodes [value, {distance: child}] over distinct unsigned integers."""

    def __init__(self, values):
        it = iter(values)
        self.root = [next(it), {}]
        for v in it:
            node = self.root
            while True:
                d = (node[0] ^ v).bit_count()
                child = node[1].get(d)
                if child is None:
                    node[1][d] = [v, {}]
                    break
                node = child

    def within(self, value: int, radius: int):
        stack = [self.root]
        while stack:
            here, edges = stack.pop()
            d = (here ^ value).bit_count()
            if d <= radius:
                yield here
            if edges:
                if len(edges) <= 2 * radius + 1:
                    stack.extend(c for e, c in edges.items() if d - radius <= e <= d + radius)
                else:
                    stack.extend(edges[e] for e in range(d - radius, d + radius + 1) if e in edges)


def _link(radius: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        values = part["fp"].to_numpy().view(np.uint64).tolist()
        in_tree = part["tree"].to_numpy().tolist()
        nodes = [v for v, t in zip(values, in_tree) if t]
        asks = [v for v, t in zip(values, in_tree) if not t] if part["pair"].iat[0] else nodes
        parent = {v: v for v in values}

        def top(v):
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        if nodes and asks:
            tree = BKTree(nodes)
            for v in asks:
                for u in tree.within(v, radius):
                    a, b = top(v), top(u)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
        pairs = [(v, top(v)) for v in values if top(v) != v]
        return pd.DataFrame({"a": np.array([p[0] for p in pairs], dtype=np.uint64).view(np.int64),
                             "b": np.array([p[1] for p in pairs], dtype=np.uint64).view(np.int64)})
    return run


def _shard_keys(radius: int) -> Column:
    blocks = radius + 3
    edges = [64 * b // blocks for b in range(blocks + 1)]
    masks = [((1 << edges[b + 1]) - 1) ^ ((1 << edges[b]) - 1) for b in range(blocks)]
    keys = []
    for i, triple in enumerate(combinations(range(blocks), 3)):
        mask = reduce(lambda x, y: x | y, (masks[b] for b in triple))
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(i).alias("triple"), F.col("fp").bitwiseAND(F.lit(signed)).alias("value")))
    return F.array(*keys)


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) of distinct fingerprints whose components are the full link graph's."""
    keyed = distinct.select("fp", F.explode(_shard_keys(radius)).alias("k")).select("fp", "k.triple", "k.value")
    sizes = keyed.groupBy("triple", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunk = F.pmod(F.xxhash64("fp", F.lit("chunk")), F.col("chunks"))
    rows = (keyed.join(sizes, ["triple", "value"])
            .withColumn("chunks", F.ceil(F.col("n") / CHUNK))
            .withColumn("c", chunk)
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
            .select("fp", "triple", "value", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"),
                    (F.col("c") <= F.col("other")).alias("tree"), (F.col("c") != F.col("other")).alias("pair")))
    return rows.groupBy("triple", "value", "i", "j").applyInPandas(_link(radius), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) for every linked fingerprint; root is its component's smallest one."""
    both = landed(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    label = landed(both.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("m"))
                   .select("fp", F.least("fp", "m").alias("root")), "labels")
    while True:
        near = (both.join(label.withColumnRenamed("fp", "b"), "b")
                .groupBy(F.col("a").alias("fp")).agg(F.min("root").alias("m")))
        step = landed(label.join(near, "fp").select("fp", F.least("root", "m").alias("root"),
                                                    (F.col("m") < F.col("root")).alias("moved")), "labels")
        if not step.where("moved").limit(1).count():
            return step.select("fp", "root")
        jump = step.select(F.col("fp").alias("root"), F.col("root").alias("next"))
        label = landed(step.select("fp", "root").join(jump, "root")
                       .select("fp", F.col("next").alias("root")), "labels")


def near_duplicates(docs: DataFrame, length: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hex), component_id for every row."""
    rows = fingerprints(docs, length)
    distinct = landed(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "fps")
    roots = components(links(distinct, radius))
    member = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = landed(member.join(lowest, "root").select("fp", "rows", "component_id"), "components")
    return join_groups(rows, named, "fp", "rows").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
