"""Ranked lexical search by presence-mask grouping.

Each document is reduced to postings: the ids and counts of those of its terms
that some item asks for.  Documents are then searched in chunks.  For every
item the chunk's presence bits (document x item term) are packed into one mask
per document and documents are grouped by mask.  The best score a mask can
reach is the sum of its terms' largest contributions in the chunk; masks are
evaluated by descending best score until the next one cannot enter the item's
running top list (a mask that could tie is still evaluated).  Each task keeps
one top list per item over all its chunks; the lists meet in two ranking steps.

The items are the stated query set.  They are searched in blocks of about
``BLOCK_BYTES`` of text, so that what a task holds is bounded for any number of
items; every block reads all documents.

Defined results: null or empty text has no terms, counts in no statistic and is
never returned; a null doc_id counts in all statistics and ranks last among
equal scores; repeated document rows are ranked as documents of their own; item
rows repeating id and text are one item, an id with several texts is one item
holding the terms of all of them, a null item_id is an id like any other; an
item without terms, or whose terms occur nowhere, has no rows; texts of any
length are counted whole, in slices; other columns are not read; empty tables
give an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NON_WORD, ascii_lower, landed, split_words

TOP = 10
BLOCK_BYTES = 4 << 20
CHUNK_DOCS = 1024
CHUNK_CELLS = 1 << 22  # documents x terms of one item held at once
SLICE = 1 << 20
SALTS = 32
# Fixed values of the ranking rule.
WEIGHT_SCALE = 1000
TF_SCALE = 1_000_000_000
LENGTH_SHARE = 75

# Word bytes keep their value (A-Z in lower case), every other byte becomes a space.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else
                   b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def count_terms(text: bytes) -> Counter:
    """Counts of the terms of one UTF-8 text."""
    plain, at, counts = text.translate(WORD_BYTES), 0, Counter()
    while at < len(plain):
        end = plain.find(b" ", at + SLICE)
        end = len(plain) if end < 0 else end
        counts.update(plain[at:end].split())
        at = end
    return counts


def _postings(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, offsets, ids, tfs = [], [0], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                counts = count_terms(text or b"")
                sizes.append(counts.total())
                for term in vocabulary.keys() & counts.keys():
                    ids.append(vocabulary[term])
                    tfs.append(counts[term])
                offsets.append(len(ids))
            ends = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], ["doc_id", "n", "terms", "tfs"])
    return run


class TopList:
    """The best ``TOP`` (score, doc_id) pairs seen so far; null ids rank last among ties."""

    def __init__(self) -> None:
        self.scores = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.int64)
        self.lost = np.empty(0, dtype=bool)

    def least(self) -> int:
        """A score below this one cannot enter."""
        return int(self.scores[-1]) if len(self.scores) == TOP else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, lost: np.ndarray) -> None:
        fit = scores >= self.least()
        scores = np.concatenate([self.scores, scores[fit]])
        ids = np.concatenate([self.ids, ids[fit]])
        lost = np.concatenate([self.lost, lost[fit]])
        order = np.lexsort((ids, lost, -scores))[:TOP]
        self.scores, self.ids, self.lost = scores[order], ids[order], lost[order]


class Chunk:
    """Postings of some documents, by term, with their contributions to a score."""

    def __init__(self, ids, lost, n, offsets, terms, tfs, weights, m):
        docs = np.repeat(np.arange(len(n)), np.diff(offsets))
        gain = weights[terms] * ((TF_SCALE * tfs) // (WEIGHT_SCALE * tfs + 8 * m[docs]))
        order = np.argsort(terms, kind="stable")
        self.ids, self.lost, self.size = ids, lost, len(n)
        self.docs, self.gain = docs[order], gain[order]
        self.start = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), dtype=np.int64)
        held = np.flatnonzero(np.diff(self.start))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.gain, self.start[held])

    def search(self, terms: np.ndarray, repeats: np.ndarray, best: TopList) -> None:
        """Add the documents of this chunk that belong into one item's top list."""
        ceiling = self.most[terms] * repeats
        if ceiling.sum() < best.least():
            return
        counts = self.start[terms + 1] - self.start[terms]
        bit = np.repeat(np.arange(len(terms)), counts)
        at = np.arange(len(bit)) + np.repeat(self.start[terms] - np.cumsum(counts) + counts, counts)
        gains = np.zeros((self.size, len(terms)), dtype=np.int64)
        gains[self.docs[at], bit] = self.gain[at] * repeats[bit]
        present = np.zeros((self.size, -(-len(terms) // 64) * 64), dtype=np.uint8)
        present[self.docs[at], bit] = 1
        words = np.packbits(present, axis=1).view(np.uint64)
        if words.shape[1] == 1:
            _, first, group = np.unique(words[:, 0], return_index=True, return_inverse=True)
        else:
            _, first, group = np.unique(words, axis=0, return_index=True, return_inverse=True)
        group = group.reshape(-1)
        reach = present[first, :len(terms)].astype(np.int64) @ ceiling
        masks = np.argsort(-reach, kind="stable")
        members = np.argsort(group, kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=len(first)))
        done, step = 0, 4
        while done < len(masks) and reach[masks[done]] >= best.least():
            docs = np.concatenate([members[ends[g - 1] if g else 0:ends[g]] for g in masks[done:done + step]])
            best.add(gains[docs].sum(axis=1), self.ids[docs], self.lost[docs])
            done, step = done + step, step * 2


def _search(items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int):
    widest = max(len(terms) for terms, _ in items)
    docs = max(1, min(CHUNK_DOCS, CHUNK_CELLS // widest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [TopList() for _ in items]
        for batch in batches:
            for at in range(0, batch.num_rows, docs):
                part = batch.slice(at, docs)
                key, terms, tfs = part.column("doc_id"), part.column("terms"), part.column("tfs")
                n = part.column("n").to_numpy(zero_copy_only=False)
                chunk = Chunk(key.fill_null(0).to_numpy(zero_copy_only=False),
                              key.is_null().to_numpy(zero_copy_only=False), n,
                              terms.offsets.to_numpy() - terms.offsets[0].as_py(), terms.flatten().to_numpy(),
                              tfs.flatten().to_numpy(), weights,
                              100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // n_terms)
                for (asked, repeats), top in zip(items, best):
                    chunk.search(asked, repeats, top)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(items)), [len(b.scores) for b in best]), pa.int64()),
             pa.array(np.concatenate([b.ids for b in best]), pa.int64(), mask=np.concatenate([b.lost for b in best])),
             pa.array(np.concatenate([b.scores for b in best]), pa.int64())], ["item", "doc_id", "score"])
    return run


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, repeats, bytes): bytes is the size of the item's terms."""
    rows = (items.select("item_id", "text").distinct()
            .select("item_id", F.explode(split_words(ascii_lower(F.col("text")), NON_WORD)).alias("term"))
            .groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("repeats")))
    return landed(rows, "item-terms")


def _top(rows: DataFrame) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = Window.partitionBy("item", "salt").orderBy(*order)
    every = Window.partitionBy("item").orderBy(*order)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    return (rows.withColumn("salt", salt).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= TOP)
            .withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= TOP)
            .select("item", "rank", "doc_id", "score"))


def search(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``TOP`` best documents of every item."""
    spark, id_type = docs.sparkSession, items.schema["item_id"].dataType
    asked = item_terms(items)
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0) // block_bytes))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    found = spark.createDataFrame([], T.StructType([
        T.StructField("item_id", id_type), T.StructField("rank", T.IntegerType()),
        T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    for block in range(blocks):
        queries: dict = {}
        vocabulary: dict[bytes, int] = {}
        for row in asked.where(F.col("block") == block).orderBy("item_id", "term").toLocalIterator():
            queries.setdefault(row["item_id"], []).append(
                (vocabulary.setdefault(row["term"].encode(), len(vocabulary)), row["repeats"]))
        if not queries:
            continue
        postings = landed(
            docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
            .mapInArrow(_postings(vocabulary), "doc_id long, n long, terms array<int>, tfs array<long>"), "postings")
        n_docs, n_terms = postings.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        if not n_docs:
            continue
        df = np.zeros(len(vocabulary), dtype=np.int64)
        for term, held in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[term] = held
        weights = np.floor(WEIGHT_SCALE * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        wanted = [tuple(np.array(x, dtype=np.int64) for x in zip(*terms)) for terms in queries.values()]
        best = postings.where(F.size("terms") > 0).mapInArrow(_search(wanted, weights, n_docs, n_terms),
                                                              "item long, doc_id long, score long")
        names = spark.createDataFrame(list(enumerate(queries)), T.StructType([
            T.StructField("item", T.LongType()), T.StructField("item_id", id_type)]))
        found = found.unionByName(_top(best).join(F.broadcast(names), "item")
                                  .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return found
