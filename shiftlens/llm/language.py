"""Language identification by prediction by partial matching (PPM, method C).

Per language a byte context tree of orders 0 to 3 is counted; an unseen symbol
pays the escape probability of its context and falls to the next shorter
one, ending at a uniform order.  The code length of a whole text under the
frozen statistics is exact (no sampling, no prefixes); the language with the
shortest code wins and the score is the posterior under equal priors.

The trees are fitted on a bounded sample of labelled rows: distinct whole texts in
hash order up to ``TRAIN_BYTES`` over all languages together, which bounds the
broadcast model at ``4 * TRAIN_BYTES`` tree entries.  Of more than ``MAX_LANGS``
labels those with the most bytes of distinct text are learned.

Defined results: null text or text without a letter is ``und`` with score 0;
a null doc_id is neither learned from nor held out; equal code lengths go to
the alphabetically first language; with nothing to learn every text is
``und``; a text longer than a language's share of the sample is not learned
from; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import landed

ORDER = 3
TRAIN_BYTES = 4_000_000
MAX_LANGS = 256  # labels learned: those with the most bytes of distinct text
STEP_BYTES = 2_000_000
UNKNOWN = "und"
LETTER = r"\p{L}"


def grams(texts: list[bytes]) -> np.ndarray:
    """Order-3 context and symbol of every byte as one uint32, texts padded by spaces."""
    parts = []
    for t in texts:
        b = np.frombuffer(b" " * ORDER + t, dtype=np.uint8).astype(np.uint32)
        parts.append((b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:])
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)


def _low(codes: np.ndarray, order: int) -> np.ndarray:
    return codes if order == ORDER else codes & np.uint32((1 << (8 * (order + 1))) - 1)


def freeze(codes: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Per order: sorted (context, symbol) codes, their costs in bits, sorted contexts, escape costs."""
    tree = []
    for order in range(ORDER + 1):
        seen, at = np.unique(_low(codes, order), return_inverse=True)
        n = np.bincount(at, weights=counts)
        contexts, where = np.unique(seen >> np.uint32(8), return_inverse=True)
        total = np.bincount(where, weights=n)
        kinds = np.bincount(where).astype(np.float64)
        tree.append((seen, np.log2((total + kinds)[where] / n).astype(np.float32),
                     contexts, np.log2((total + kinds) / kinds).astype(np.float32)))
    return tree


def _at(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return i, table[i] == values


def code_lengths(tree: list[tuple], codes: np.ndarray) -> np.ndarray:
    """Bits of each gram's symbol after its context."""
    bits = np.zeros(len(codes))
    open_ = np.arange(len(codes))
    for order in range(ORDER, -1, -1):
        seen, cost, contexts, escape = tree[order]
        low = _low(codes[open_], order)
        i, hit = _at(seen, low)
        bits[open_[hit]] += cost[i[hit]]
        open_, low = open_[~hit], low[~hit]
        i, known = _at(contexts, low >> np.uint32(8))
        bits[open_[known]] += escape[i[known]]
    bits[open_] += 8.0
    return bits


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, part in batch.groupby("lang"):
            codes, n = np.unique(grams([t.encode() for t in part["text"]]), return_counts=True)
            yield pd.DataFrame({"lang": lang, "code": codes.astype(np.int64), "n": n.astype(np.int64)})


def train(labelled: DataFrame, max_bytes: int = TRAIN_BYTES, max_langs: int = MAX_LANGS) -> dict[str, list[tuple]]:
    """Frozen trees per language from rows (text, lang); see the module notes for the bound."""
    # Copies count once: they neither fill the sample nor meet in one task.
    rows = labelled.where("text is not null and lang is not null and length(text) > 0").select(
        "lang", F.octet_length("text").cast("long").alias("bytes"), F.xxhash64("text", "lang").alias("h"))
    distinct = landed(rows.groupBy("lang", "h").agg(F.max("bytes").alias("bytes")), "ppm-texts")
    names = (distinct.groupBy("lang").agg(F.sum("bytes").alias("b")).orderBy(F.desc("b"), "lang").limit(max_langs))
    totals = {r["lang"]: r["b"] for r in names.collect()}
    if not totals:
        return {}
    share = max(1, max_bytes // len(totals))
    # A first cut by hash keeps about twice the share, so the running sum orders few rows.
    rate = F.create_map(*[x for k, v in sorted(totals.items()) for x in (F.lit(k), F.lit(min(1.0, 2 * share / v)))])
    first = distinct.where((F.pmod("h", F.lit(1 << 30)) < F.try_element_at(rate, F.col("lang")) * float(1 << 30))
                           & (F.col("bytes") <= share))
    run = Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picked = (first.withColumn("upto", F.sum("bytes").over(run)).where(F.col("upto") <= share)
              .select(F.col("lang").alias("p_lang"), F.col("h").alias("p_h")))
    # At most ``max_bytes`` of texts; the distinct ones are taken again after the join.
    sample = (labelled.select("text", "lang").join(
        F.broadcast(picked), (F.col("lang") == F.col("p_lang")) & (F.xxhash64("text", "lang") == F.col("p_h")), "left_semi")
        .distinct())
    counted = (sample.mapInPandas(_count, "lang string, code long, n long")
               .groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas())
    return {lang: freeze(part["code"].to_numpy().astype(np.uint32), part["n"].to_numpy().astype(np.float64))
            for lang, part in counted.groupby("lang")}


def _score(texts: list[bytes], langs: list[str], trees: dict) -> tuple[list[str], list[float]]:
    """Best language and its posterior for a few texts at once."""
    codes, at = np.unique(grams(texts), return_inverse=True)
    starts = np.cumsum([0] + [len(t) for t in texts[:-1]])
    totals = np.stack([np.add.reduceat(code_lengths(trees[name], codes)[at], starts) for name in langs], axis=1)
    best = totals.argmin(axis=1)
    gap = np.minimum(totals - totals.min(axis=1, keepdims=True), 1000.0)
    return [langs[b] for b in best], (1.0 / np.exp2(-gap).sum(axis=1)).tolist()


def predictor(spark, trees: dict):
    """Pandas UDF text -> struct(lang_pred, score); nulls mark texts left to ``und``."""
    model = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        frozen = model.value
        langs = sorted(frozen)
        names: list = [None] * len(text)
        scores: list = [None] * len(text)
        group: list[int] = []
        data: list[bytes] = []

        def flush():
            if group:
                for i, name, score in zip(group, *_score(data, langs, frozen)):
                    names[i], scores[i] = name, score
            group.clear()
            data.clear()

        held = 0
        for i, t in enumerate(text):
            if t and langs:
                group.append(i)
                data.append(t.encode())
                held += len(data[-1])
                if held >= STEP_BYTES:
                    flush()
                    held = 0
        flush()
        return pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype=float)})
    return predict


def identify(docs: DataFrame, labelled: DataFrame | None = None, max_bytes: int = TRAIN_BYTES) -> DataFrame:
    """All columns of ``docs`` plus lang_pred and score (replacing columns so named).

    ``labelled`` (text, lang) defaults to the learnable fold of ``docs``.
    """
    if labelled is None:
        labelled = docs.where(~held_out(docs["doc_id"])).where(F.col("doc_id").isNotNull())
    predict = predictor(docs.sparkSession, train(labelled, max_bytes))
    spoken = F.when(F.coalesce(F.col("text"), F.lit("")).rlike(LETTER), F.col("text"))
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return (docs.select(*keep).withColumn("__ppm", predict(spoken))
            .select(*keep, F.coalesce("__ppm.lang_pred", F.lit(UNKNOWN)).alias("lang_pred"),
                    F.coalesce("__ppm.score", F.lit(0.0)).alias("score")))


def held_out(doc_id):
    """Whether crc32 of the id as text leaves 0 modulo 5 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
