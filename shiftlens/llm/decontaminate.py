"""Benchmark decontamination by winnowing, in native columns only.

Texts become words; every ``k``-word gram gets a 64-bit hash and the leftmost
minimum of each ``w`` consecutive hashes is a fingerprint.  With
``k + w - 1 = window`` two texts sharing ``window`` words in a row select the
same gram inside the shared span, so joining fingerprints misses none.  Each
fingerprint carries its neighbourhood (``w - 1`` words on both sides), hits are
extended word by word through it, and a run of at least ``window`` words marks
its document words.  Items shorter than the window are one window of their own
length, winnowed with ``k`` = that length and ``w`` = 1.

Item grams with equal neighbourhoods collapse before the join, so a passage
shared by many items meets each document once.

Defined results: null or empty text has no words and is never hit; an item
without words has no window; items with one id and different texts are one
item, also those with a null id, which counts in n_items and is the first
element, null, of item_ids; rows equal in doc_id and text get the same result; a
text of any length is read whole; columns of any name pass through, but for the
six that are added; empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_WORD, NON_WORD_ANY_CASE, ascii_lower, landed, let, split_words

WINDOW = 13
GRAM = 5
FLAG_ONE_IN = 20
BROADCAST_MARKS = 100_000  # rows of about 21 words; a larger benchmark is joined by a shuffle


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(text), NON_WORD)


def gram_hashes(words: Column, k: int) -> Column:
    """64-bit hash of every k-gram in order."""
    return F.when(F.size(words) < k, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k))))


def window_minima(hashes: Column, w: int) -> Column:
    """Minimum of every ``w`` consecutive hashes (one minimum over all of fewer).

    Minima of growing widths come from two overlapping narrower ones, so an
    element costs log(w) comparisons.
    """
    def widened(values: Column, step: int) -> Column:
        # ``least`` skips the nulls past the end; the caller cuts those windows off.
        return let(values, lambda m: F.transform(m, lambda x, i: F.least(x, F.get(m, i + step))))

    width = 1
    while width < w:
        step = min(width, w - width)
        hashes = widened(hashes, step)
        width += step
    return hashes


def winnow(words: Column, k: int, w: int) -> Column:
    """Structs (h, at) of the leftmost minima of every ``w`` consecutive gram hashes; ``at`` from 1."""
    def marked(h: Column) -> Column:
        if w == 1:
            return F.transform(h, lambda x, i: F.struct(x.alias("h"), (i + 1).alias("at")))
        windows = F.greatest(F.size(h) - (w - 1), F.least(F.size(h), F.lit(1)))

        def pick(m: Column) -> Column:
            # The leftmost minimum changes when the value does or when the old one leaves.
            starts = F.filter(F.sequence(F.lit(0), windows - 1), lambda j: (j == 0)
                              | (F.get(m, j) != F.get(m, j - 1)) | (F.get(h, j - 1) == F.get(m, j - 1)))
            return F.transform(F.when(F.size(h) > 0, starts).otherwise(F.array().cast("array<int>")), lambda j: F.struct(
                F.get(m, j).alias("h"),
                (j + F.array_position(F.slice(h, j + 1, w), F.get(m, j)).cast("int")).alias("at")))
        return let(window_minima(h, w), pick)
    return let(gram_hashes(words, k), marked)


def fingerprints(df: DataFrame, keep: list[str], k: int, w: int) -> DataFrame:
    """``keep`` columns plus (h, at, left, right) per fingerprint of column ``__words``.

    ``left`` and ``right`` are the up to ``w - 1`` words around the gram and
    ``gram`` its own words, each joined by spaces.
    """
    reach = w - 1

    def marks_of(words: Column) -> Column:
        def text(start, length):
            return F.concat_ws(" ", F.slice(words, start, length))

        return F.transform(winnow(words, k, w), lambda p: F.struct(
            p["h"].alias("h"), p["at"].alias("at"), text(p["at"], F.lit(k)).alias("gram"),
            text(F.greatest(p["at"] - reach, F.lit(1)), F.least(p["at"] - 1, F.lit(reach))).alias("left"),
            text(p["at"] + k, F.lit(reach)).alias("right")))

    # ``slice`` copies an array read from a row whole at every call; one that a
    # transform has just made is cut in place.
    marks = let(F.transform("__words", lambda x: x), marks_of)
    return df.select(*keep, F.explode(marks).alias("__f")).select(*keep, "__f.*")


def _run(a: Column, b: Column) -> Column:
    """Length of the common prefix of two word arrays."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def _pieces(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda x: x != "")


def spans(docs: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    """(__id, __text, start, stop, item_ids) per matched run of at least ``window`` words."""
    w = window - k + 1
    keys = ["__id", "__text"]
    item_marks = (fingerprints(items, ["item_id"], k, w).groupBy("h", "gram", "left", "right")
                  .agg(F.collect_set(F.struct("item_id")).alias("item_ids")))  # a struct keeps a null id
    item_marks = landed(item_marks.select("h", "gram", F.col("left").alias("i_left"),
                                          F.col("right").alias("i_right"), "item_ids"), "item-marks")
    side = F.broadcast(item_marks) if item_marks.count() <= BROADCAST_MARKS else item_marks
    met = fingerprints(docs, keys, k, w).join(side, ["h", "gram"])
    left = _run(F.reverse(_pieces(F.col("left"))), F.reverse(_pieces(F.col("i_left"))))
    right = _run(_pieces(F.col("right")), _pieces(F.col("i_right")))
    return (met.withColumn("__l", left).withColumn("__r", right)
            .where(F.col("__l") + k + F.col("__r") >= window)
            .select(*keys, (F.col("at") - F.col("__l")).alias("start"),
                    (F.col("at") + k - 1 + F.col("__r")).alias("stop"), "item_ids"))


def _covered(runs: Column) -> Column:
    """Number of positions in a sorted array of (start, stop)."""
    return F.aggregate(
        runs, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda s, r: F.struct(
            (s["n"] + F.greatest(r["stop"] - F.greatest(r["start"] - 1, s["end"]), F.lit(0))).cast("long").alias("n"),
            F.greatest(s["end"], r["stop"]).alias("end")),
        lambda s: s["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Columns of ``docs`` plus n_words, n_hit, n_items, item_ids, spans, contaminated.

    ``spans`` are the hit runs (start, stop; words from 1), ``item_ids`` the
    sorted ids as strings.
    """
    added = ["n_words", "n_hit", "n_items", "item_ids", "spans", "contaminated"]
    keep = [c for c in docs.columns if c not in added]
    items = landed(benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                                    words_of(F.col("text")).alias("__words")), "items")
    sized = items.where(F.size("__words") > 0)
    short = [r[0] for r in sized.where(F.size("__words") < window).select(F.size("__words")).distinct().collect()]
    rows = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text"),
                       words_of(F.col("text")).alias("__words"))
    hits = spans(rows, sized.where(F.size("__words") >= window), window, gram)
    for length in sorted(short):  # at most window - 1 lengths
        hits = hits.unionByName(spans(rows, sized.where(F.size("__words") == length), length, length))
    hits = landed(hits, "runs")
    runs = hits.groupBy("__id", "__text").agg(
        F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("__runs"))
    named = (hits.select("__id", "__text", F.explode("item_ids").alias("i")).groupBy("__id", "__text")
             .agg(F.transform(F.sort_array(F.collect_set("i")), lambda i: i["item_id"]).alias("__items")))
    found = landed(runs.withColumnRenamed("__id", "f_id").withColumnRenamed("__text", "f_text").join(
        named, F.col("f_id").eqNullSafe(F.col("__id")) & (F.col("f_text") == F.col("__text"))).select(
        F.col("f_id").alias("__id"), F.col("f_text").alias("__text"), "__runs", "__items"), "hits")
    # The row stays whole in one struct, so that no column of it clashes with the joined ones.
    text = F.col("row")["text"]
    found = found.select(F.col("__id").alias("f_id"), F.col("__text").alias("f_text"),
                         F.col("__runs").alias("runs"), F.col("__items").alias("items"))
    joined = docs.select(F.struct(*keep).alias("row")).join(
        found, F.col("row")["doc_id"].eqNullSafe(F.col("f_id")) & (F.xxhash64(text) == F.col("f_text")), "left")
    counted = joined.select("row", "runs", "items",
                            F.size(split_words(text, NON_WORD_ANY_CASE)).cast("long").alias("n_words"),
                            F.coalesce(_covered(F.col("runs")), F.lit(0).cast("long")).alias("n_hit"))
    return counted.select(
        *[F.col("row")[c].alias(c) for c in keep], "n_words", "n_hit",
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("runs", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"),
        ((F.col("n_hit") > 0) & (FLAG_ONE_IN * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
