"""Shared column helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Separators of the word rules, as Java character classes.
SPACE = r"[\x20\x09-\x0D]+"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NON_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # for texts not lower-cased

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete landed tables that no later step reads; what was derived from them must be landed by then."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a statement go when it ends, not when the driver collects its garbage.

    For steps that land every result, since a later step then reads no earlier shuffle.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; pure ASCII texts take the faster built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def split_words(text: Column, separator: str) -> Column:
    """Non-empty pieces between separators; null text has none.

    The separator is greedy, so only the first and last piece can be empty.
    """
    def trim(w: Column) -> Column:
        first = F.when(F.element_at(w, 1) == "", 2).otherwise(1)
        last = F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), F.size(w) - 1).otherwise(F.size(w))
        return F.slice(w, first, F.greatest(last - first + 1, F.lit(0)))
    return let(F.split(F.coalesce(text, F.lit("")), separator), trim)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    A plain alias would be inlined into later lambdas and recomputed for
    every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str,
                share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with one ``groups`` row per ``key``, safe for hot keys.

    Groups of at least 1/``share`` of all rows number at most ``share``:
    they are broadcast, so their rows never meet in one task.  The rest go
    through an ordinary shuffle join.  Both inputs should be landed tables.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) * share >= F.lit(total))
    hot_keys = F.broadcast(hot.select(key))
    cold_rows = rows.join(hot_keys, key, "left_anti")
    return (rows.join(F.broadcast(hot), key)
            .unionByName(cold_rows.join(groups.join(hot_keys, key, "left_anti"), key)))
