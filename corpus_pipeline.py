"""Training-corpus pipeline: five stages over ``documents``, each landed as Parquet.

Language ID drops documents without an identifiable language, SimHash keeps
the smallest doc_id of each near-duplicate group, decontamination drops
contaminated documents, mixing keeps one row per selected epoch of a document
and sharding adds law, shard and slot.  Null texts have no language and go at the
first stage; empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.llm import decontaminate, language, mixing, sharding, simhash
from shiftlens.llm.common import landed, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has an identifiable language."""
    named = language.identify(docs)
    return named.where(F.col("lang_pred") != language.UNKNOWN).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group."""
    keep = (simhash.near_duplicates(docs.select("doc_id", "text"))
            .where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct())
    return docs.join(keep.withColumnRenamed("doc_id", "__keep"),
                     F.col("doc_id").eqNullSafe(F.col("__keep")), "left_semi")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves."""
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.where(~F.col("contaminated")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per selected (document, epoch)."""
    picked = (mixing.mix(docs).groupBy("doc_id", "__digest").agg(F.max("epoch").alias("__epochs"))
              .withColumnRenamed("doc_id", "__id").withColumnRenamed("__digest", "__d"))
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.join(picked, F.col("doc_id").eqNullSafe(F.col("__id")) & (digest == F.col("__d")))
    return (rows.withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.col("__epochs"))))
            .select(*docs.columns))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return sharding.shard(docs)


STAGES = [("language_id", language_id), ("simhash_near_dedup", simhash_near_dedup),
          ("benchmark_decontamination", benchmark_decontamination), ("mix_sources", mix_sources),
          ("shard", shard)]

# PPM scores and XXH64 fingerprints have no DuckDB form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
