"""Registered queries of the dealt operators: thin projections of their outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, exact_dedup, language, lexical, licenses, line_spread, minhash, mixing, secrets,
               sharding, simhash, trie, url_lists)
from .oracles import ORACLES  # noqa: F401
from .common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("in_history")


def op2_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op3_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                      table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


def op4_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify(docs).select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_lists.url_filter(url_lists.dated(pages), url_lists.derived_events(pages))


def op7_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summarise(licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_mixture_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("__digest")


def op10_line_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_spread.remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op11_presence_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_truncation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


REGISTRY = {f.__name__: f for f in (
    op1_exact_dedup, op2_feistel_sharding, op3_winnowing_decontamination, op4_secret_forest, op5_ppm_language,
    op6_temporal_url_lists, op7_simhash_bktree, op8_license_signatures, op9_mixture_budgets,
    op10_line_site_spread, op11_presence_masks, op12_truncation_trie, op13_bottom_k)}
