"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import centroids, chat_format, decontaminate, html_extract, language_id, lm_scoring, near_dedup, packing, quality_rules, sharding, substring_dedup, warc, whitening
from .common import table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.query(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.query(table(spark, sf_dir, "documents"))


def op3_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.query(table(spark, sf_dir, "documents"))


def op4_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.query(table(spark, sf_dir, "documents"))


def op5_bitmask_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.query(table(spark, sf_dir, "documents"))


def op6_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_text_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.query(table(spark, sf_dir, "pages"))


def op8_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(table(spark, sf_dir, "documents"), vocabulary())


def op9_event_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.query(table(spark, sf_dir, "conversations"))


def op10_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.query(table(spark, sf_dir, "documents"))


def op11_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.query(table(spark, sf_dir, "embeddings"))


def op12_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.query(table(spark, sf_dir, "pages"))


def op13_chan_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.query(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_subword_lattice, op2_weighted_minhash, op3_kd_tree_shards, op4_prefix_doubling, op5_bitmask_language, op6_latent_decontamination, op7_text_ratio, op8_binary_packing, op9_event_chat, op10_rule_ledger, op11_annulus_clusters, op12_chunked_warc, op13_chan_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op9_event_chat": chat_format.ORACLE, "op11_annulus_clusters": centroids.ORACLE, "op12_chunked_warc": warc.ORACLE}
