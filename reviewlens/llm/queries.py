"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reviewlens.llm import (
    backoff, compress_lang, hard_negatives, minmax, oracles, packing, personal_data, pfair, risk_rules, secret_index, shared_search, spaced_seeds,
    subwords, token_files)
from reviewlens.llm.common import table

END_ID = 2


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.language_model_scores(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_index.secrets(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subwords.toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), END_ID)
    return token_files.token_digests(files)


def op5_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_rules.judged(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op6_packed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.shard_by_bytes(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_tagged_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_pfair_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair.mixture(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op9_spaced_seed_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op10_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minmax.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op11_shared_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_search.ranked(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op13_compressed_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_lang.languages(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_backoff_scores, op2_trigram_secrets, op3_subword_toxicity, op4_token_files, op5_risk_controlled_rules, op6_packed_shards,
        op7_tagged_personal_data, op8_pfair_mixture, op9_spaced_seed_contamination, op10_minmax_near_duplicates, op11_shared_search,
        op12_hard_negatives, op13_compressed_language)
}
ORACLES: dict[str, str] = {
    "op5_risk_controlled_rules": oracles.RISK_RULES,
    "op8_pfair_mixture": oracles.MIXTURE,
    "op10_minmax_near_duplicates": oracles.NEAR_DUPLICATES,
    "op11_shared_search": oracles.SHARED_SEARCH,
    "op12_hard_negatives": oracles.HARD_NEGATIVES,
}
