"""The queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidefolio.llm import (centroids, decontamination, embedding_dedup, exact_dedup, language_id, minhash_dedup, mixing,
                           packing, quality, resampling, suffix_dedup, toxicity, url_filter)
from tidefolio.llm.common import crc_of_id, table


def tokenizer_files() -> tuple[str, str]:
    """The tokenizer, and the same vocabulary as ranks."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *tokenizer_files())


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, table(spark, sf_dir, "labels"), *quality.site_of(docs["source"], docs["lang"]))


# The shares of tokens that the mixture should have.
TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGETS)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_of_id(docs["doc_id"]) % 3 == 1
    return language_id.identify(docs, ~held_out, held_out)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_of_id(docs["doc_id"]) % 5 == 0
    return toxicity.score(docs, table(spark, sf_dir, "labels"), ~held_out, held_out)


# The rules of the query.
URL_RULES = (url_filter.Rule("allow", "com"), url_filter.Rule("block", "example.com", "/en/"),
             url_filter.Rule("allow", "www.example.com", "/en/"), url_filter.Rule("block", "net", "/es/"),
             url_filter.Rule("block", "net", "/fr/"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mixing": op5_mixing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_language_id": op7_language_id,
    "op8_toxicity": op8_toxicity,
    "op9_url_filter": op9_url_filter,
    "op10_quality": op10_quality,
    "op11_centroids": op11_centroids,
    "op12_resampling": op12_resampling,
    "op13_decontamination": op13_decontamination,
}
ORACLES: dict[str, str] = {
    "op4_exact_dedup": exact_dedup.DEDUP_SQL,
    "op9_url_filter": url_filter.judge_sql(URL_RULES, url_filter.Vocabulary()),
    "op11_centroids": centroids.cluster_sql(),
    "op12_resampling": resampling.resample_sql(),
    "op13_decontamination": decontamination.contamination_sql(),
}
