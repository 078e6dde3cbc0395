"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.sources.tables import load_table

from . import (align_tokens, bpe, chunk_dedup, decontaminate, divergence, jaccard_join, langid, licenses, pii, quality,
               sharding, token_files, vector_dedup)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_query(spark, load_table(spark, sf_dir, "documents"), bpe.ranks_path())


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(load_table(spark, sf_dir, "documents"))


def op5_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards_query(load_table(spark, sf_dir, "documents"))


def op9_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(load_table(spark, sf_dir, "documents"))


def op8_co_trained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels"))


def op7_product_quantised_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(load_table(spark, sf_dir, "embeddings"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.replace(load_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("entities").cast("long").alias("n_entities"), "text", "entities")


def op10_chunked_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_passages(load_table(spark, sf_dir, "documents"))


def op6_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "benchmark"))


def op4_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.notices(load_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens.alignment_query(load_table(spark, sf_dir, "documents"), *align_tokens.paths())


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(load_table(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(spark, load_table(spark, sf_dir, "documents"), token_files.tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_license_notices": op4_license_notices,
    "op5_splitter_shards": op5_splitter_shards,
    "op6_latent_decontamination": op6_latent_decontamination,
    "op7_product_quantised_dedup": op7_product_quantised_dedup,
    "op8_co_trained_quality": op8_co_trained_quality,
    "op9_byte_gru_language": op9_byte_gru_language,
    "op10_chunked_passages": op10_chunked_passages,
    "op11_token_alignment": op11_token_alignment,
    "op12_source_divergence": op12_source_divergence,
    "op13_token_files": op13_token_files,
}
