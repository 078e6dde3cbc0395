"""A training corpus in five stages, each applying one operator of ``bizlens.llm`` to what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm import bpe, decontaminate, jaccard_join, pii, quality
from bizlens.llm.storage import materialise, small_batches
from bizlens.sources.tables import load_table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject; a document without a text counts as empty."""
    small_batches(spark)
    return quality.keep(docs, load_table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of each near-duplicate group with the smallest doc_id."""
    small_batches(spark)
    return jaccard_join.representatives(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    small_batches(spark)
    return decontaminate.keep(docs, load_table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; ``n_chars`` follows the new text."""
    small_batches(spark)
    kept = {c: f"__{c}" for c in docs.columns if c == "entities"}  # the operator's own column has this name
    out = pii.replace(docs.withColumnsRenamed(kept)).select(*[F.col(f"`{kept.get(c, c)}`").alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and byte offsets of every document left, with the digest of the decoded bytes."""
    small_batches(spark)
    # written before it is decoded: a task then has one Python worker at a time, and ids go to it once
    tokens = materialise(bpe.encode(docs, bpe.ranks_path()), "tokens")
    tokens = tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.col("ids").alias("tokens"),
                           "offsets", "ids")
    return (bpe.decode(tokens, bpe.ranks_path())
            .select("doc_id", "n_tokens", "tokens", "offsets", F.sha2("decoded", 256).alias("decoded_sha256")))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", not_in_benchmark),
    ("PII", without_personal_data),
    ("byte-level BPE", encode_tokens),
]

#: SQL cannot express the trained and hashed stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each reading the Parquet that the stage before wrote in the shared folder."""
    docs = load_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
