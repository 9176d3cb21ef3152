"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uttermark.llm import (
    conversation_repair,
    exact_dedup,
    language_id,
    line_rules,
    packing,
    private_spans,
    secret_scan,
    sentencepieces,
    sharding,
    simhash,
    token_counts,
    weak_quality,
    whitening,
)
from uttermark.llm.common import documents
from uttermark.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.identify(docs, language_id.fit(docs))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(documents(spark, sf_dir))


def op6_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return weak_quality.quality_scores(docs, weak_quality.fit(docs))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return line_rules.quality_rules(docs, line_rules.fit(docs))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and the SHA-256 of what they decode to."""
    coded = sentencepieces.decode(sentencepieces.encode(documents(spark, sf_dir)))
    return coded.select("doc_id", "n_ids", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(documents(spark, sf_dir), shards=24)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.repair(conversation_repair.damage(conversations), conversations)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whitening.whiten(vectors, whitening.fit(vectors))


def op13_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return private_spans.private_spans(docs, private_spans.fit(docs))


QUERIES = {
    name: query
    for name, query in sorted(globals().items())
    if name.startswith("op") and name[2:3].isdigit()
}
