"""Training-data pipeline over ``documents``: five operators, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the folder
the cluster shares and read again as the next stage's ``docs``.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uttermark.llm import exact_dedup, language_id, packing, secret_scan, simhash
from uttermark.llm.common import documents, staged


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that no learnt language claims at all."""
    return language_id.in_known_language(docs, language_id.fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of equal texts, the document with the largest id."""
    return exact_dedup.without_repeats(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of linked fingerprints."""
    return simhash.without_near_duplicates(docs)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret; no document goes.  ``n_chars`` follows the text."""
    masked = secret_scan.without_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document in the bins of the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_languages),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("secret_scans", masked_secrets),
    ("best_fit_packing", packed),
]

#: Trained language scores, fingerprints and greedy packing have no SQL form; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
