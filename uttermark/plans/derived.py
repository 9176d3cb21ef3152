"""Evaluation tables that Spark derives from the given ones.

The given tables hold documents, not speech results, so hypotheses are made by damaging whole
reference texts in a fixed way.  The mark put in for a damaged word is ``_``, which no normalised
text contains; that is what makes the expected error counts provable (see ``oracles``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from uttermark.operators.normalize import normalize_corpus
from uttermark.operators.spreading import spread

MODELS = ["org/model-a", "org/model-b", "org/model-c"]
MARK = "_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised whole documents with at least one word."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text"), "doc_id")
    return normalize_corpus(docs, "text", "multilingual").where(F.col("norm_text") != "").drop("text")


def damaged(words: Column, key: Column, drop_every: Column | int, mark_every: Column | int) -> Column:
    """Text of the words left after dropping some and marking others, by position and key."""

    def keep(word: Column, i: Column) -> Column:
        return F.when((i + key) % drop_every == 3, None).when((i + key) % mark_every == 2, MARK).otherwise(word)

    # array_join skips nulls, so dropped words leave no trace.
    return F.array_join(F.transform(words, keep), " ")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models over every document: reference, hypothesis, duration and time."""
    return manifest_of(references(spark, sf_dir))


def manifest_of(refs: DataFrame) -> DataFrame:
    """The same from the ``references``: the documents are normalised before they are multiplied by the models."""
    rows = refs.select("*", F.explode(F.array(*[F.lit(m) for m in range(len(MODELS))])).alias("m"))
    duration = F.col("n_chars") / F.lit(15.0)
    untimed = (F.col("m") == 2) & (F.col("lang") == "es") & (F.col("doc_id") % 50 == 0)
    return rows.select(
        "doc_id",
        "lang",
        F.element_at(F.array(*[F.lit(m) for m in MODELS]), F.col("m") + 1).alias("model_id"),
        F.concat(F.lit("docs_"), F.col("lang")).alias("dataset"),
        F.when(F.col("doc_id") % 2 == 0, "test.clean").otherwise("test.other").alias("split"),
        F.col("norm_text").alias("text"),
        damaged(F.split("norm_text", " "), F.col("doc_id"), 11 + 2 * F.col("m"), 7 + F.col("m")).alias("pred_text"),
        duration.alias("duration"),
        F.when(~untimed, duration / (40 + 10 * F.col("m"))).alias("time"),
    ).withColumn("dataset_id", F.concat_ws("_", "dataset", "split"))


def question_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records from the vectors: twelve per record, three recordings for each of four sentences.

    Group sizes are fixed by the arithmetic on ``vec_id``, and so are signal lengths: a whole vector and up to
    48 of its samples once more, last ones first.  Sentences are stored out of id order.
    """
    vectors = table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 12").alias("record"),
        F.expr("cast((vec_id % 12) div 3 as int)").alias("part"),
        F.expr("cast(vec_id % 3 as int)").alias("k"),
        F.expr("concat(embedding, slice(reverse(embedding), 1, cast(vec_id % 49 as int)))").alias("embedding"),
        F.abs(F.get("embedding", F.lit(0)).cast("double")).alias("whisper"),
        F.abs(F.get("embedding", F.lit(1)).cast("double")).alias("seamless"),
    )
    # One shuffle serves both groupings below.
    vectors = vectors.repartition("record")
    takes = F.array_sort(F.collect_list(F.struct("k", "embedding", "whisper", "seamless")))
    sentences = vectors.groupBy("record", "part").agg(takes.alias("takes")).select(
        "record",
        "part",
        F.struct(
            (F.lit(453) - F.col("part")).alias("id"),
            F.concat(F.lit("sentence "), F.col("part").cast("string")).alias("transcription"),
            F.transform(
                "takes",
                lambda t: F.struct(t["embedding"].alias("array"), F.lit(16).alias("sampling_rate")),
            ).alias("audio"),
            F.transform("takes", lambda t: t["whisper"]).alias("whisper_asr_cer"),
            F.transform("takes", lambda t: t["seamless"]).alias("seamlessm4t_asr_cer"),
        ).alias("sentence"),
    )
    stored = F.array_sort(F.collect_list(F.struct("part", "sentence")))
    languages = F.array(*[F.lit(code) for code in ("eng_Latn", "xho_Latn", "hau_Latn", "zul_Latn")])
    return sentences.groupBy("record").agg(stored.alias("s")).select(
        "record",
        F.get(languages, (F.col("record") % 4).cast("int")).alias("language"),
        F.transform("s", lambda x: x["sentence"]).alias("sentence_data"),
    )
