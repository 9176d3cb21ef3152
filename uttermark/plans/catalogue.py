"""The registered queries: every operator over whole tables."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uttermark.functions import answers, english, number_columns, numbers
from uttermark.functions import text as tx
from uttermark.functions.words import with_char_errors, with_error_kinds, with_word_errors
from uttermark.operators import align, batching, chunks, indexing, metrics, nested, prepare
from uttermark.operators.normalize import expand_words, normalize_by_language, normalize_corpus, rewrite_by_table
from uttermark.operators.spreading import spread
from uttermark.operators.staging import discard, new_path, staged, staged_while, stored_bytes
from uttermark.plans.derived import damaged, manifest, manifest_of, question_records, references, table
from uttermark.sources import manifests, paged, utterances
from uttermark.streaming import leaderboard as streams
from uttermark.streaming import samples

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# A dictionary given by the user; words of the test corpora are among its keys.
DICTIONARY = {
    "colour": "color", "centre": "center", "grey": "gray", "thou": "you", "hath": "has", "shall": "will",
    "leur": "lor", "keit": "keyt", "une": "uno", "que": "ke",
}
PERCENT = 6


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, PERCENT) for n in names})


# --- error rates -------------------------------------------------------------------------------


@query
def wer_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus word error rate per language, whole documents."""
    refs = references(spark, sf)
    rows = refs.withColumn("pred_text", damaged(F.split("norm_text", " "), F.col("doc_id"), 11, 7))
    scored = with_word_errors(rows.select("lang", "norm_text", "pred_text"), "norm_text", "pred_text")
    sums = scored.groupBy("lang").agg(F.sum("errs").alias("errors"), F.sum("words").alias("words"))
    return sums.withColumn("wer", F.round(F.try_divide(100.0 * F.col("errors"), "words"), PERCENT))


@query
def wer_insertions_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """As above, with hypotheses that only have words too many."""
    rows = references(spark, sf).withColumn(
        "pred_text",
        F.array_join(
            F.transform(
                F.split("norm_text", " "),
                lambda w, i: F.when((i + F.col("doc_id")) % 9 == 4, F.concat(w, F.lit(" _"))).otherwise(w),
            ),
            " ",
        ),
    )
    scored = with_word_errors(rows.select("source", "norm_text", "pred_text"), "norm_text", "pred_text")
    return scored.groupBy("source").agg(F.sum("errs").alias("errors"), F.sum("words").alias("words"))


@query
def cer_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus character error rate per language, whole documents."""
    rows = references(spark, sf).withColumn("letters", F.replace("norm_text", F.lit(" "), F.lit("")))
    rows = rows.withColumn("pred_text", damaged(tx.clusters(F.col("letters")), F.col("doc_id"), 11, 7))
    scored = with_char_errors(rows.select("lang", "norm_text", "pred_text"), "norm_text", "pred_text")
    sums = scored.groupBy("lang").agg(F.sum("errs").alias("errors"), F.sum("chars").alias("chars"))
    return sums.withColumn("cer", F.round(F.try_divide(100.0 * F.col("errors"), "chars"), PERCENT))


@query
def wer_by_model_dataset(spark: SparkSession, sf: str) -> DataFrame:
    scores = metrics.score_runs(manifest(spark, sf), ["model_id", "dataset_id"])
    return _rounded(scores, "wer").select("model_id", "dataset_id", "samples", "errors", "words", "wer")


@query
def wer_with_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Every thirteenth hypothesis is lost: all its reference words are errors, and the loss is counted."""
    rows = manifest(spark, sf).withColumn("pred_text", F.when(F.col("doc_id") % 13 != 0, F.col("pred_text")))
    scores = metrics.score_runs(rows, ["model_id", "dataset_id"])
    return _rounded(scores, "wer").select("model_id", "dataset_id", "samples", "lost", "errors", "words", "wer")


def _neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Whole turns beside the next turn of their conversation."""
    turns = normalize_corpus(spread(_turns(spark, sf), "conv_id", "turn"), "text", "multilingual").select("conv_id", "turn", "norm_text")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("norm_text").alias("pred_text"))
    return turns.join(following, ["conv_id", "turn"])


@query
def wer_of_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Whole turns scored against the next turn of their conversation: unrelated, moved and repeated words."""
    scored = with_word_errors(_neighbours(spark, sf), "norm_text", "pred_text")
    return scored.select("conv_id", "turn", "errs", "words")


@query
def wer_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Hits, substitutions, deletions and insertions of the same pairs."""
    scored = with_error_kinds(_neighbours(spark, sf), "norm_text", "pred_text")
    return scored.select("conv_id", "turn", "errs", "words", *metrics.KINDS)


@query
def wer_kinds_by_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """The same per run, whole documents; every eleventh hypothesis is lost."""
    rows = manifest(spark, sf).withColumn("pred_text", F.when(F.col("doc_id") % 11 != 0, F.col("pred_text")))
    kinds = metrics.error_kinds(rows, ["model_id", "dataset_id"])
    return _rounded(kinds, "substitution_rate", "deletion_rate", "insertion_rate")


@query
def wer_percent(spark: SparkSession, sf: str) -> DataFrame:
    """The two-decimal form."""
    scores = metrics.score_runs(manifest(spark, sf), ["model_id"])
    return scores.select("model_id", F.round("wer", 2).alias("wer"))


@query
def rtfx_by_dataset(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(
        F.concat_ws("_", "source", "lang").alias("dataset_id"),
        (F.col("n_chars") / F.lit(15.0)).alias("duration"),
        (F.col("n_chars") / (F.lit(300.0) + F.col("doc_id") % 7)).alias("time"),
        F.lit(0).alias("errs"),
        F.lit(1).alias("words"),
    )
    scores = metrics.finish_scores(metrics.run_sums(rows, ["dataset_id"]))
    return _rounded(scores, "audio_length", "inference_time", "rtfx").select(
        "dataset_id", "audio_length", "inference_time", "rtfx"
    )


@query
def rtfx_gate_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """One missing or zero time or duration removes the ratio of its whole run."""
    rows = table(spark, sf, "events").select(
        (F.col("user_id") % 40).alias("run"),
        F.col("value").alias("duration"),
        F.when(F.col("event_id") % 97 == 0, None)
        .when(F.col("event_id") % 89 == 0, 0.0)
        .otherwise(F.col("value") / 8)
        .alias("time"),
        F.lit(0).alias("errs"),
        F.lit(1).alias("words"),
    )
    scores = metrics.finish_scores(metrics.run_sums(rows, ["run"]))
    return _rounded(scores, "rtfx").select("run", "samples", "rtfx")


@query
def leaderboard_composite(spark: SparkSession, sf: str) -> DataFrame:
    scores = metrics.score_runs(manifest(spark, sf), ["model_id", "dataset_id"])
    return _rounded(metrics.composite(scores), "wer", "rtfx")


@query
def leaderboard_composite_rounded(spark: SparkSession, sf: str) -> DataFrame:
    """Composite of WERs that were already rounded to two decimals."""
    scores = metrics.score_runs(manifest(spark, sf), ["model_id", "dataset_id"])
    return metrics.composite(scores, rounded=True).select("model_id", F.round("wer", PERCENT).alias("wer"), "n_datasets")


@query
def leaderboard_report(spark: SparkSession, sf: str) -> DataFrame:
    scores = metrics.score_runs(manifest(spark, sf), ["model_id", "dataset_id"])
    return _rounded(metrics.leaderboard_report(scores), "wer", "rtfx")


@query
def accuracy_mcq(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(
        "role",
        answers.answer_number(F.col("text")).alias("predicted"),
        (F.col("turn") % 4 + 1).cast("int").alias("expected"),
    )
    return metrics.accuracy(turns, ["role"], "predicted", "expected")


@query
def length_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("lang", "source", (F.col("n_chars") / F.lit(15.0)).alias("seconds"))
    return _rounded(metrics.length_stats(docs, ["lang", "source"], "seconds"), "mean", "std", "min", "max")


# --- manifests ---------------------------------------------------------------------------------


def _aligned_runs(spark: SparkSession, sf: str) -> DataFrame:
    return _aligned(manifest(spark, sf))


def _aligned(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", F.col("model_id").alias("model"), "dataset", "split", "text", "pred_text", "duration", "time"
    )


@query
def manifest_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Write a manifest table, read it back."""
    path = new_path(spark, "runs")
    manifests.write_manifest(_aligned_runs(spark, sf), path, [F.col("doc_id")], keys=["doc_id"], compression="gzip")
    return _rounded(manifests.read_runs(spark, path), "duration", "time")


@query
def sample_index(spark: SparkSession, sf: str) -> DataFrame:
    """Dense sample numbers per run, by ranges of the order key."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return indexing.dense_index(docs, ["lang"], [F.col("doc_id")], "sample_idx")


@query
def sample_index_by_text_key(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a string key and a hot group: nine of ten rows are in one run."""
    rows = table(spark, sf, "events").select(
        F.when(F.col("event_id") % 10 == 0, "small").otherwise("hot").alias("run"),
        F.concat(F.lit("utt-"), F.col("event_id").cast("string")).alias("utterance"),
    )
    return indexing.dense_index(rows, ["run"], [F.col("utterance")], "sample_idx")


@query
def manifest_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Model and dataset ids from file names, in both modes."""
    names = table(spark, sf, "documents").select(
        "doc_id",
        manifests.file_name(
            F.concat(F.lit("org/model-"), F.col("source")),
            F.lit("corpus/docs"),
            F.col("lang"),
            F.when(F.col("doc_id") % 3 == 0, "test.clean").when(F.col("doc_id") % 3 == 1, "validation").otherwise("test"),
        ).alias("file"),
    )
    exact = manifests.with_identity(names, F.concat(F.lit("/results/"), F.col("file")))
    trimmed = manifests.with_identity(
        exact.withColumnRenamed("dataset_id", "exact_dataset_id").drop("model_id"), F.col("file"), mode="reference"
    )
    return trimmed.select("doc_id", "model_id", "exact_dataset_id", "dataset_id")


@query
def discover_results(spark: SparkSession, sf: str) -> DataFrame:
    """Result files found below a folder: everything, one model, and what its name occurs in."""
    path = new_path(spark, "results")
    rows = table(spark, sf, "documents").select(
        F.concat(F.lit("sample_"), F.col("doc_id")).alias("audio_filepath"),
        F.lit(1.0).alias("duration"), F.lit(1.0).alias("time"), "text", F.concat("text", F.lit("!")).alias("pred_text"),
        manifests.file_name(
            F.when(F.col("doc_id") % 2 == 0, "org/big").otherwise("org/big-v2"), F.lit("docs"), F.col("lang"), F.lit("test.clean")
        ).alias("file"),
    )
    rows.write.partitionBy("file").json(path)
    counted = None
    for scope, options in (("all", {}), ("one", {"model": "org/big"}), ("like", {"model": "org/big", "exact": False})):
        found = manifests.discover(spark, path, **options).groupBy("model_id", "dataset_id").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.length("pred_text")).alias("letters")
        )
        found = found.select(F.lit(scope).alias("scope"), "*")
        counted = found if counted is None else counted.unionByName(found)
    return counted


# --- alignment and matrix ----------------------------------------------------------------------


@query
def align_inner(spark: SparkSession, sf: str) -> DataFrame:
    refs = table(spark, sf, "labels").select("doc_id", "quality")
    hyps = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return align.align(refs, hyps, ["doc_id"])


@query
def align_missing_refs(spark: SparkSession, sf: str) -> DataFrame:
    refs = table(spark, sf, "labels").select("doc_id", "quality")
    hyps = table(spark, sf, "documents").select("doc_id", "lang")
    return align.without_reference(refs, hyps, ["doc_id"])


@query
def align_missing_hyps(spark: SparkSession, sf: str) -> DataFrame:
    refs = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    hyps = table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("k"))
    return align.without_hypothesis(refs, hyps, ["k"])


@query
def align_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return align.duplicate_keys(table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), ["l_orderkey", "l_suppkey"])


def _planned(spark: SparkSession, sf: str) -> DataFrame:
    models = table(spark, sf, "supplier").select(F.concat(F.lit("org/"), F.col("s_name")).alias("model"))
    return align.evaluation_matrix(models, align.matrix_entries(align.SHORT_FORM + align.LONG_FORM))


@query
def matrix_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _planned(spark, sf)


@query
def matrix_plan_languages(spark: SparkSession, sf: str) -> DataFrame:
    models = table(spark, sf, "supplier").select(F.concat(F.lit("org/"), F.col("s_name")).alias("model"))
    return align.evaluation_matrix(models, align.multilingual_entries(align.MULTILINGUAL))


def _finished(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("org/Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("model"),
        F.when(F.col("l_quantity") < 25, "ami").otherwise("tedlium").alias("dataset"),
        F.lit("test").alias("split"),
    )


@query
def matrix_missing(spark: SparkSession, sf: str) -> DataFrame:
    return align.missing_runs(_planned(spark, sf), _finished(spark, sf), ["model", "dataset", "split"])


@query
def matrix_present(spark: SparkSession, sf: str) -> DataFrame:
    return align.present_runs(_planned(spark, sf), _finished(spark, sf), ["model", "dataset", "split"])


@query
def language_codes(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.groupBy(align.language_code(F.when(F.col("doc_id") % 5 == 0, F.col("source")).otherwise(F.col("lang"))).alias("code")).agg(
        F.count(F.lit(1)).alias("n")
    )


# --- preparation -------------------------------------------------------------------------------


def _with_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, some of them blank or marked as not to be scored."""
    return table(spark, sf, "documents").select(
        "doc_id",
        "lang",
        "n_chars",
        F.when(F.col("doc_id") % 10 == 0, " Ignore time segment in scoring ")
        .when(F.col("doc_id") % 10 == 5, " \t ")
        .otherwise(F.col("text"))
        .alias("text"),
    )


@query
def scorable_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_markers(spark, sf).withColumn("text", F.lower("text"))
    return rows.where(tx.is_scorable(F.col("text"))).select("doc_id", "lang")


@query
def repeat_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(tx.has_no_runs(F.col("text"))).select("doc_id")


@query
def cjk_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("語"))).otherwise(F.col("text")).alias("text")
    )
    return rows.where(tx.has_cjk(F.col("text"))).select("doc_id")


@query
def length_range(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return docs.where(prepare.within(F.col("n_chars"), 450, 4500))


@query
def duration_cap(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("n_chars") / F.lit(15.0)).alias("duration")
    )
    return _rounded(docs.where(utterances.short_enough(F.col("duration"), 30)), "duration")


@query
def computed_length_cap(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(
        "vec_id", F.struct(F.col("embedding").alias("array"), (F.col("label") + 1).alias("sampling_rate")).alias("audio")
    )
    return rows.where(prepare.seconds() <= 10).select("vec_id", F.round(prepare.seconds(), PERCENT).alias("seconds"))


@query
def duration_fallback(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(
        "vec_id",
        F.when(F.col("vec_id") % 3 == 0, F.col("label") / F.lit(2.0)).alias("duration"),
        F.struct(F.col("embedding").alias("array"), F.lit(16).alias("sampling_rate")).alias("audio"),
    )
    return rows.select("vec_id", prepare.duration_or_seconds().alias("audio_length_s"))


@query
def truncate_signal(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(
        "vec_id",
        "embedding",
        F.struct(F.col("embedding").alias("array"), (F.col("label") % 2 + 1).alias("sampling_rate")).alias("audio"),
    )
    cut = prepare.truncated(F.col("audio.array"), F.col("audio.sampling_rate"))
    return rows.select("vec_id", prepare.seconds().alias("audio_length_s"), F.size(cut).alias("kept"), _weighted(cut).alias("weighted"))


def _limited(spark: SparkSession, sf: str, stage: str) -> DataFrame:
    rows = spread(_with_markers(spark, sf).drop("n_chars"), "doc_id")
    return prepare.prepare(
        rows, limit=100, order=[F.col("doc_id")], limit_stage=stage, profile="multilingual", drop=("text", "original_text")
    )


@query
def limit_before_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _limited(spark, sf, "before")


@query
def limit_after_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _limited(spark, sf, "after")


@query
def limit_none(spark: SparkSession, sf: str) -> DataFrame:
    """A limit of -1 means all rows."""
    rows = spread(_with_markers(spark, sf).drop("n_chars"), "doc_id")
    return prepare.prepare(rows, limit=-1, order=[F.col("doc_id")], profile="multilingual", drop=("text", "original_text"))


@query
def limit_tied(spark: SparkSession, sf: str) -> DataFrame:
    """The first half of all ``lineitem`` rows by a key of two values: as many as asked for, all of the lesser key among them."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.least(F.col("l_suppkey") % 3, F.lit(1)).alias("k"))
    half = lines.count() // 2 + 7
    taken = indexing.first_rows(lines, half, [F.col("k")])
    return taken.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("k") == 0, F.col("l_orderkey"))).alias("orders"))


@query
def longest_topk(spark: SparkSession, sf: str) -> DataFrame:
    return batching.longest(table(spark, sf, "documents").select("doc_id", "n_chars"), 4 * 64, "n_chars", "doc_id")


@query
def text_column_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """A table whose transcript column is called ``transcript`` beside one that merely looks right."""
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("text").alias("transcript"), F.col("role").alias("transcription")
    )
    return rows.select("conv_id", "turn", F.col(utterances.text_column(rows)).alias("original_text"))


@query
def text_column_extended(spark: SparkSession, sf: str) -> DataFrame:
    """A question table: its text is in a column that only the longer list of names has."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("title"), F.col("text").alias("Questions"))
    derived = prepare.derive_texts(rows, profile="multilingual", extended=True)
    return derived.select("conv_id", "turn", "original_text", "norm_text")


@query
def audio_column_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Audio columns by dataset path, by the name ``wav``, and as they are, under one name."""
    vectors = table(spark, sf, "embeddings")
    given = {"flac": "org/ASMR-en", "wav": "org/plain", "mp3": "data/adi-gov-tw", "audio": "org/plain"}
    parts = [
        utterances.with_audio_column(
            vectors.where(F.col("vec_id") % len(given) == i).select("vec_id", F.struct(F.col("embedding").alias("array")).alias(name)), path
        )
        for i, (name, path) in enumerate(given.items())
    ]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select("vec_id", _weighted("audio.array").alias("weighted"))


@query
def short_split(spark: SparkSession, sf: str) -> DataFrame:
    """Short utterances of one split, whose audio is stored as ``wav``."""
    path = new_path(spark, "short")
    vectors = table(spark, sf, "embeddings")
    vectors.select(
        "vec_id", (F.col("vec_id") % 60).cast("double").alias("duration"), F.struct(F.col("embedding").alias("array")).alias("wav"),
        F.lit("en").alias("config"), F.when(F.col("vec_id") % 3 == 0, "dev").otherwise("test").alias("split"),
    ).write.partitionBy("config", "split").parquet(path)
    rows = utterances.load_short_split(spark, path, "en", "test")
    return rows.select("vec_id", "duration", _weighted("audio.array").alias("weighted"))


@query
def language_from_config(spark: SparkSession, sf: str) -> DataFrame:
    configs = table(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 7 == 0, F.col("source")).otherwise(F.concat_ws("_", "source", "lang")).alias("config")
    )
    return configs.groupBy(prepare.language_of_config(F.col("config")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query
def id_sanitise(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("org/"), F.translate("p_name", " ", "-"), F.lit("/"), F.col("p_brand"), F.lit("-v1")).alias("model")
    )
    return parts.select("p_partkey", prepare.path_safe(F.col("model")).alias("safe"), prepare.model_card(F.col("model")).alias("card"))


@query
def blank_to_space(spark: SparkSession, sf: str) -> DataFrame:
    return _with_markers(spark, sf).select("doc_id", tx.blank_to_space(F.col("text")).alias("reference"))


@query
def short_audio_answer(spark: SparkSession, sf: str) -> DataFrame:
    """Very short audio gets a constant answer and is not sent to the scorer."""
    rows = table(spark, sf, "events").select("event_id", (F.col("value") / 50).alias("seconds"))
    return rows.select(
        "event_id", F.when(batching.too_short(F.col("seconds")), batching.TOO_SHORT_ANSWER).alias("pred_text")
    )


@query
def split_scan(spark: SparkSession, sf: str) -> DataFrame:
    """One split of one configuration of a partitioned utterance table."""
    path = new_path(spark, "utterances")
    table(spark, sf, "documents").select(
        "doc_id", "n_chars", F.col("source").alias("config"), F.when(F.col("doc_id") % 3 == 0, "test").otherwise("dev").alias("split")
    ).write.partitionBy("config", "split").parquet(path)
    return utterances.load_split(spark, path, "src3", "test").select("doc_id", "n_chars")


@query
def language_split_scan(spark: SparkSession, sf: str) -> DataFrame:
    """One language of a shared multilingual configuration."""
    path = new_path(spark, "floras")
    table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "en", "eng").otherwise(F.col("lang")).alias("language"),
        F.lit("multilingual").alias("config"),
        F.lit("test").alias("split"),
    ).write.partitionBy("config", "split").parquet(path)
    return utterances.load_language_split(spark, path, "multilingual_en", "test").select("doc_id", "language")


# --- normalisation -----------------------------------------------------------------------------


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", "text")


def _spread_documents(spark: SparkSession, sf: str) -> DataFrame:
    """For work that costs much more than a shuffle of the rows."""
    return spread(_documents(spark, sf), "doc_id")


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", "text")


@query
def norm_basic(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_corpus(_spread_documents(spark, sf), "text", "basic").select("doc_id", "norm_text")


@query
def norm_basic_plain(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_corpus(_spread_documents(spark, sf), "text", "basic", remove_diacritics=True).select("doc_id", "norm_text")


@query
def norm_graphemes(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_corpus(_turns(spark, sf), "text", "basic", remove_diacritics=True, split_letters=True).select(
        "conv_id", "turn", "norm_text"
    )


@query
def norm_multilingual(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_corpus(_spread_documents(spark, sf), "text", "multilingual").select("doc_id", "norm_text")


@query
def norm_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Mark-up removal: the span rules on raw pages."""
    return normalize_corpus(spread(table(spark, sf, "pages").select("page_id", "html"), "page_id"), "html", "multilingual").select("page_id", "norm_text")


def _spoken_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with contractions, signs that decompose to letters, and spoken numbers behind them."""
    rows = _spread_documents(spark, sf).withColumn("n", F.expr("doc_id div 24"))
    said = F.concat("text", F.lit(" Um, she's got Mr Grey's ACME™ №7 at 3℃ for 1,250.50 and ½. He won't. "), _spoken("doc_id", "n"))
    return rows.select("doc_id", "lang", said.alias("text"))


@query
def norm_english(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_corpus(_spoken_documents(spark, sf), "text", "english").select("doc_id", "norm_text")


@query
def norm_english_columns(spark: SparkSession, sf: str) -> DataFrame:
    """``norm_english`` without a Python worker."""
    return normalize_corpus(_spoken_documents(spark, sf), "text", "english", engine="jvm").select("doc_id", "norm_text")


@query
def norm_by_language(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_by_language(_spoken_documents(spark, sf), "text", "lang").select("doc_id", "lang", "norm_text")


# Spoken numbers of every kind: {a} and {b} are number words below ten, {t} a multiple of ten.
PHRASES = [
    "{a} {b} oh {a}", "twenty {a} hundred {t}", "{a} million {b} hundred thousand and {t} {a}", "the {t} first and the {a}th",
    "the {t} {a} second third", "in the nineteen eighties and {t} {a}s", "{t} {a} percent or {a} per cent per {b}",
    "{a} dollars and {t} cents", "{a} euros {b} cents and zero pounds {a} cents", "double {a} triple {b} double {t}",
    "{a} point {b} {a} {b} million", "point {a} and {b} point hundred", "minus {a} plus {t} {b} negative the",
    "positive and {t} minus dollars", "{a} and a half million", "{t} {a} and a half later", "and a half of {a}",
    "hundreds of {a} thousands", "{t} {t} {a} {b} {t}", "{a} hundred and {b} and the {t} and", "1 2.5 million 3rd 4 th $7 {a}",
    "{a} thousand {t} thousandth one ones", "zeroth oh o zero {a} zeros", "eleven {a} twelve hundred thirteen ten",
]


def _spoken(first: str, second: str):
    """A phrase with its words filled in by two row numbers."""
    ones = F.array(*[F.lit(w) for w in numbers.ONES[:9]])
    tens = F.array(*[F.lit(w) for w in numbers.TENS])
    word = lambda words, at: F.get(words, (at % F.size(words)).cast("int"))
    phrase = word(F.array(*[F.lit(p) for p in PHRASES]), F.col(first) + 5 * F.col(second))
    for mark, filling in (("{a}", word(ones, F.col(first))), ("{b}", word(ones, F.col(second) + 4)), ("{t}", word(tens, F.col(first) + F.col(second)))):
        phrase = F.replace(phrase, F.lit(mark), filling)
    return phrase


def _spoken_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with an amount in front: the conversation id, digit by digit, in hundreds of dollars."""
    digits = F.split(F.trim(F.regexp_replace(F.col("conv_id").cast("string"), "(.)", "$1 ")), " ")
    names = F.create_map(*[F.lit(p) for i, w in enumerate(["zero", *numbers.ONES[:9]]) for p in (str(i), w)])
    spelled = F.array_join(F.transform(digits, lambda d: F.try_element_at(names, d)), " ")
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.lower(F.concat(spelled, F.lit(" hundred dollars = "), F.col("text"))).alias("text")
    )
    return rows.select("conv_id", "turn", numbers.fold_numbers(F.col("text")).alias("folded"))


def _spoken_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Whole turns with a spoken number of some kind on either side."""
    phrase = _spoken("conv_id", "turn")
    return _turns(spark, sf).select("conv_id", "turn", F.lower(F.concat(phrase, F.lit(" = "), "text", F.lit(" = "), phrase)).alias("text"))


@query
def norm_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Number folding of whole turns."""
    return _spoken_turns(spark, sf).select("conv_id", "turn", numbers.fold_numbers(F.col("text")).alias("folded"))


@query
def norm_numbers_columns(spark: SparkSession, sf: str) -> DataFrame:
    """``norm_numbers`` as column expressions."""
    return _spoken_turns(spark, sf).select("conv_id", "turn", number_columns.fold_numbers(F.col("text")).alias("folded"))


@query
def norm_number_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole folded turns with an amount in front, and that amount alone, which is known."""
    return _spoken_amounts(spark, sf).withColumn("amount", F.substring_index("folded", " = ", 1))


@query
def norm_contractions(spark: SparkSession, sf: str) -> DataFrame:
    prefix = F.lit("I won't say she's got y'all's. ")
    rows = _spread_documents(spark, sf).select("doc_id", F.lower(F.concat(prefix, F.col("text"))).alias("__text"))
    return expand_words(rows).withColumnRenamed("__text", "expanded")


@query
def norm_digit_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", english.drop_full_stops(english.join_digit_groups(F.col("text"))).alias("joined"))


@query
def norm_currency_strip(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", english.drop_loose_symbols(F.col("text")).alias("stripped"))


@query
def spelling_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    rows = normalize_corpus(_spread_documents(spark, sf), "text", "multilingual")
    return rows.select("doc_id", english.rewrite_words(F.col("norm_text"), DICTIONARY).alias("rewritten"))


# British words of every built-in family.
BRITISH = (
    "colour labouring honourable favourite neighbourhoods humourless organisation realised analysing theatres catalogue"
    " cancelled traveller defences greyer armoury"
)


@query
def spelling_families(spark: SparkSession, sf: str) -> DataFrame:
    """The built-in spelling families: each document with one British word behind it."""
    words = F.array(*[F.lit(w) for w in BRITISH.split()])
    rows = normalize_corpus(_spread_documents(spark, sf), "text", "multilingual")
    spoken = F.concat_ws(" ", "norm_text", F.get(words, (F.col("doc_id") % F.size(words)).cast("int")))
    rows = rows.select("doc_id", spoken.alias("spoken"))
    return rows.select("doc_id", english.rewrite_words(F.col("spoken"), english.spelling_table()).alias("rewritten"))


@query
def spelling_table(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary table of one row per part; every document names three parts, one of which has no entry."""
    parts = table(spark, sf, "part")
    dictionary = parts.select(F.concat(F.lit("p"), "p_partkey").alias("word"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("replacement"))
    named = [F.concat(F.lit("p"), n.cast("string")) for n in (F.col("doc_id") % 199 + 1, F.col("doc_id") * 7 % 191 + 1, F.lit(0))]
    rows = normalize_corpus(_spread_documents(spark, sf), "text", "multilingual")
    rows = rows.select("doc_id", F.concat_ws(" ", named[0], "norm_text", named[1], named[2], named[0]).alias("spoken"))
    return rewrite_by_table(rows, ["doc_id"], "spoken", dictionary).select("doc_id", "rewritten")


@query
def special_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = _turns(spark, sf).withColumn("text", F.concat(F.lit("<|en|>"), F.col("text"), F.lit("<|end|> ")))
    return rows.select("conv_id", "turn", tx.drop_special_tokens(F.col("text")).alias("clean"))


# --- answers, prompts, segments ----------------------------------------------------------------


@query
def answer_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("conv_id", "turn", answers.answer_number(F.col("text")).alias("answer"))


@query
def prompt_build(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    options = [F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string"), F.col("p_name")]
    return parts.select(
        "p_partkey",
        answers.numbered_prompt(F.col("p_name"), options).alias("numbered"),
        answers.lettered_prompt(F.col("p_name"), options).alias("lettered"),
    )


@query
def segment_join(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a document as segments, stored backwards, joined in order; each ends in white space."""
    padded = lambda t: F.concat(F.lit("\n"), t, F.lit("\t\n"))
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.struct(i.alias("idx"), padded(t).alias("text")))
    return _documents(spark, sf).select("doc_id", answers.join_segments(F.reverse(lines)).alias("joined"))


@query
def nested_segment_join(spark: SparkSession, sf: str) -> DataFrame:
    """Words of a document's lines as segments of speakers."""
    words = lambda line: F.transform(F.split(line, " "), lambda w: F.struct(w.alias("value")))
    groups = F.transform(F.split("text", "\n"), lambda line: F.struct(words(line).alias("elements")))
    return _documents(spark, sf).select("doc_id", answers.join_nested_segments(groups).alias("joined"))


def _weighted(signal):
    """Every sample counts with its position, so that a wrong, lost or moved one shows."""
    terms = F.transform(signal, lambda x, i: x.cast("double") * (i + 1))
    return F.round(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), 4)


# --- nested records ----------------------------------------------------------------------------


def _chosen(spark: SparkSession, sf: str, strategy: str) -> DataFrame:
    records = question_records(spark, sf)
    chosen = nested.select_recordings(records, strategy, F.col("language"), key=F.col("record"))
    return chosen.select("record", F.posexplode("chosen").alias("rank", "c")).select(
        "record", "rank", F.col("c.id").alias("sentence_id"), F.col("c.position").alias("position")
    )


@query
def candidate_best(spark: SparkSession, sf: str) -> DataFrame:
    return _chosen(spark, sf, "best")


@query
def candidate_worst(spark: SparkSession, sf: str) -> DataFrame:
    return _chosen(spark, sf, "worst")


@query
def candidate_random(spark: SparkSession, sf: str) -> DataFrame:
    return _chosen(spark, sf, "random")


@query
def record_concat(spark: SparkSession, sf: str) -> DataFrame:
    whole = nested.assemble_records(
        question_records(spark, sf), "best", F.col("language"), rate=16, max_seconds=22, limit_stage="after"
    )
    return whole.select("record", F.size("audio").alias("samples"), _weighted("audio").alias("weighted"))


@query
def record_limit(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten records, taken before those that are too long go."""
    whole = nested.assemble_records(
        question_records(spark, sf), "worst", F.col("language"), rate=16, max_seconds=22, limit=10, order=[F.col("record")]
    )
    return whole.select("record", F.size("audio").alias("samples"), _weighted("audio").alias("weighted"))


@query
def flatten_recordings(spark: SparkSession, sf: str) -> DataFrame:
    flat = nested.flatten_recordings(question_records(spark, sf), ["record"], max_seconds=5.5)
    return flat.select(
        "record", "sentence_pos", "audio_pos", "text",
        F.size("audio.array").alias("samples"),
        _weighted("audio.array").alias("weighted"),
    )


@query
def mono_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors read as 32 frames of two channels."""
    frames = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.slice("embedding", 2 * i + 1, 2).cast("array<double>"))
    rows = table(spark, sf, "embeddings").select("vec_id", nested.to_mono(frames).alias("mono"))
    return rows.select("vec_id", F.posexplode("mono").alias("frame", "x")).select("vec_id", "frame", F.round("x", PERCENT).alias("x"))


# --- chunks ------------------------------------------------------------------------------------


def _chunk_texts(spark: SparkSession, sf: str) -> DataFrame:
    docs = _spread_documents(spark, sf).withColumn("len", F.length("text"))
    plan = chunks.chunk_plan(docs, "len", rate=10)
    return plan.select("doc_id", "chunk_idx", F.substring("text", (F.col("chunk_start") + 1).cast("int"), (F.col("chunk_end") - F.col("chunk_start")).cast("int")).alias("chunk_text"))


@query
def chunk_plan(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return chunks.chunk_plan(docs, "n_chars", rate=10).select("doc_id", "chunk_idx", "chunk_start", "chunk_end")


@query
def chunk_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.chunk_pieces(_chunk_texts(spark, sf), "doc_id")


@query
def chunk_merge(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.merge_chunks(_chunk_texts(spark, sf), "doc_id")


@query
def chunk_merge_fold(spark: SparkSession, sf: str) -> DataFrame:
    """The sequential fold by longest common substring."""
    return chunks.merge_chunks(_chunk_texts(spark, sf), "doc_id", mode="reference")


@query
def chunk_fold_words(spark: SparkSession, sf: str) -> DataFrame:
    """The same fold over the words of each part's name."""
    words = table(spark, sf, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("chunk_idx", "chunk_text"))
    return chunks.merge_chunks(words, "p_partkey", mode="reference")


@query
def chunk_fold_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The same fold over the whole turns of each conversation."""
    turns = _turns(spark, sf).select("conv_id", F.col("turn").alias("chunk_idx"), F.col("text").alias("chunk_text"))
    return chunks.merge_chunks(turns, "conv_id", mode="reference")


@query
def chunk_regroup(spark: SparkSession, sf: str) -> DataFrame:
    grouped = chunks.regroup_chunks(_chunk_texts(spark, sf), "doc_id")
    return grouped.select("doc_id", F.size("texts").alias("n"), F.md5(F.array_join("texts", "|")).alias("texts_md5"))


@query
def common_substring(spark: SparkSession, sf: str) -> DataFrame:
    """Longest common substring of each part's name and type."""
    parts = table(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("a"), F.col("p_type").alias("b"))
    return parts.select("p_partkey", answers.longest_common_substring("a", "b").alias("shared"))


# --- batches -----------------------------------------------------------------------------------


@query
def batch_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of 128 over the longest-first order."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return indexing.batch_ids(docs, 128, batching.longest_first("n_chars", "doc_id"))


@query
def batch_ids_tied(spark: SparkSession, sf: str) -> DataFrame:
    """All ``lineitem`` rows numbered by a key of two values, in two groups: where each key's numbers begin and end."""
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", (F.col("l_suppkey") % 2).alias("k"))
    numbered = indexing.dense_index(lines, ["l_returnflag"], [F.col("k")], "at")
    return numbered.groupBy("l_returnflag", "k").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.count_distinct("at").alias("numbers"), F.sum("l_orderkey").alias("orders")
    )


@query
def batch_amortise(spark: SparkSession, sf: str) -> DataFrame:
    """The time of a batch, shared evenly by its rows."""
    runtime = (F.col("batch_id") % 7 + 1).cast("double")
    shared = batching.share_batches(table(spark, sf, "events").select("event_id"), 64, [F.col("event_id")], runtime)
    return _rounded(shared, "transcription_time_s")


@query
def average_time(spark: SparkSession, sf: str) -> DataFrame:
    """The total time of a run, shared evenly by its rows; runs are few and hot."""
    rows = table(spark, sf, "events").select("event_id", "event_type")
    total = F.length("event_type") * F.lit(1000.0)
    return _rounded(batching.spread_evenly(rows, total, ["event_type"], "transcription_time_s"), "transcription_time_s")


@query
def page_plan(spark: SparkSession, sf: str) -> DataFrame:
    sources = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("total_rows"))
    return utterances.page_plans(sources)


@query
def paged_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of nested API rows."""
    rows = table(spark, sf, "pages").select(
        F.struct(
            F.col("html").alias("text"),
            (F.length("html") / F.lit(15.0)).alias("audio_length_s"),
            F.array(F.struct(F.col("url").alias("src"))).alias("audio"),
        ).alias("row")
    )
    return _rounded(utterances.paged_texts(rows), "audio_length_s")


@query
def length_buckets(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return batching.length_buckets(docs, "doc_id", "n_chars", budget=60_000, batch=256, order=[F.col("doc_id")])


def _flaky(batch: dict[str, list], seen: set = set()) -> dict[str, list]:  # noqa: B006 - one set per worker, on purpose
    """A batch function that fails for good on some rows and once on others."""
    key = batch["doc_id"][0]
    if key % 40 == 13:
        raise batching.PermanentError("unreadable")
    if key % 25 == 7 and key not in seen:
        seen.add(key)
        raise RuntimeError("busy")
    seen.discard(key)
    return {"predictions": [t + " (heard)" for t in batch["text"]], "references": batch["text"]}


@query
def map_batches_retry(spark: SparkSession, sf: str) -> DataFrame:
    """A row-at-a-time batch function with failures; losses stay visible."""
    docs = _spread_documents(spark, sf).select("doc_id", "text", F.lit(0).alias("audio"))
    mapped = batching.map_batches(
        docs, _flaky, [("predictions", "string"), ("references", "string")], batch_size=1, pause=0.0
    )
    return mapped.select("doc_id", F.length("predictions").alias("n"), "attempts", "error")


def _seen(batch: dict[str, list]) -> dict[str, list]:
    """Tells every row how many rows its batch has."""
    return {"batch_rows": [len(batch["l_orderkey"])] * len(batch["l_orderkey"])}


def _batch_sizes(spark: SparkSession, sf: str, size: int) -> DataFrame:
    """Every row and the size of the batch it went through, in four lanes of known order."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    lanes = lines.repartitionById(4, (F.col("l_suppkey") % 4).cast("int")).sortWithinPartitions("l_orderkey", "l_linenumber", "l_suppkey")
    mapped = batching.map_batches(lanes, _seen, [("batch_rows", "int")], batch_size=size, drop=())
    return mapped.select("l_orderkey", "l_linenumber", "l_suppkey", "batch_rows")


@query
def map_batches_small(spark: SparkSession, sf: str) -> DataFrame:
    """Batches that do not divide an Arrow frame."""
    return _batch_sizes(spark, sf, 96)


@query
def map_batches_large(spark: SparkSession, sf: str) -> DataFrame:
    """Batches larger than an Arrow frame."""
    return _batch_sizes(spark, sf, 12_000)


# Text for each task of a query that bounds its calls by the number of its tasks.
TASK_BYTES = 384 * 2**20


def _answered(batch: dict[str, list]) -> dict[str, list]:
    lane = TaskContext.get().partitionId()
    return {"predictions": [t + "!" for t in batch["text"]], "lane": [lane] * len(batch["text"])}


@query
def map_batches_parallel(spark: SparkSession, sf: str) -> DataFrame:
    """A bounded number of concurrent calls; ``lanes`` counts them."""
    mapped = batching.map_batches(
        _documents(spark, sf), _answered, [("predictions", "string"), ("lane", "int")], batch_size=8, parallel=4,
        task_bytes=TASK_BYTES,
    )
    return mapped.agg(
        F.count_distinct("lane").alias("lanes"),
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.length("predictions")).alias("letters"),
        F.count_if(F.col("predictions") == F.concat("text", F.lit("!"))).alias("right"),
    )


def _served(batch: dict[str, list], seen: set = set()) -> dict[str, list]:  # noqa: B006 - one set per worker, on purpose
    """A service that takes its time, and fails once on some rows."""
    time.sleep(0.002)
    key = batch["doc_id"][0]
    if key % 25 == 7 and key not in seen:
        seen.add(key)
        raise RuntimeError("busy")
    return {"predictions": [t + " (heard)" for t in batch["text"]]}


@query
def map_batches_window(spark: SparkSession, sf: str) -> DataFrame:
    """Four calls in flight in each partition, retries among them; lost batches are dropped."""
    mapped = batching.map_batches(
        _documents(spark, sf), _served, [("predictions", "string")], batch_size=2, pause=0.0, in_flight=4,
        parallel=3, parallel_by=("doc_id",), task_bytes=TASK_BYTES,
    )
    return batching.drop_failed(mapped).groupBy("lang").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.length("predictions")).alias("letters"),
        F.max("in_flight").alias("most_in_flight"),
    )


@query
def surviving_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose call gave a result; those of the others are dropped."""
    docs = _spread_documents(spark, sf)
    return batching.drop_failed(batching.map_batches(docs, _flaky, [("predictions", "string")], batch_size=1, pause=0.0)).select("doc_id", "predictions")


def _signal_sums(batch: dict[str, list]) -> dict[str, list]:
    """Arrays of numbers come as NumPy arrays."""
    return {"total": [round(float(a["array"].astype("float64").sum()), 4) for a in batch["audio"]], "samples": [a["array"].size for a in batch["audio"]]}


@query
def map_batches_signals(spark: SparkSession, sf: str) -> DataFrame:
    """A batch function over signals."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.struct(F.col("embedding").alias("array"), F.lit(16).alias("sampling_rate")).alias("audio"))
    mapped = batching.map_batches(rows, _signal_sums, [("total", "double"), ("samples", "int")], batch_size=32)
    return mapped.select("vec_id", "total", "samples")


# --- paged source ------------------------------------------------------------------------------


def _page_folder(spark: SparkSession, sf: str) -> tuple[str, int]:
    """All ``pages`` as files of a hundred rows, one folder a page: the service that is read from."""
    path = new_path(spark, "served")
    rows = staged(table(spark, sf, "pages"), "pages")
    numbered = indexing.dense_index(rows, [], [F.col("page_id")], "at")
    numbered.withColumn("page", F.expr(f"at div {utterances.PAGE_ROWS}")).write.partitionBy("page").json(path)
    return re.sub("^file:/*", "/", path), rows.count()


def _page_service(folder: str) -> Callable[[int, int], list[dict]]:
    """Fetches rows from the page folders, as nested API rows; every page fails twice first."""
    failed: dict[int, int] = {}

    def fetch(offset: int, length: int) -> list[dict]:
        failed[offset] = failed.get(offset, 0) + 1
        if failed[offset] <= 2:
            raise RuntimeError("the service is busy")
        files = Path(folder, f"page={offset // utterances.PAGE_ROWS}").glob("*.json")
        rows = sorted((json.loads(line) for f in files for line in f.read_text("utf-8").splitlines()), key=lambda r: r["at"])
        wanted = [r for r in rows if offset <= r["at"] < offset + length]
        return [{"row": {"text": r["html"], "audio_length_s": len(r["html"]) / 15.0, "audio": [{"src": r["url"]}]}} for r in wanted]

    return fetch


_API_ROW = "row struct<text: string, audio_length_s: double, audio: array<struct<src: string>>>"


@query
def paged_source(spark: SparkSession, sf: str) -> DataFrame:
    """Whole ``pages`` read page by page through a service that fails twice for each."""
    folder, total = _page_folder(spark, sf)
    rows = paged.read_pages(spark, "served_pages", _page_service(folder), _API_ROW, lambda: total, pause=0.0)
    return _rounded(utterances.paged_texts(rows), "audio_length_s")


@query
def paged_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a stream, in two runs: the service has half of the rows first."""
    folder, total = _page_folder(spark, sf)
    out, progress = new_path(spark, "paged"), new_path(spark, "progress")
    for known in (total // 2, total):
        stream = paged.stream_pages(spark, "served_stream", _page_service(folder), _API_ROW, lambda n=known: n, pause=0.0)
        writer = stream.writeStream.format("parquet").option("checkpointLocation", progress).trigger(availableNow=True)
        writer.start(out).awaitTermination()
    return _rounded(utterances.paged_texts(spark.read.parquet(out)), "audio_length_s")


@query
def failed_batches(spark: SparkSession, sf: str) -> DataFrame:
    docs = _spread_documents(spark, sf)
    mapped = batching.map_batches(docs, _flaky, [("predictions", "string")], batch_size=1, pause=0.0)
    return batching.failure_report(mapped, ["lang"])


# --- streams -----------------------------------------------------------------------------------

# A trigger takes a twelfth of the bytes of a folder (gzip), but no less and no more than this; it shuffles their texts.
_TRIGGER_PARTS, _TRIGGER_BYTES = 12, (2**27, 2**30)


def _trigger_bytes(spark: SparkSession, path: str) -> int:
    return min(max(stored_bytes(spark, path) // _TRIGGER_PARTS, _TRIGGER_BYTES[0]), _TRIGGER_BYTES[1])



def _write_runs(rows: DataFrame, path: str, mode: str = "append", compression: str | None = None) -> None:
    """The stream reads the rows, not their numbers, so the manifest is written without numbering."""
    rows.select(*manifests.RUN_KEYS, F.lit("").alias("audio_filepath"), "duration", "time", "text", "pred_text").write.mode(
        mode
    ).option("ignoreNullFields", "false").option("partitionOverwriteMode", "dynamic").options(
        **manifests.written_as(compression)
    ).partitionBy(*manifests.RUN_KEYS).json(path)


@contextmanager
def _stored_runs(spark: SparkSession, sf: str) -> Iterator[DataFrame]:
    """Aligned runs, made anew from the stored references whenever they are read: a text is stored once, not for each model and side."""
    with staged_while(references(spark, sf), "references", **manifests.ZSTD) as refs:
        yield _aligned(manifest_of(refs))


def _stored(spark: SparkSession, path: str) -> DataFrame:
    scores = streams.stored_scores(spark, path)
    return _rounded(scores, "wer", "rtfx").select("model", "dataset", "split", "samples", "errors", "words", "wer", "rtfx")


@query
def stream_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest files that arrive in three parts, folded into the stored sums."""
    rows, runs = staged(_aligned_runs(spark, sf), "aligned"), new_path(spark, "runs")
    sums, progress = new_path(spark, "sums"), new_path(spark, "progress")
    for part in range(3):
        _write_runs(rows.where(F.col("doc_id") % 3 == part), runs)
        stream = streams.manifest_stream(spark, runs)
        streams.start_leaderboard(stream, sums, progress).awaitTermination()
    return _stored(spark, sums)


@query
def stream_rescoring(spark: SparkSession, sf: str) -> DataFrame:
    """One model's results first have lost every hypothesis; its rerun replaces them and is rescored."""
    runs, sums, progress = (new_path(spark, name) for name in ("runs", "sums", "progress"))
    faulty = F.col("model") == "org/model-b"
    with _stored_runs(spark, sf) as rows:
        _write_runs(rows.withColumn("pred_text", F.when(~faulty, F.col("pred_text"))), runs, compression="gzip")
        streams.start_rescoring(spark, runs, sums, progress).awaitTermination()
        _write_runs(rows.where(faulty), runs, "overwrite", compression="gzip")
    streams.start_rescoring(spark, runs, sums, progress).awaitTermination()
    discard(spark, runs)
    return _stored(spark, sums)


@query
def stream_rescoring_samples(spark: SparkSession, sf: str) -> DataFrame:
    """One model first loses every third hypothesis; files come twice, then its rerun: only what changed is scored again.

    Files that the stream has taken are removed, as from an inbox; the next ones come into the same folder.
    """
    runs, sums, progress = (new_path(spark, name) for name in ("runs", "sums", "progress"))
    faulty = F.col("model") == "org/model-b"
    with _stored_runs(spark, sf) as rows:
        told = rows.select(
            *manifests.RUN_KEYS, F.concat(F.lit("sample_"), "doc_id").alias("audio_filepath"), "duration", "time", "text", "pred_text", "doc_id"
        )
        first = told.withColumn("pred_text", F.when(~(faulty & (F.col("doc_id") % 3 == 0)), F.col("pred_text")))
        for version, part in ((1, first), (1, first.where(F.col("doc_id") % 2 == 0)), (2, told.where(faulty))):
            part.drop("doc_id").withColumn("version", F.lit(version).cast("long")).write.mode("append").option(
                "ignoreNullFields", "false"
            ).options(**manifests.written_as("gzip")).partitionBy(*manifests.RUN_KEYS).json(runs)
            stream = samples.versioned_stream(spark, runs, bytes_per_trigger=_trigger_bytes(spark, runs))
            samples.start_sample_rescoring(stream, sums, progress, buckets=4).awaitTermination()
            discard(spark, runs)
    scores = _rounded(samples.stored_sample_scores(spark, sums), "wer", "rtfx")
    return scores.select("model", "dataset", "split", "samples", "errors", "words", "wer", "rtfx", "scored")
