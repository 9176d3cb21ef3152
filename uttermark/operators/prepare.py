"""Preparation of utterance tables: derived columns, row filters, staged limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttermark.functions.text import has_cjk, has_no_runs, is_scorable
from uttermark.operators.indexing import cut, first_rows
from uttermark.operators.normalize import normalize_by_language, normalize_corpus, profile_of_language
from uttermark.sources.utterances import EXTENDED_TEXT_COLUMNS, TEXT_COLUMNS, text_column

MODEL_SECONDS = 40


def within(length: Column, low: float, high: float) -> Column:
    """Strictly between both bounds."""
    return (length > low) & (length < high)


def seconds(audio: str = "audio") -> Column:
    """Samples over rate, per row."""
    return F.size(F.col(audio)["array"]) / F.col(audio)["sampling_rate"]


def duration_or_seconds(duration: str = "duration", audio: str = "audio") -> Column:
    return F.coalesce(F.col(duration), seconds(audio))


def truncated(signal: Column, rate: Column | int, limit_seconds: int = MODEL_SECONDS) -> Column:
    """The first ``limit_seconds`` of a signal; measure its length before truncating."""
    samples = F.lit(limit_seconds) * (rate if isinstance(rate, Column) else F.lit(rate))
    return F.slice(signal, F.lit(1), samples.cast("int"))


def language_of_config(config: Column) -> Column:
    """What follows the first ``_``; ``en`` when there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(config, r"^[^_]*_(.*)$", 1), F.lit("")), F.lit("en"))


def path_safe(identifier: Column) -> Column:
    return F.translate(identifier, "/", "-")


def model_card(model: Column) -> Column:
    """Last part of a model id, ``-`` as ``_``."""
    return F.translate(F.substring_index(model, "/", -1), "-", "_")


def derive_texts(
    df: DataFrame,
    profile: str = "english",
    language: str | None = None,
    language_col: str | None = None,
    extended: bool = False,
    **options,
) -> DataFrame:
    """Add ``original_text`` and ``norm_text`` from the table's transcript column."""
    source = text_column(df, EXTENDED_TEXT_COLUMNS if extended else TEXT_COLUMNS)
    df = df.withColumn("original_text", F.col(source))
    if language_col is not None:
        return normalize_by_language(df, "original_text", language_col, **options)
    if language is not None:
        profile = profile_of_language(language)
    return normalize_corpus(df, "original_text", profile, **options)


def prepare(
    df: DataFrame,
    limit: int | None = None,
    order: list[Column] | None = None,
    limit_stage: str = "after",
    filter_on: str = "norm_text",
    chinese: bool = False,
    drop: tuple[str, ...] = (),
    **texts,
) -> DataFrame:
    """Derive the texts, keep scorable rows, and take the first ``limit`` rows.

    ``limit_stage`` decides whether the limit counts rows ``before`` or ``after`` the filter;
    ``order`` uses columns of the given table.
    ``filter_on='original_text'`` tests the raw transcript.  ``drop`` names heavy columns that are
    not needed any more.
    """
    if limit and not order:
        raise ValueError("a limit needs an explicit order")
    if limit_stage == "before":
        df = first_rows(df, limit, order or [])

    def kept(rows: DataFrame) -> DataFrame:
        rows = derive_texts(rows, **texts).where(is_scorable(F.col(filter_on)))
        return rows.where(has_no_runs(F.col("norm_text")) & has_cjk(F.col("norm_text"))) if chinese else rows

    if limit_stage == "after" and limit and limit > 0:
        # The key of the last row filters the table as it was given, so that it reaches the scan and only
        # the rows up to it are derived again.
        end = cut(kept(df), limit, order, ties=df.columns)
        return end.rows(kept(df.where(end.reach(df)))).drop(*drop)
    return kept(df).drop(*drop)
