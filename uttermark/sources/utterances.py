"""Utterance tables and page plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names a transcript column may have, in order of precedence.
TEXT_COLUMNS = ("text", "sentence", "normalized_text", "transcript", "transcription")
EXTENDED_TEXT_COLUMNS = TEXT_COLUMNS + (
    "txt", "label", "Digit", "Text", "question_text", "Questions", "instruction", "question", "meta_info",
)
# Part of a dataset path -> name of its audio column.
AUDIO_COLUMNS = {"dataset-hakka": "wav", "adi-gov-tw": "mp3", "ASMR": "flac"}
LONGEST_SECONDS = 30
PAGE_ROWS = 100


def load_split(spark: SparkSession, base: str, config: str, split: str) -> DataFrame:
    """One split of one configuration; both are partition columns, so other folders are not listed."""
    return spark.read.parquet(base).where((F.col("config") == config) & (F.col("split") == split))


def load_language_split(spark: SparkSession, base: str, config: str, split: str) -> DataFrame:
    """As ``load_split``, but a language of the shared multilingual configuration is filtered out of it."""
    if "floras" in base and "multilingual" in config:
        wanted = config.split("_")[-1]
        table = load_split(spark, base, "multilingual", split)
        return table.where(F.col("language") == ("eng" if wanted == "en" else wanted))
    return load_split(spark, base, config, split)


def text_column(df: DataFrame, candidates: tuple[str, ...] = TEXT_COLUMNS) -> str:
    """The first candidate that exists as a column (whether or not a row is null there)."""
    found = next((c for c in candidates if c in df.columns), None)
    if found is None:
        raise ValueError(f"expected one of the transcript columns {candidates}, got {df.columns}")
    return found


def audio_column(path: str) -> str:
    return next((name for part, name in AUDIO_COLUMNS.items() if part in path), "audio")


def with_audio_column(df: DataFrame, path: str = "") -> DataFrame:
    """Name the audio column ``audio``: by dataset path, or from ``wav`` where present."""
    name = audio_column(path)
    name = "wav" if name == "audio" and "wav" in df.columns else name
    return df.withColumnRenamed(name, "audio") if name != "audio" else df


def short_enough(duration: Column, limit: float = LONGEST_SECONDS) -> Column:
    """Known and at most ``limit`` seconds."""
    return F.coalesce(duration <= limit, F.lit(False))


def load_short_split(spark: SparkSession, base: str, config: str, split: str) -> DataFrame:
    return with_audio_column(load_split(spark, base, config, split)).where(F.col("duration") <= LONGEST_SECONDS)


def page_plan(spark: SparkSession, total_rows: int, page: int = PAGE_ROWS) -> DataFrame:
    """(offset, length) of each page of a source with ``total_rows`` rows."""
    return spark.range(0, total_rows, page).select(
        F.col("id").alias("offset"), F.least(F.lit(page), F.lit(total_rows) - F.col("id")).cast("int").alias("length")
    )


def page_plans(sources: DataFrame, total: str = "total_rows", page: int = PAGE_ROWS) -> DataFrame:
    """The same for a table of sources: one output row per page."""
    starts = F.when(F.col(total) > 0, F.sequence(F.lit(0).cast("long"), F.col(total) - 1, F.lit(page).cast("long")))
    return sources.select("*", F.explode(starts).alias("offset")).withColumn(
        "length", F.least(F.lit(page).cast("long"), F.col(total) - F.col("offset")).cast("int")
    )


def paged_texts(rows: DataFrame) -> DataFrame:
    """Columns of nested API rows: text, seconds and the address of the audio."""
    return rows.select(
        F.col("row.text").alias("text"),
        F.col("row.audio_length_s").alias("audio_length_s"),
        F.get("row.audio", F.lit(0))["src"].alias("src"),
    )
