"""Nested question records: choose one recording per sentence and assemble the signal.

All row-local: a record with its sentences is one row, so nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Languages one of the two error-rate sources cannot judge.
SEAMLESS_UNSUPPORTED = [
    "ast_Latn", "hau_Latn", "kam_Latn", "kea_Latn", "lin_Latn", "mri_Latn",
    "nso_Latn", "oci_Latn", "tgl_Latn", "umb_Latn", "wol_Latn", "xho_Latn",
]
WHISPER_UNSUPPORTED = [
    "ast_Latn", "ceb_Latn", "ckb_Arab", "fuv_Latn", "gle_Latn", "ibo_Latn",
    "kam_Latn", "kea_Latn", "kir_Cyrl", "lug_Latn", "luo_Latn", "nso_Latn",
    "tgl_Latn", "umb_Latn", "wol_Latn", "xho_Latn", "zul_Latn",
]


def recording_scores(sentence: Column, language: Column) -> Column:
    """Error rate per recording of a sentence: the judging source for the language, or the mean of both."""
    whisper, seamless = sentence["whisper_asr_cer"], sentence["seamlessm4t_asr_cer"]
    return (
        F.when(language.isin(WHISPER_UNSUPPORTED), seamless)
        .when(language.isin(SEAMLESS_UNSUPPORTED), whisper)
        .otherwise(F.zip_with(whisper, seamless, lambda a, b: (a + b) / 2))
    )


def chosen_position(sentence: Column, language: Column, strategy: str, seed: int = 0, key: Column | None = None) -> Column:
    """1-based position of the chosen recording.

    ``best`` is the first with the lowest score, ``worst`` the first with the highest; ``random`` is
    drawn from a hash of ``key``, the sentence id and ``seed``, so a rerun draws the same.
    """
    if strategy == "random":
        parts = [key] if key is not None else []
        named = F.concat_ws(":", *[p.cast("string") for p in (*parts, sentence["id"], F.lit(seed))])
        draw = F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long")
        return (draw % F.size(sentence["audio"]) + 1).cast("int")
    if strategy not in ("best", "worst"):
        raise ValueError(f"unknown strategy {strategy!r}")
    scores = recording_scores(sentence, language)
    extreme = F.array_min(scores) if strategy == "best" else F.array_max(scores)
    return F.array_position(scores, extreme).cast("int")


def ordered_sentences(sentences: Column) -> Column:
    """Sentences by ascending id."""
    return F.array_sort(
        sentences,
        lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0),
    )


def select_recordings(
    records: DataFrame,
    strategy: str,
    language: Column,
    sentences: str = "sentence_data",
    key: Column | None = None,
    seed: int = 0,
    out: str = "chosen",
) -> DataFrame:
    """Add ``out``: per sentence, in id order, a struct of id, position and the chosen recording."""

    def choose(s: Column) -> Column:
        position = chosen_position(s, language, strategy, seed, key)
        return F.struct(
            s["id"].alias("id"), position.alias("position"), F.try_element_at(s["audio"], position).alias("audio")
        )

    return records.withColumn(out, F.transform(ordered_sentences(F.col(sentences)), choose))


def to_mono(frames: Column) -> Column:
    """Mean over the channels of each frame."""
    return F.transform(frames, lambda f: F.aggregate(f, F.lit(0.0), lambda a, x: a + x) / F.size(f))


def concatenated(signals: Column) -> Column:
    """One signal from an array of signals."""
    return F.flatten(signals)


def assemble_records(
    records: DataFrame,
    strategy: str,
    language: Column,
    key: Column | None = None,
    seed: int = 0,
    rate: int = 16_000,
    max_seconds: float | None = None,
    limit: int | None = None,
    order: list[Column] | None = None,
    limit_stage: str = "before",
) -> DataFrame:
    """Sort sentences, choose recordings, concatenate their signals into ``audio``, drop the nested
    column, and keep records of at most ``max_seconds``.  ``limit_stage`` says on which side of
    that filter the ``limit`` acts.  Signals of several channels become their means first; a record
    with recordings of different sampling rates fails, as they share no one length."""
    from uttermark.operators.indexing import first_rows

    chosen = select_recordings(records, strategy, language, key=key, seed=seed)
    signal = chosen.schema["chosen"].dataType.elementType["audio"].dataType["array"].dataType
    channels = isinstance(signal.elementType, T.ArrayType)
    parts = F.transform("chosen", lambda c: to_mono(c["audio"]["array"]) if channels else c["audio"]["array"])
    rates = F.array_distinct(F.transform("chosen", lambda c: c["audio"]["sampling_rate"]))
    mixed = F.raise_error(F.lit("recordings of one record have different sampling rates"))
    kind = "array<double>" if channels else signal.simpleString()
    whole = chosen.withColumn("audio", F.when(F.size(rates) > 1, mixed.cast(kind)).otherwise(concatenated(parts)))
    whole = whole.drop("sentence_data", "chosen")
    if limit_stage == "before":
        whole = first_rows(whole, limit, order or [])
    if max_seconds:
        whole = whole.where(F.size("audio") / rate <= max_seconds)
    return first_rows(whole, limit, order or []) if limit_stage == "after" else whole


def flatten_recordings(
    records: DataFrame,
    keys: list[str],
    sentences: str = "sentence_data",
    text: str = "transcription",
    max_seconds: float | None = None,
) -> DataFrame:
    """One row per recording of every sentence, keyed by record, sentence and recording position."""
    flat = (
        records.select(*keys, F.posexplode(sentences).alias("sentence_pos", "s"))
        .select(*keys, "sentence_pos", F.col(f"s.{text}").alias("text"), F.posexplode("s.audio").alias("audio_pos", "audio"))
    )
    if max_seconds is not None:
        flat = flat.where(F.size("audio.array") / F.col("audio.sampling_rate") <= max_seconds)
    return flat
