"""Alignment of references and hypotheses, lookups, and the evaluation matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Two-letter language codes and their long forms.
LANGUAGE_CODES = {
    "en": "eng_Latn",
    "de": "deu_Latn",
    "fr": "fra_Latn",
    "es": "spa_Latn",
    "it": "ita_Latn",
    "pt": "por_Latn",
    "nl": "nld_Latn",
    "pl": "pol_Latn",
    "cs": "ces_Latn",
    "da": "dan_Latn",
    "el": "ell_Grek",
    "et": "est_Latn",
    "fi": "fin_Latn",
    "hr": "hrv_Latn",
    "hu": "hun_Latn",
    "lt": "lit_Latn",
    "lv": "lvs_Latn",
    "mt": "mlt_Latn",
    "ro": "ron_Latn",
    "ru": "rus_Cyrl",
    "sk": "slk_Latn",
    "sl": "slv_Latn",
    "sv": "swe_Latn",
    "uk": "ukr_Cyrl",
}
DEFAULT_LANGUAGE_CODE = "eng_Latn"

# The datasets of the three evaluation sets.
SHORT_FORM = [
    "ami:test", "earnings22:test", "gigaspeech:test", "librispeech:test.clean",
    "librispeech:test.other", "spgispeech:test", "tedlium:test", "voxpopuli:test",
]
LONG_FORM = [
    "earnings21:test", "earnings22:test", "tedlium:test",
    "ATL:test", "DCA:test", "DCB:test", "DTA:test", "LES:test", "PRV:test", "ROC:test", "VLD:test",
]
MULTILINGUAL = {"fleurs": "de fr it es pt", "mcv": "de es fr it", "mls": "es fr it pt"}


def align(references: DataFrame, hypotheses: DataFrame, keys: list[str]) -> DataFrame:
    """References and hypotheses joined on their key.

    No broadcast hint: the planner (and adaptive execution, from real sizes) broadcasts a side only
    below its threshold and splits skewed partitions otherwise.
    """
    return references.join(hypotheses, keys)


def without_hypothesis(references: DataFrame, hypotheses: DataFrame, keys: list[str]) -> DataFrame:
    return references.join(hypotheses, keys, "left_anti")


def without_reference(references: DataFrame, hypotheses: DataFrame, keys: list[str]) -> DataFrame:
    return hypotheses.join(references, keys, "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; an aligned table must have none."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def language_code(language: Column) -> Column:
    """Long language code, ``eng_Latn`` when unknown.  24 fixed entries: a literal map."""
    codes = F.create_map(*[F.lit(part) for pair in LANGUAGE_CODES.items() for part in pair])
    return F.coalesce(F.try_element_at(codes, language), F.lit(DEFAULT_LANGUAGE_CODE))


def matrix_entries(entries: list[str]) -> Column:
    """``name:split`` entries as an array of (dataset, split)."""
    return F.array(
        *[
            F.struct(F.lit(e.split(":")[0]).alias("dataset"), F.lit(e.split(":")[-1]).alias("split"))
            for e in entries
        ]
    )


def multilingual_entries(languages: dict[str, str], split: str = "test") -> Column:
    """Per-dataset language lists as an array of (dataset, split), dataset being ``name_language``."""
    return matrix_entries([f"{name}_{code}:{split}" for name, codes in languages.items() for code in codes.split()])


def evaluation_matrix(models: DataFrame, entries: Column, model: str = "model") -> DataFrame:
    """One row per model and entry.  The entries are configuration, held in one array and exploded
    beside each model, so no cross join is needed."""
    return models.select(model, F.explode(entries).alias("e")).select(model, "e.dataset", "e.split")


def missing_runs(matrix: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Planned runs without results.  Runs are reduced to their distinct keys before the shuffle."""
    return matrix.join(runs.select(*keys).distinct(), keys, "left_anti")


def present_runs(matrix: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    return matrix.join(runs.select(*keys).distinct(), keys, "left_semi")
