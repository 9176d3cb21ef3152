"""Transcript normalisation as a corpus column job."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttermark.functions import english, number_columns, numbers, text as tx

PROFILES = ("basic", "multilingual", "english")


# Each step is a projection of its own over the attribute before it: a guard and its rewrite read
# the same value twice, and the optimizer does not merge projections where that would repeat work.


def _where(df: DataFrame, guard: Callable[[Column], Column], rewrite: Callable[[Column], Column]) -> DataFrame:
    """Rewrite the working text of the rows that a cheap guard lets through."""
    t = F.col("__text")
    return df.withColumn("__text", F.when(guard(t), rewrite(t)).otherwise(t))


def _without_spans(df: DataFrame) -> DataFrame:
    df = df.withColumn("__text", F.lower("__text"))
    df = _where(df, lambda t: tx.has_any(t, ["<", "["]), tx.drop_bracket_spans)
    return _where(df, lambda t: tx.has_any(t, ["("]), tx.drop_paren_spans)


def _basic(df: DataFrame, remove_diacritics: bool, split_letters: bool, engine: str) -> DataFrame:
    df = _without_spans(df)
    # These two profiles lower the text again; the English one does not ("tm" out of a sign stays "TM").
    plain = F.lower(tx.plain_letters(F.col("__text"), engine))
    letters = plain if remove_diacritics else tx.composed(F.col("__text"), engine)
    if split_letters:
        df = df.withColumn("__text", tx.symbols_to_space(letters))
        return df.withColumn("__text", tx.collapse_space(tx.graphemes(F.col("__text"))))
    return df.withColumn("__text", tx.symbols_and_space_to_space(letters))


def _multilingual(df: DataFrame, remove_diacritics: bool, engine: str) -> DataFrame:
    df = _without_spans(df)
    # These two profiles lower the text again; the English one does not ("tm" out of a sign stays "TM").
    plain = F.lower(tx.plain_letters(F.col("__text"), engine))
    letters = plain if remove_diacritics else tx.composed(F.col("__text"), engine)
    return df.withColumn("__text", tx.only_words(letters))


def expand_words(df: DataFrame) -> DataFrame:
    """Fillers, contractions, titles and endings of the working text."""
    apostrophe = lambda t: tx.has_any(t, ["'"])
    df = _where(df, english.may_have_filler, english.drop_fillers)
    df = _where(df, apostrophe, english.attach_apostrophes)
    tables = (
        # "n't" is the only ending that begins with a letter: rewriting it can lay the ending before
        # it open ("he'dn't"), but only to the rules that come after it.
        (english.CONTRACTIONS + english.TITLES, english.ENDINGS[:7], lambda t: t.isNotNull()),
        ([], english.ENDINGS[7:], apostrophe),
    )
    for whole, endings, guard in tables:
        df = _where(df, guard, lambda t, w=whole, e=endings: english.fence(t, w, e))
        df = _where(df, english.is_fenced, lambda t, r=whole + endings: english.unfence(t, r))
    return df


def _english(df: DataFrame, spelling: dict[str, str] | None, engine: str) -> DataFrame:
    df = expand_words(_without_spans(df))
    df = _where(df, lambda t: tx.has_any(t, [","]), english.join_digit_groups)
    df = _where(df, lambda t: tx.has_any(t, ["."]), english.drop_full_stops)
    clean = tx.symbols_to_space(tx.plain_letters(F.col("__text"), engine), english.NUMERIC_SYMBOLS)
    dictionary = english.spelling_table() if spelling is None else spelling
    fold = number_columns.fold_numbers if engine == "jvm" else numbers.fold_numbers
    if engine == "jvm":
        # The expressions read their text several times.
        df, clean = df.withColumn("__text", clean), F.col("__text")
    df = df.withColumn("__text", fold(clean, dictionary))
    df = _where(df, lambda t: tx.has_any(t, list(english.NUMERIC_SYMBOLS.replace("%", ""))), english.drop_loose_marks)
    df = _where(df, lambda t: tx.has_any(t, ["%"]), english.drop_loose_percents)
    return df.withColumn("__text", F.regexp_replace("__text", " {2,}", " "))


def _settled(df: DataFrame, out: str) -> DataFrame:
    """The working text as ``out``, through a generator of one element.

    The optimizer moves filters on other columns below a generator, down to the scan, but keeps those on its
    output above.  Below plain projections they would repeat the whole chain of rewrites.
    """
    made = F.explode_outer(F.array("__text")).alias(out)
    others = [name for name in df.columns if name != "__text"]
    columns = [made if name.lower() == out.lower() else F.col(f"`{name}`") for name in others]
    return df.select(*columns, *([] if out.lower() in map(str.lower, others) else [made]))


def normalize_corpus(
    df: DataFrame,
    text_col: str,
    profile: str = "english",
    out: str = "norm_text",
    remove_diacritics: bool | None = None,
    split_letters: bool = False,
    spelling: dict[str, str] | None = None,
    fold_apostrophes: bool = False,
    passes: int = 1,
    engine: str = "arrow",
) -> DataFrame:
    """Add ``out``, the normalised form of ``text_col``.

    ``profile`` is ``basic`` (keeps diacritics unless told otherwise), ``multilingual`` or
    ``english``.  ``spelling`` replaces the built-in spelling families by a word dictionary.
    ``fold_apostrophes`` turns typographic apostrophes into ASCII ones first; off by default,
    where they end up as spaces.  ``passes=2`` normalises the result again, as the hosted-service
    runs do; the English profile is not idempotent.  The job is narrow: no shuffle.  Only non-ASCII rows are decomposed,
    and rewrites run only on rows that a byte search finds to be concerned.  Filters set on other columns
    afterwards reach the scan; ``engine="jvm"`` decomposes and folds numbers without Python, and stops them.
    """
    if profile not in PROFILES:
        raise NotImplementedError(f"no profile {profile!r}; expected one of {PROFILES}")
    source = F.col(text_col)
    df = df.withColumn("__text", F.translate(source, "’ʼ", "''") if fold_apostrophes else source)
    for done in range(passes):
        if done:
            df = df.withColumn("__text", F.col(out))
        if profile == "basic":
            df = _basic(df, bool(remove_diacritics), split_letters, engine)
        elif profile == "multilingual":
            df = _multilingual(df, remove_diacritics is not False, engine)
        else:
            df = _english(df, spelling, engine)
        df = _settled(df, out)
    return df


def rewrite_by_table(df: DataFrame, key: list[str], text_col: str, dictionary: DataFrame, out: str = "rewritten") -> DataFrame:
    """Add ``out``: the text, its words separated by spaces, with every word that ``dictionary`` (word, replacement) has replaced.

    For dictionaries of any size: the distinct words of each row meet the table once, and what is found comes
    back to the row, by the columns ``key`` that identify it.  A dictionary below the session's broadcast
    threshold is broadcast by the planner, a larger one is shuffled; the result is the same.  A word that
    the dictionary has twice gets the lesser replacement.  Null texts stay null.
    """
    table = dictionary.select(F.col("word").alias("__word"), F.col("replacement").alias("__new")).where("__word is not null and __new is not null")
    table = table.groupBy("__word").agg(F.min("__new").alias("__new"))
    ids = [F.col(f"`{name}`").alias(f"__k{i}") for i, name in enumerate(key)]
    words = df.select(*ids, F.explode(F.array_distinct(F.split(F.col(f"`{text_col}`"), " "))).alias("__word"))
    found = words.join(table, "__word").groupBy(*[f"__k{i}" for i in range(len(key))])
    found = found.agg(F.map_from_entries(F.collect_list(F.struct("__word", "__new"))).alias("__found"))
    same = reduce(and_, [df[f"`{name}`"].eqNullSafe(found[f"__k{i}"]) for i, name in enumerate(key)])
    joined = df.join(found, same, "left")
    new = F.array_join(F.transform(F.split(F.col(f"`{text_col}`"), " "), lambda w: F.coalesce(F.try_element_at("__found", w), w)), " ")
    kept = [df[f"`{name}`"] for name in df.columns if name.lower() != out.lower()]
    return joined.select(*kept, F.when(F.col("__found").isNull(), F.col(f"`{text_col}`")).otherwise(new).alias(out))


def profile_of_language(language: str, chinese: bool = False) -> str:
    """English has a profile of its own; Chinese has none."""
    if chinese or language == "zh":
        raise NotImplementedError("no profile for Chinese")
    return "english" if language == "en" else "multilingual"


def normalize_by_language(
    df: DataFrame, text_col: str, language_col: str, out: str = "norm_text", **options
) -> DataFrame:
    """Choose the profile row by row: English rows get the English profile, the others the
    multilingual one, with the same options (``spelling`` is for English alone).  A CASE picks the text
    each profile sees, so neither runs on rows it does not own and the table is read once.  A Chinese
    row (``zh``) fails the job, as no profile is meant for it.
    """
    english_row = F.col(language_col) == "en"
    df = df.withColumns(
        {
            "__english": F.when(english_row, F.col(text_col)),
            "__other": F.when(F.col(language_col) == "zh", F.raise_error(F.lit("no profile for Chinese")).cast("string")).when(
                ~F.coalesce(english_row, F.lit(False)), F.col(text_col)
            ),
        }
    )
    df = normalize_corpus(df, "__english", "english", "__norm_english", **options)
    shared = {name: value for name, value in options.items() if name != "spelling"}
    df = normalize_corpus(df, "__other", "multilingual", "__norm_other", **shared)
    df = df.withColumn(out, F.coalesce("__norm_english", "__norm_other"))
    return df.drop("__english", "__other", "__norm_english", "__norm_other")
