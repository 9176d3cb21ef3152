"""Text-cleaning column functions.

Every function takes a column and returns a column.  Character classes are spelled with Unicode
properties because plain ``\\w``, ``\\s`` and ``\\b`` are ASCII-only in Java patterns.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from uttermark.functions.frames import row_by_row

# Contents of a character class: every white-space character, and every word character.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
# White space among the control characters.
CONTROL_SPACE = r"\x09-\x0d\x1c-\x1f\x85"

# Zero-width tests for the two ends of a word.
WORD_START = rf"(?<![{WORD}])"
WORD_END = rf"(?![{WORD}])"

# Letters that compatibility decomposition leaves alone, and their spelling.
SPECIAL_LETTERS = {
    "œ": "oe",
    "Œ": "OE",
    "ø": "o",
    "Ø": "O",
    "æ": "ae",
    "Æ": "AE",
    "ß": "ss",
    "ẞ": "SS",
    "đ": "d",
    "Đ": "D",
    "ð": "d",
    "Ð": "D",
    "þ": "th",
    "Þ": "th",
    "ł": "l",
    "Ł": "L",
}

# Fixed value: a transcript that only marks a stretch of audio not to be scored.
NOT_SCORED_MARKER = "ignore time segment in scoring"

_ICU_NORMALIZER = "com.ibm.icu.text.Normalizer"


def is_ascii(text: Column) -> Column:
    """True when the text has only one-byte characters."""
    return F.octet_length(text) == F.length(text)


_NON_ASCII = re.compile(r"[^\x00-\x7f]+")


def _normal_form_arrow(form: str):
    @F.arrow_udf(StringType())
    def normal_form(texts: pa.Array) -> pa.Array:
        return row_by_row(lambda t: unicodedata.normalize(form, t), pa.string(), texts)

    return normal_form


def _plain_arrow():
    """NFKD, with the special letters spelled out.

    ASCII characters do not decompose and marks never move past them, so the runs between them are taken on their own.
    """

    @F.arrow_udf(StringType())
    def plain(texts: pa.Array) -> pa.Array:
        spelling = str.maketrans(SPECIAL_LETTERS)

        def spelled(run: str) -> str:
            return unicodedata.normalize("NFKD", run).translate(spelling)

        short = lru_cache(maxsize=4096)(spelled)

        def one(match: re.Match) -> str:
            return (short if len(match[0]) < 16 else spelled)(match[0])

        return row_by_row(lambda t: _NON_ASCII.sub(one, t), pa.string(), texts)

    return plain


def decompose(text: Column, engine: str = "jvm") -> Column:
    """Compatibility decomposition (NFKD).

    ``engine='jvm'`` calls the ICU class that ships with Spark through ``reflect``, which counts as
    non-deterministic and stops later filters; ``'arrow'`` ships the non-ASCII rows to Python.
    """
    if engine == "arrow":
        return _normal_form_arrow("NFKD")(text)
    return F.reflect(F.lit(_ICU_NORMALIZER), F.lit("decompose"), text, F.lit(True))


def compose(text: Column, engine: str = "jvm") -> Column:
    """Compatibility composition (NFKC)."""
    if engine == "arrow":
        return _normal_form_arrow("NFKC")(text)
    return F.reflect(F.lit(_ICU_NORMALIZER), F.lit("compose"), text, F.lit(True))


def has_any(text: Column, pieces: list[str]) -> Column:
    """The text contains one of the literal pieces: a byte search, much cheaper than a pattern."""
    return reduce(lambda found, piece: found | F.contains(text, F.lit(piece)), pieces, F.lit(False))


def may_be_untidy(text: Column) -> Column:
    """Not surely words separated by single spaces; byte searches except for non-ASCII rows."""
    controls = ["\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f"]
    return (
        has_any(text, ["  ", *controls])
        | F.startswith(text, F.lit(" "))
        | F.endswith(text, F.lit(" "))
        | (~is_ascii(text) & text.rlike(r"[\x85\p{Z}&&[^ ]]"))
    )


def drop_bracket_spans(text: Column) -> Column:
    """Remove ``<...>`` and ``[...]`` spans; the two kinds may be mixed."""
    return F.regexp_replace(text, r"[<\[][^>\]]*[>\]]", "")


def drop_paren_spans(text: Column) -> Column:
    """Remove non-empty, non-nested ``(...)`` spans."""
    return F.regexp_replace(text, r"\(([^)]+?)\)", "")


def plain_letters(text: Column, engine: str = "jvm") -> Column:
    """Decompose, drop non-spacing marks, spell out the special letters; the case stays as decomposition leaves it.

    ``text``, lower-case already, must be a plain attribute: it is referenced several times.  ASCII rows pass through.
    """
    if engine == "arrow":
        plain = F.regexp_replace(_plain_arrow()(_non_ascii_only(text, engine)), r"\p{Mn}", "")
        return F.when(~is_ascii(text), plain).otherwise(text)
    folded = F.regexp_replace(decompose(text, engine), r"\p{Mn}", "")
    one_to_one = {k: v for k, v in SPECIAL_LETTERS.items() if len(v) == 1}
    folded = F.translate(folded, "".join(one_to_one), "".join(one_to_one.values()))
    for letter, spelling in SPECIAL_LETTERS.items():
        if len(spelling) > 1:
            folded = F.replace(folded, F.lit(letter), F.lit(spelling))
    return F.when(~is_ascii(text), folded).otherwise(text)


def composed(text: Column, engine: str = "jvm") -> Column:
    """NFKC, lower case again, of the rows that need it; ``text`` must be a plain attribute."""
    return F.when(~is_ascii(text), F.lower(compose(_non_ascii_only(text, engine), engine))).otherwise(text)


def _non_ascii_only(text: Column, engine: str) -> Column:
    # A Python function is evaluated for every row whatever the CASE around it says, so the rows
    # that do not need it are sent as nulls.
    return text if engine == "jvm" else F.when(~is_ascii(text), text)


def symbols_to_space(text: Column, keep: str = "") -> Column:
    """Every mark, symbol and punctuation character becomes one space, except those in ``keep``."""
    exempt = f"&&[^{keep}]" if keep else ""
    return F.regexp_replace(text, rf"[\p{{M}}\p{{S}}\p{{P}}{exempt}]", " ")


def drop_unprintable(text: Column) -> Column:
    """Remove control, format and unassigned characters, but no white space.

    Once marks, symbols and punctuation are spaces, these are all that is neither a word character
    nor white space.
    """
    return F.regexp_replace(text, rf"[\p{{C}}&&[^{SPACE}]]", "")


def only_words(text: Column) -> Column:
    """Runs of anything but letters and numbers become one space, none at the ends.

    The symbol, non-word and white-space steps of the multilingual profile in two passes.
    """
    return F.trim(F.regexp_replace(drop_unprintable(text), r"[^\p{L}\p{N}]+", " "))


def symbols_and_space_to_space(text: Column) -> Column:
    """Runs of marks, symbols, punctuation and white space become one space.

    White space among the control characters is turned first: two plain classes are searched faster
    than their union.
    """
    text = F.regexp_replace(text, rf"[{CONTROL_SPACE}]", " ")
    return F.regexp_replace(text, r"[^\p{L}\p{N}\p{C}]+", " ")


def collapse_space(text: Column) -> Column:
    """Each run of white space becomes one space."""
    return F.regexp_replace(text, rf"[{SPACE}]+", " ")


def strip(text: Column) -> Column:
    """Remove white space at both ends."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def clusters(text: Column) -> Column:
    """Grapheme clusters as an array; ``text`` as for ``graphemes``."""
    plain = is_ascii(text) & ~F.contains(text, F.lit("\r"))
    return F.when(plain, F.split(text, "")).otherwise(F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0)))


# Beyond ASCII: Latin, Greek, Cyrillic and Chinese letters, kana and Korean syllables; no marks, joiners or jamo.
_PLAIN = (
    r"\A[\x00-\x0c\x0e-\x{2ff}\x{370}-\x{482}\x{48a}-\x{52f}\x{1e00}-\x{1eff}"
    r"\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}]*+\z"
)


def is_plain(text: Column) -> Column:
    """Every character is a grapheme cluster, for sure; others may be too."""
    return (is_ascii(text) & ~F.contains(text, F.lit("\r"))) | text.rlike(_PLAIN)


def graphemes(text: Column) -> Column:
    """Grapheme clusters joined by spaces, for character-level scoring.

    ``text`` must be a plain attribute.  In ASCII every character is a cluster but for ``\\r\\n``.
    """
    return F.array_join(clusters(text), " ")


def drop_special_tokens(text: Column) -> Column:
    """Strip decoder tags such as ``<|en|>`` from model output."""
    return F.regexp_replace(strip(text), r"<\|[^\n]*?\|>", "")


def blank_to_space(text: Column) -> Column:
    """Stripped text, or one space when nothing is left."""
    stripped = strip(text)
    return F.coalesce(F.nullif(stripped, F.lit("")), F.when(text.isNotNull(), F.lit(" ")))


def is_scorable(text: Column) -> Column:
    """Neither blank nor the not-scored marker."""
    return ~strip(text).isin("", NOT_SCORED_MARKER)


def has_no_runs(text: Column) -> Column:
    """No character occurs three or more times in a row."""
    return ~text.rlike(r"([^\n])\1{2,}")


def has_cjk(text: Column) -> Column:
    return text.rlike(r"[一-鿿]")
