"""Rule tables of the English profile and the columns that apply them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from uttermark.functions.text import SPACE, WORD, WORD_END, has_any

# Hesitation sounds.
FILLERS = ["hmm", "mm", "mhm", "mmm", "uh", "um"]

# Whole words, in the order they are applied.
CONTRACTIONS = [
    ("won't", "will not"),
    ("can't", "can not"),
    ("let's", "let us"),
    ("ain't", "aint"),
    ("y'all", "you all"),
    ("wanna", "want to"),
    ("gotta", "got to"),
    ("gonna", "going to"),
    ("i'ma", "i am going to"),
    ("imma", "i am going to"),
    ("woulda", "would have"),
    ("coulda", "could have"),
    ("shoulda", "should have"),
    ("ma'am", "madam"),
]
TITLES = [
    ("mr", "mister "),
    ("mrs", "missus "),
    ("st", "saint "),
    ("dr", "doctor "),
    ("prof", "professor "),
    ("capt", "captain "),
    ("gov", "governor "),
    ("ald", "alderman "),
    ("gen", "general "),
    ("sen", "senator "),
    ("rep", "representative "),
    ("pres", "president "),
    ("rev", "reverend "),
    ("hon", "honorable "),
    ("asst", "assistant "),
    ("assoc", "associate "),
    ("lt", "lieutenant "),
    ("col", "colonel "),
    ("jr", "junior "),
    ("sr", "senior "),
    ("esq", "esquire "),
]
# Word endings, in the order they are applied.
ENDINGS = [
    ("'d been", " had been"),
    ("'s been", " has been"),
    ("'d gone", " had gone"),
    ("'s gone", " has gone"),
    ("'d done", " had done"),
    ("'s got", " has got"),
    ("n't", " not"),
    ("'re", " are"),
    ("'s", " is"),
    ("'d", " would"),
    ("'ll", " will"),
    ("'t", " not"),
    ("'ve", " have"),
    ("'m", " am"),
]

# Fixed value: symbols that carry meaning next to a number.
NUMERIC_SYMBOLS = ".%$¢€£"

# British-to-American spelling, as families: stems, British ending, American ending, inflections.
# A sample made from rules; a full word list is a parameter of the profile.
SPELLING_FAMILIES = [
    (
        "arm behavi clam col endeav fav flav glam harb hon hum lab neighb od parl rum sav splend tum val vap vig",
        "our", "or", " s",
    ),
    ("arm clam col endeav fav flav harb hon hum lab sav vap", "our", "or", "ed ing"),
    ("arm lab", "our", "or", "er ers"),
    ("fav hon", "our", "or", "able ably"),
    ("fav", "our", "or", "ite ites"),
    ("behavi", "our", "or", "al ist"),
    ("neighb", "our", "or", "hood hoods ing"),
    ("col fav flav hum od", "our", "or", "less"),
    ("col", "our", "or", "ful fully"),
    (
        "apolog author capital categor character civil critic emphas final general global harmon maxim memor minim"
        " modern national normal optim organ popular priorit real recogn special stabil standard summar symbol util"
        " visual",
        "is", "iz", "e es ed er ers ing able ation ations",
    ),
    ("anal paral catal", "ys", "yz", "e ed er ers es ing"),
    ("cent fib lit lust meag met mit sab sepulch somb spect theat", "re", "er", " s"),
    ("cata dia ana mono epi pro", "logue", "log", " s"),
    (
        "cancel channel counsel dial fuel label level marshal model panel pedal quarrel signal total travel",
        "l", "", "ed ing er ers",
    ),
    ("def off pret", "ence", "ense", " s"),
    ("", "grey", "gray", " s er est ing ed"),
]


def spelling_table() -> dict[str, str]:
    """The families written out as a word dictionary."""
    return {
        stem + british + inflection: stem + american + inflection
        for stems, british, american, inflections in SPELLING_FAMILIES
        for stem in stems.split(" ")
        for inflection in inflections.split(" ")
    }


def one_of(words: list[str], whole: bool = True) -> str:
    """A pattern of one of the words, as a group, at the end of a word; ``whole`` ones also start there.

    The first two letters are sought before anything else, then what stands before them, then the words that begin so.
    """
    by_start: dict[str, list[str]] = {}
    for word in words:
        by_start.setdefault(word[:2], []).append(word[2:])
    first, second = ("".join(dict.fromkeys(start[i] for start in by_start)) for i in (0, 1))
    alone = f"(?<![{WORD}]..)" if whole else ""
    rest = "|".join(f"(?<={start})(?:{'|'.join(ends)})" for start, ends in by_start.items())
    return f"([{first}][{second}]{alone}(?:{rest})){WORD_END}"


def drop_fillers(text: Column) -> Column:
    """Remove hesitation sounds."""
    return F.regexp_replace(text, one_of(FILLERS), "")


def may_have_filler(text: Column) -> Column:
    return has_any(text, ["mm", "hm", "uh", "um"])


def attach_apostrophes(text: Column) -> Column:
    """Remove the white space in front of an apostrophe."""
    return F.regexp_replace(text, rf"[{SPACE}]+'", "'")


# Private-use characters that fence a word between the two halves of a rewrite.
_OPEN, _CLOSE = "\ue000", "\ue001"


def fence(text: Column, whole: list[tuple[str, str]], endings: list[tuple[str, str]]) -> Column:
    """First half of a rewrite: fence every occurrence, all rules in one pass.

    ``whole`` rules want a whole word, ``endings`` only the end of one.  No rule of a pass produces text another
    one matches, none begins within a match of another that would come after it, and longer endings come before
    their beginnings, so one pass finds what a pass for each table would.
    """
    patterns = [one_of([word for word, _ in rules], alone) for rules, alone in ((whole, True), (endings, False)) if rules]
    groups = "".join(f"${i}" for i in range(1, len(patterns) + 1))
    return F.regexp_replace(text, "|".join(patterns), f"{_OPEN}{groups}{_CLOSE}")


def is_fenced(text: Column) -> Column:
    return F.contains(text, F.lit(_OPEN))


def unfence(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Second half: swap each fenced word.  The text is cut at the fences once, and not searched for each word."""
    entries = F.create_map(*[F.lit(part) for rule in rules for part in rule])

    def swapped(part: Column, i: Column) -> Column:
        word = F.substring_index(part, _CLOSE, 1)
        new = F.when(F.contains(part, F.lit(_CLOSE)), F.try_element_at(entries, word))
        rest = F.substr(part, F.length(word) + 2)
        # A fence that the text brought along stays.
        return F.when(i == 0, part).otherwise(F.coalesce(F.concat(new, rest), F.concat(F.lit(_OPEN), part)))

    return F.array_join(F.transform(F.split(text, _OPEN), swapped), "")


def join_digit_groups(text: Column) -> Column:
    """Drop commas between digits."""
    return F.regexp_replace(text, r"(\p{Nd}),(\p{Nd})", "$1$2")


def drop_full_stops(text: Column) -> Column:
    """Periods that precede no digit become spaces."""
    return F.regexp_replace(text, r"\.([^0-9]|$)", " $1")


def drop_loose_marks(text: Column) -> Column:
    """Drop currency marks and periods before a non-digit."""
    return F.regexp_replace(text, r"[.$¢€£]([^0-9])", " $1")


def drop_loose_percents(text: Column) -> Column:
    """Drop percent signs after a non-digit."""
    return F.regexp_replace(text, r"([^0-9])%", "$1 ")


def drop_loose_symbols(text: Column) -> Column:
    """Both; the first leaves every percent sign in its place."""
    return drop_loose_percents(drop_loose_marks(text))


# A literal map is searched from its start for every word, so it only serves short dictionaries.
LITERAL_MAP_ENTRIES = 32


def rewrite_words(text: Column, dictionary: dict[str, str]) -> Column:
    """Replace each word found in ``dictionary``; words come out joined by single spaces."""
    if len(dictionary) <= LITERAL_MAP_ENTRIES:
        entries = F.create_map(*[F.lit(part) for pair in dictionary.items() for part in pair])
        words = F.split(F.trim(F.regexp_replace(text, rf"[{SPACE}]+", " ")), " ")
        return F.array_join(
            F.transform(words, lambda w: F.coalesce(F.try_element_at(entries, w), w)), " "
        )

    @F.arrow_udf(StringType())
    def rewrite(texts: pa.Array) -> pa.Array:
        return pa.array(
            [
                None if t is None else " ".join(dictionary.get(w, w) for w in t.split())
                for t in texts.to_pylist()
            ],
            pa.string(),
        )

    return rewrite.asNondeterministic()(text)
