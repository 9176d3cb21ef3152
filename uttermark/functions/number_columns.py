"""The fold of spelled-out numbers as column expressions, without a Python worker.

The token machine is one ``aggregate`` over the words of a text.  Its state is a struct: what is written, the
pending number as a string of digits, whether that number counts as text, the pending mark, and whether the
next word is used up.  Numbers are digit strings throughout, so that no amount is too large.
"""

from __future__ import annotations

import sys
import unicodedata
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F

from uttermark.functions.numbers import DECIMAL_WORDS, LEXICON, MARKS
from uttermark.functions.text import SPACE, WORD_END, WORD_START

#: Written words are held in one string up to this many bytes, so that long texts are not copied for each word.
BUFFER = 1024
#: Entries of a dictionary that is part of the expression.
MOST_ENTRIES = 1000
_MARKS = "[" + "".join(sorted(MARKS, key=lambda c: (c != "-", c))).replace("-", r"\-") + "]"
_NUMERAL = r"\p{Nd}+(?:\.\p{Nd}+)?"
# Noncharacters, which no text holds, fence what stands before "and a half" and the words to fold.
_BEFORE, _BLANK, _HALF = "\ufdd0", "\ufdd1", "\ufdd2"
_BORDER = "\ufdd3"


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _either(*cases: tuple[Column, Column], otherwise: Column) -> Column:
    chosen = None
    for condition, value in cases:
        chosen = F.when(condition, value) if chosen is None else chosen.when(condition, value)
    return chosen.otherwise(otherwise)


def _ascii_digits(token: Column) -> Column:
    """Decimal digits of every script as 0-9."""
    other = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    plain = "".join(str(unicodedata.decimal(c)) for c in other)
    return F.when(F.octet_length(token) > F.length(token), F.translate(token, "".join(other), plain)).otherwise(token)


def _table(entries: dict[str, Column], buckets: int = 64):
    """A lookup in ``entries``.  A map is searched entry by entry, so the words are dealt over several by their CRC-32."""
    kind = next(iter(entries.values()))
    dealt: list[list[Column]] = [[] for _ in range(buckets)]
    for word, value in entries.items():
        dealt[crc32(word.encode()) % buckets] += [F.lit(word), value]
    # Each map has an entry that no word meets, so that none is empty.
    maps = F.array(*[F.create_map(F.lit(" "), kind, *some) for some in dealt])
    return lambda word: F.try_element_at(F.get(maps, (F.crc32(word) % buckets).cast("int")), word)


def _without_zeros(digits: Column) -> Column:
    return F.regexp_replace(digits, "^0+(?=[0-9])", "")


def _plus(number: Column, small: Column) -> Column:
    """Digits of any length (none for nothing) plus a number of three digits at most."""
    head, tail = F.substr(number, F.lit(1), F.greatest(F.length(number) - 18, F.lit(0))), F.right(number, F.lit(18))
    total = F.coalesce(F.try_to_number(tail, F.lit("9" * 18)).cast("bigint"), F.lit(0)) + small.cast("bigint")
    rest, digit, nines = (F.regexp_extract(head, "^([0-9]*?)([0-8]?)(9*)$", i) for i in (1, 2, 3))
    up = F.when(digit == "", F.lit("1")).otherwise(F.translate(digit, "012345678", "123456789"))
    carried = F.concat(rest, up, F.repeat(F.lit("0"), F.length(nines)), F.right(total.cast("string"), F.lit(18)))
    whole = total.cast("string")
    return _either((head == "", whole), (total < 10**18, F.concat(head, F.lpad(whole, 18, "0"))), otherwise=carried)


def _times(number: Column, zeros: Column) -> Column:
    """The last three digits times a power of ten, added to the thousands before them."""
    last = F.right(number, F.lit(3)).cast("int")
    thousands = F.concat(F.substr(number, F.lit(1), F.greatest(F.length(number) - 3, F.lit(0))), F.lit("000"))
    above = F.substr(thousands, F.lit(1), F.greatest(F.length(thousands) - zeros, F.lit(0)))
    below = F.right(F.concat(F.repeat(F.lit("0"), zeros), thousands), zeros)
    return F.when(last == 0, number).when(F.length(number) <= 3, F.concat(last.cast("string"), F.repeat(F.lit("0"), zeros))).otherwise(
        F.concat(_plus(above, last), below)
    )


def _state(emit: Column, number: Column, text: Column, mark: Column, skip: Column) -> Column:
    return F.struct(
        emit.cast("string").alias("emit"),
        number.cast("string").alias("number"),
        text.cast("boolean").alias("text"),
        mark.cast("string").alias("mark"),
        skip.cast("boolean").alias("skip"),
    )


def _step(s: Column, x: Column) -> Column:
    """What a word writes, and the state behind it."""
    none, no, yes, blank = F.lit(None).cast("string"), F.lit(False), F.lit(True), F.lit("")
    number, text, mark, word, amount, suffix = s["number"], s["text"], s["mark"], x["word"], x["amount"], x["suffix"]
    open_, plain = number.isNotNull(), suffix == ""
    follows = x["next_role"].isNotNull() | x["next_digits"]
    pending = F.when(open_, F.concat(mark, number, F.lit(" "))).otherwise(blank)
    left = F.when(open_, blank).otherwise(mark)
    as_text = F.when(open_ & (text | (number != "0")), number).otherwise(blank)
    same = _state(blank, number, text, mark, no)
    # A mark goes in front of the pending number, or of the word where there is none.
    word_behind = _state(F.concat(mark, F.coalesce(F.concat(number, F.lit(" ")), blank), word, F.lit(" ")), none, no, blank, no)

    def put(value: Column, is_text: Column, before: Column = blank, own_mark: Column = mark) -> Column:
        """A plain number word stays open; one with a suffix closes the number."""
        closed = _state(F.concat(before, own_mark, value, suffix, F.lit(" ")), none, no, blank, no)
        return F.when(plain, _state(before, value, is_text, own_mark, no)).otherwise(closed)

    def as_typed(value: Column) -> Column:
        return _state(blank, value, yes, mark, no)

    # Digits.
    signed = word.rlike(f"^{_MARKS}")
    bare = F.when(signed, F.substr(word, F.lit(2))).otherwise(word)
    ascii_ = _ascii_digits(bare)
    whole = ascii_.rlike(r"^[0-9]+(\.0+)?$")
    value = F.when(whole, _without_zeros(F.regexp_replace(ascii_, r"\..*", ""))).otherwise(bare)
    digits = F.when(open_ & text & number.endswith("."), as_typed(F.concat(number, word))).otherwise(
        _state(pending, value, ~whole, F.when(signed, F.left(word, F.lit(1))).otherwise(left), no)
    )

    # Words below one hundred.
    low = F.length(amount) == 1
    kept = F.substr(number, F.lit(1), F.length(number) - F.length(amount))
    round_ = (number == "0") | F.when(low, number.endswith("0")).otherwise(number.endswith("00"))
    small = _either(
        (~open_, put(amount, no)),
        (text & low & (x["prev"] == "tens"), put(F.concat(kept, amount), yes)),
        (~text & (x["prev"] != "small") & round_, put(F.when(number == "0", amount).otherwise(F.concat(kept, amount)), no)),
        otherwise=put(F.concat(number, amount), yes),
    )

    # Powers.
    zeros = F.length(amount) - 1
    exact = _ascii_digits(number)
    parts = F.regexp_extract(exact, r"^([0-9]*)", 1), F.regexp_extract(exact, r"^[0-9]*\.([0-9]*?)0*$", 1)
    product = _without_zeros(F.concat(parts[0], parts[1], F.repeat(F.lit("0"), zeros - F.length(parts[1]))))
    fits = exact.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$") & (F.length(parts[1]) <= zeros)
    times = _either(
        (~open_, put(amount, no)),
        (~text, put(_times(number, zeros), no)),
        (fits, put(product, no)),
        otherwise=put(amount, no, pending, blank),
    )

    point = _either(
        (~follows, word_behind),
        (x["next_role"].isNull() | x["next"].isin(sorted(DECIMAL_WORDS)), as_typed(F.concat(as_text, F.lit(".")))),
        otherwise=same,
    )
    repeated = _state(blank, F.concat(as_text, F.repeat(x["next_amount"], amount.cast("int"))), yes, mark, yes)
    percent = _either(
        (~open_, word_behind),
        (~plain & ~x["next"].eqNullSafe(suffix), word_behind),
        otherwise=_state(F.concat(mark, number, amount, F.lit(" ")), none, no, blank, ~plain),
    )
    role = F.coalesce(x["role"], F.lit("other"))
    return _either(
        (s["skip"], same),
        (role == "other", F.when(x["digits"], digits).otherwise(word_behind)),
        (role.isin("small", "tens"), small),
        (role == "zero", as_typed(F.concat(as_text, F.lit("0")))),
        (role == "times", times),
        (role == "and", F.when(~follows | (x["prev"] != "times"), word_behind).otherwise(same)),
        (role == "point", point),
        (role == "repeat", F.when(x["next_plain"].isin("zero", "small"), repeated).otherwise(word_behind)),
        (role == "sign", F.when(follows, _state(pending, none, no, amount, no)).otherwise(word_behind)),
        (role == "currency", F.when(open_, _state(F.concat(amount, number, F.lit(" ")), none, no, blank, no)).otherwise(word_behind)),
        otherwise=percent,
    )


def _words_with_neighbours(words: Column) -> Column:
    """Each word with its role, amount and suffix, and what the machine asks about the words beside it."""
    entries = {}
    for word, (role, amount, suffix) in LEXICON.items():
        plain = role if role == "percent" or not suffix else "suffixed"
        parts = {"role": role, "amount": "" if amount is None else str(amount), "suffix": suffix, "plain": plain}
        entries[word] = F.struct(*[F.lit(v).alias(k) for k, v in parts.items()])
    lexicon = _table(entries)
    known = F.transform(words, lambda w: F.struct(w.alias("word"), lexicon(w).alias("entry")))

    def beside(all_: Column) -> Column:
        def one(own: Column, i: Column) -> Column:
            before, after = F.get(all_, i - 1), F.get(all_, i + 1)
            entry, behind = own["entry"], after["entry"]
            return F.struct(
                own["word"].alias("word"),
                entry["role"].alias("role"),
                F.coalesce(entry["amount"], F.lit("")).alias("amount"),
                F.coalesce(entry["suffix"], F.lit("")).alias("suffix"),
                (entry.isNull() & own["word"].rlike(f"^{_MARKS}?{_NUMERAL}$")).alias("digits"),
                F.coalesce(before["entry"]["plain"], F.lit("other")).alias("prev"),
                after["word"].alias("next"),
                behind["role"].alias("next_role"),
                behind["plain"].alias("next_plain"),
                behind["amount"].alias("next_amount"),
                F.coalesce(after["word"].rlike(f"^{_NUMERAL}$"), F.lit(False)).alias("next_digits"),
            )

        return F.transform(all_, one)

    return _bind(known, beside)


def _any_of(words) -> str:
    """A pattern of words, told apart by their first letters."""
    by_letter: dict[str, list[str]] = {}
    for word in sorted(words, key=lambda w: (-len(w), w)):
        by_letter.setdefault(word[0], []).append(word[1:])
    return "(?:" + "|".join(f"{letter}(?:{'|'.join(ends)})" for letter, ends in sorted(by_letter.items())) + ")"


def _pieces(text: Column) -> Column:
    """Number words and numerals one by one, and the words between them as one piece: the machine treats them alike."""
    concerned = rf"(?<![^ ])({_any_of(LEXICON)}|{_MARKS}?{_NUMERAL})(?![^ ])"
    cut = F.split(F.regexp_replace(text, concerned, f"{_BORDER}$1{_BORDER}"), _BORDER)
    return F.filter(F.transform(cut, lambda piece: F.trim(piece)), lambda piece: piece != "")


def _folded_words(text: Column) -> Column:
    """The fold of words separated by single blanks."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), F.lit("").alias("buffer"), _state(F.lit(""), F.lit(None), F.lit(False), F.lit(""), F.lit(False)).alias("at"))

    def merge(held: Column, x: Column) -> Column:
        def write(at: Column) -> Column:
            full = F.octet_length(held["buffer"]) > BUFFER
            return F.struct(
                F.when(full, F.concat(held["done"], F.array(held["buffer"]))).otherwise(held["done"]).alias("done"),
                F.when(full, at["emit"]).otherwise(F.concat(held["buffer"], at["emit"])).alias("buffer"),
                at.alias("at"),
            )

        return _bind(_step(held["at"], x), write)

    def finish(held: Column) -> Column:
        last = F.when(held["at"]["number"].isNotNull(), F.concat(held["at"]["mark"], held["at"]["number"])).otherwise(F.lit(""))
        return F.rtrim(F.concat(F.array_join(held["done"], ""), held["buffer"], last))

    return F.aggregate(_words_with_neighbours(_pieces(text)), start, merge, finish)


def _single_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def _halves(text: Column) -> Column:
    """``two and a half`` -> ``two point five``; after another word it stays, without a word before it it goes."""
    word = f"[^{SPACE}]"
    numeric = sorted(DECIMAL_WORDS | {w for w, (role, _, suffix) in LEXICON.items() if role == "times" and not suffix})
    fenced = F.regexp_replace(
        text, rf"({word}*)([{SPACE}]*){WORD_START}and[{SPACE}]+a[{SPACE}]+half{WORD_END}", f"{_BEFORE}$1{_BLANK}$2{_HALF}"
    )
    for pattern, made in (
        (f"{_BEFORE}{_BLANK}[{SPACE}]*{_HALF}", " "),
        (f"{_BEFORE}({'|'.join(numeric)}){_BLANK}([{SPACE}]*){_HALF}", "$1$2 point five "),
        (f"{_BEFORE}([^{_BLANK}]*){_BLANK}([{SPACE}]*){_HALF}", "$1$2 and a half "),
    ):
        fenced = F.regexp_replace(fenced, pattern, made)
    return F.when(F.contains(text, F.lit("half")), fenced).otherwise(text)


def fold_numbers(text: Column, dictionary: dict[str, str] | None = None) -> Column:
    """As ``numbers.fold_numbers``, in the JVM: digits for spelled-out numbers, then the word dictionary.

    A dictionary of more than ``MOST_ENTRIES`` words is a table: see ``normalize.rewrite_by_table``.
    """
    if dictionary and len(dictionary) > MOST_ENTRIES:
        raise ValueError("too large a dictionary for an expression; see normalize.rewrite_by_table")
    concerned = text.rlike(rf"\p{{Nd}}|half|(?<![^{SPACE}]){_any_of(LEXICON.keys() - {'and'})}(?![^{SPACE}])")
    made = _halves(text)
    for pattern, kept in (("([a-z])([0-9])", "$1 $2"), ("([0-9])([a-z])", "$1 $2"), (rf"([0-9])[{SPACE}]+(st|nd|rd|th|s){WORD_END}", "$1$2")):
        made = F.regexp_replace(made, pattern, kept)
    made = _folded_words(_single_blanks(made))
    for pattern, kept in (
        (rf"([€£$])([0-9]+) (?:and )?¢([0-9]){WORD_END}", "$1$2.0$3"),
        (rf"([€£$])([0-9]+) (?:and )?¢([0-9]{{2}}){WORD_END}", "$1$2.$3"),
        (rf"[€£$]0[^\n]0?([0-9]){WORD_END}", "¢$1"),
        (rf"[€£$]0[^\n]([1-9][0-9]){WORD_END}", "¢$1"),
        (rf"{WORD_START}1(s?){WORD_END}", "one$1"),
    ):
        made = F.regexp_replace(made, pattern, kept)
    folded = F.when(concerned, made).otherwise(_single_blanks(text))
    if not dictionary:
        return folded
    spelling = _table({word: F.lit(other) for word, other in dictionary.items()})
    return F.array_join(F.transform(F.split(folded, " "), lambda w: F.coalesce(spelling(w), w)), " ")
