"""Multiple-choice prompts and answers, segment joining, substring search."""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from uttermark.functions.text import strip

# The answer letters and the closing instruction of the numbered prompt.
ANSWER_LETTERS = "ABCD"
INSTRUCTION = (
    "Listen to the audio passage, then answer the following question by responding with ONLY the number "
    "(1, 2, 3, or 4) of the correct answer."
)


def answer_number(text: Column) -> Column:
    """First of ``1``-``4`` or ``A``-``D`` in the text as 1..4; -1 when there is none."""
    symbol = F.translate(F.regexp_extract(text, "[1-4A-D]", 0), ANSWER_LETTERS, "1234")
    return F.coalesce(F.nullif(symbol, F.lit("")).try_cast("int"), F.lit(-1))


def numbered_prompt(question: Column, options: list[Column]) -> Column:
    """Question, options ``1.`` to ``4.``, then the instruction."""
    lines = [F.concat(F.lit("Question: "), question)]
    lines += [F.concat(F.lit(f"{n}. "), option) for n, option in enumerate(options, start=1)]
    return F.concat(F.concat_ws("\n", *lines), F.lit(f"\n\n{INSTRUCTION}\n\n"))


def lettered_prompt(question: Column, options: list[Column]) -> Column:
    """Question, options ``A)`` to ``D)``, then ``Answer:``."""
    lines = [question]
    lines += [F.concat(F.lit(f"{letter}) "), option) for letter, option in zip(ANSWER_LETTERS, options)]
    return F.concat_ws("\n", *lines, F.lit("Answer:"))


def join_segments(segments: Column, order: str = "idx", text: str = "text") -> Column:
    """Texts of an array of segment structs, in order, with no separator, stripped."""
    ordered = F.array_sort(F.transform(segments, lambda s: F.struct(s[order].alias("k"), s[text].alias("t"))))
    return strip(F.array_join(F.transform(ordered, lambda s: s["t"]), ""))


def join_nested_segments(groups: Column, inner: str = "elements", text: str = "value") -> Column:
    """Texts of segments nested in groups (speakers, say), in stored order, with no separator."""
    return F.array_join(F.flatten(F.transform(groups, lambda g: F.transform(g[inner], lambda e: e[text]))), "")


def common_substring(left: str, right: str) -> str:
    """Longest common substring; of several, the one that ends first in ``left``."""

    def shared_start(size: int) -> int:
        pieces = {right[i : i + size] for i in range(len(right) - size + 1)}
        return next((i for i in range(len(left) - size + 1) if left[i : i + size] in pieces), -1)

    low, high, at = 0, min(len(left), len(right)), 0
    while low < high:
        middle = (low + high + 1) // 2
        found = shared_start(middle)
        if found >= 0:
            low, at = middle, found
        else:
            high = middle - 1
    return left[at : at + low]


def overlap_length(left: str, right: str) -> int:
    """Length of the longest suffix of ``left`` that is a prefix of ``right``."""
    return next((n for n in range(min(len(left), len(right)), 0, -1) if left.endswith(right[:n])), 0)


@F.arrow_udf(StringType())
def longest_common_substring(left: pa.Array, right: pa.Array) -> pa.Array:
    """Column form of ``common_substring``."""
    return pa.array(
        [
            None if a is None or b is None else common_substring(a, b)
            for a, b in zip(left.to_pylist(), right.to_pylist())
        ],
        pa.string(),
    )


@F.arrow_udf(IntegerType())
def overlap_chars(left: pa.Array, right: pa.Array) -> pa.Array:
    """Column form of ``overlap_length``; 0 without a left neighbour."""
    return pa.array(
        [0 if a is None or b is None else overlap_length(a, b) for a, b in zip(left.to_pylist(), right.to_pylist())],
        pa.int32(),
    )


class GrowingText:
    """A text that grows at its end and knows its substrings.

    A suffix automaton (Blumer et al. 1985), extended letter by letter: finding the longest
    substring shared with a chunk costs the chunk's length, however long the text has become.
    States are rows of four integer arrays: the first letter that leads on and where to, the suffix link and
    the length, 16 bytes a state and at most two states a letter.  Only the states that branch, fewer than the
    letters, have a dict beside them.
    """

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.letter, self.target = array("i", [-1]), array("i", [-1])
        self.link, self.size, self.end = array("i", [-1]), array("i", [0]), 0
        self.more: dict[int, dict[int, int]] = {}

    def append(self, text: str) -> None:
        self.parts.append(text)
        letter, target, more, link, size = self.letter, self.target, self.more, self.link, self.size
        codes = list(map(ord, text))
        # The states of the letters are made at once; copies of states come behind them.
        first_new, end = len(size), self.end
        letter.extend([-1] * len(codes))
        target.extend([-1] * len(codes))
        link.extend([0] * len(codes))
        size.extend(range(size[end] + 1, size[end] + 1 + len(codes)))
        for new, code in enumerate(codes, first_new):
            at, to = end, -1
            end = new
            while at >= 0:
                first = letter[at]
                if first == code:
                    to = target[at]
                    break
                if first < 0:
                    letter[at], target[at] = code, new
                else:
                    branch = more.get(at)
                    if branch is None:
                        more[at] = {code: new}
                    elif code in branch:
                        to = branch[code]
                        break
                    else:
                        branch[code] = new
                at = link[at]
            if at < 0:
                continue
            longer = size[at] + 1
            if size[to] == longer:
                link[new] = to
                continue
            copy = len(size)
            letter.append(letter[to])
            target.append(target[to])
            link.append(link[to])
            size.append(longer)
            if to in more:
                more[copy] = dict(more[to])
            while at >= 0:
                if letter[at] == code:
                    if target[at] != to:
                        break
                    target[at] = copy
                else:
                    branch = more.get(at)
                    if branch is None or branch.get(code) != to:
                        break
                    branch[code] = copy
                at = link[at]
            link[to] = link[new] = copy
        self.end = end

    def shared_length(self, text: str) -> int:
        """Length of the longest substring of ``text`` that occurs here."""
        letter, target, more, link, size = self.letter, self.target, self.more, self.link, self.size
        at = length = longest = 0
        for code in map(ord, text):
            while True:
                if letter[at] == code:
                    at, length = target[at], length + 1
                    break
                branch = more.get(at)
                if branch is not None and code in branch:
                    at, length = branch[code], length + 1
                    break
                if not at:
                    break
                at = link[at]
                length = size[at]
            if length > longest:
                longest = length
        return longest

    def __str__(self) -> str:
        return "".join(self.parts)


class SampledText:
    """A text that grows at its end and finds the long substrings that it shares with a chunk.

    Every ``gram``-th run of ``gram`` letters is kept in a dict with its places.  A shared substring of
    ``2 * gram - 1`` letters or more holds one of them whole, so each place that a run of the chunk is found at,
    grown to both sides, gives them all.
    """

    # A chunk may be compared at this many places: beyond, the automaton of ``GrowingText`` is cheaper.
    PLACES = 128

    def __init__(self, gram: int, letters: bytearray) -> None:
        self.gram, self.letters, self.done = gram, letters, 0
        self.places: dict[str, list[int]] = {}

    def _take_in(self) -> None:
        gram, places = self.gram, self.places
        new = _decoded(self.letters[4 * self.done :])
        for at in range(0, len(new) - gram + 1, gram):
            places.setdefault(new[at : at + gram], []).append(self.done + at)
        self.done += len(new) // gram * gram

    def shared_length(self, text: str) -> int | None:
        """Length of the longest substring of ``text`` that occurs here; null if it is below ``2 * gram - 1`` or there are too many places."""
        self._take_in()
        gram, places, letters = self.gram, self.places, self.letters
        held, size, coded = len(letters) // 4, len(text), _encoded(text)
        longest = compared = 0
        seen: dict[int, int] = {}
        for at in range(size - gram + 1):
            for place in places.get(text[at : at + gram], ()):
                shift = place - at
                if seen.get(shift, 0) > at:
                    continue
                if compared == self.PLACES:
                    return None
                compared += 1
                low, high = max(0, -shift), min(size, held - shift)
                here = int.from_bytes(letters[4 * (low + shift) : 4 * (high + shift)], "little")
                differ = here ^ int.from_bytes(coded[4 * low : 4 * high], "little")
                after = differ >> 32 * (at - low)
                end = at + ((after & -after).bit_length() - 1) // 32 if after else high
                start = low + ((differ & ((1 << 32 * (at - low)) - 1)).bit_length() + 31) // 32
                seen[shift] = end
                longest = max(longest, end - start)
            if longest == size:
                break
        return longest if longest >= 2 * gram - 1 else None


def _encoded(text: str) -> bytes:
    return text.encode("utf-32-le", "surrogatepass")


def _decoded(letters: bytes | bytearray) -> str:
    return letters.decode("utf-32-le", "surrogatepass")


class Fold:
    """Folds chunk texts in order.

    Each loses as many leading characters as its longest common substring with the text so far is
    long, wherever that substring lies.  Long matches, as of chunks that overlap, are found by runs of letters;
    the first chunk that shares less, or matches in very many places, has the automaton take over.
    """

    GRAMS = (24, 8)
    # Letters of the text times letters of the chunk that are searched without any table.
    SMALL = 65_536

    def __init__(self) -> None:
        self.letters, self.waiting = bytearray(), ""
        self.levels: list[SampledText] = []
        self.merged: GrowingText | None = None

    def add(self, text: str) -> None:
        # A chunk is taken in when the next one comes: nothing is matched against the last.
        if self.waiting:
            if self.merged is None:
                self.letters += _encoded(self.waiting)
            else:
                self.merged.append(self.waiting)
        self.waiting = text[self._shared_length(text) :]

    def _shared_length(self, text: str) -> int:
        if self.merged is None:
            if not text or not self.letters:
                return 0
            if self.letters.endswith(_encoded(text)):
                return len(text)
            for number, gram in enumerate(self.GRAMS):
                if len(text) >= 2 * gram - 1:
                    if number >= len(self.levels):
                        self.levels += [SampledText(g, self.letters) for g in self.GRAMS[len(self.levels) : number + 1]]
                    found = self.levels[number].shared_length(text)
                    if found is not None:
                        return found
            so_far = _decoded(self.letters)
            if len(so_far) * len(text) <= self.SMALL and len(text) < 2 * self.GRAMS[-1]:
                return len(common_substring(so_far, text))
            self.merged, self.levels, self.letters = GrowingText(), [], bytearray()
            self.merged.append(so_far)
        return self.merged.shared_length(text)

    def __str__(self) -> str:
        return (_decoded(self.letters) if self.merged is None else str(self.merged)) + self.waiting


def merge_by_common_substring(texts: list[str]) -> str:
    fold = Fold()
    for text in texts:
        fold.add(text)
    return str(fold)
