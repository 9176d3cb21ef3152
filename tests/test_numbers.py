import random

import pytest

from uttermark.functions import numbers
from uttermark.functions.numbers import LEXICON, fold_numbers_in, fold_tokens, folded, spell_halves

CASES = [
    ("two", "2"),
    ("one", "one"),
    ("ones", "ones"),
    ("thirty one", "31"),
    ("five twenty four", "524"),
    ("nineteen ninety nine", "1999"),
    ("twenty nineteen", "2019"),
    ("two point five million", "2500000"),
    ("four point two billions", "4200000000s"),
    ("200 thousand", "200000"),
    ("200 thousand dollars", "$200000"),
    ("$20 million", "$20000000"),
    ("€52.4 million", "€52400000"),
    ("£77 thousands", "£77000s"),
    ("two double o eight", "2008"),
    ("three thousand twenty nine", "3029"),
    ("forty three thousand two hundred sixty", "43260"),
    ("forty three thousand two hundred and sixty", "43260"),
    ("nineteen fifties", "1950s"),
    ("thirty first", "31st"),
    ("thirty three thousand and three hundred and thirty third", "33333rd"),
    ("three billion", "3000000000"),
    ("millions", "1000000s"),
    ("july third twenty twenty", "july 3rd 2020"),
    ("august twenty sixth twenty twenty one", "august 26th 2021"),
    ("3 14", "3 14"),
    ("3.14", "3.14"),
    ("3 point 2", "3.2"),
    ("fourteen point 4", "14.4"),
    ("two point two five dollars", "$2.25"),
    ("ninety percent", "90%"),
    ("seventy six per cent", "76%"),
    ("five per person", "5 per person"),
    ("double oh seven", "007"),
    ("nine one one", "911"),
    ("nine double one", "911"),
    ("one triple oh one", "10001"),
    ("double trouble", "double trouble"),
    ("two thousandth", "2000th"),
    ("thirty two thousandth", "32000th"),
    ("minus 500", "-500"),
    ("positive twenty thousand", "+20000"),
    ("minus dogs", "minus dogs"),
    ("minus five dollars", "$5"),
    ("two dollars and seventy cents", "$2.70"),
    ("3 cents", "¢3"),
    ("$0.36", "¢36"),
    ("three euros and sixty five cents", "€3.65"),
    ("three and a half million", "3500000"),
    ("forty eight and a half dollars", "$48.5"),
    ("day and a half off", "day and a half off"),
    ("and a half hour", "hour"),
    ("b747", "b 747"),
    ("10 th", "10th"),
    ("one hundred and one", "101"),
    ("bread and butter", "bread and butter"),
    ("point taken", "point taken"),
    ("sixes and sevens", "6s and 7s"),
    ("ten five", "105"),
    ("one twenty", "120"),
    ("hundred", "100"),
    ("two hundred three hundred", "20300"),
    ("1.2.3", "one.2.3"),
    ("eleven hundred", "1100"),
    ("twelfth", "12th"),
    ("zeroth", "0th"),
    ("twentieths", "twentieths"),
    ("decillion", "1" + "0" * 33),
]


@pytest.mark.parametrize("spoken,written", CASES)
def test_case(spoken, written):
    assert fold_numbers_in(spoken) == written
    assert folded(spoken) == written


def test_not_idempotent():
    assert fold_numbers_in("1 1") == "one one"
    assert fold_numbers_in("one one") == "11"


def test_and_survives_alone():
    assert fold_tokens(["salt", "and", "and", "pepper"]) == ["salt", "and", "and", "pepper"]


def test_halves():
    assert spell_halves("two and a half") == "two  point five"
    assert spell_halves("an hour and a half later") == "an hour  and a half  later"


def test_every_rule_word_is_known():
    for word in ("eighth", "ninetieth", "thirties", "hundreds", "millionth", "sixes", "fourteenth", "twelves"):
        assert word in LEXICON


class _WordByWord(numbers._Folder):
    """The fold as it is defined, a step for every word; counts the steps."""

    def run(self):
        while self.at < len(self.tokens):
            token = self.tokens[self.at]
            role, amount, suffix = LEXICON.get(token, ("other", None, ""))
            self.at += getattr(self, f"on_{role}")(token, amount, suffix)
        self.flush()
        return self.written


def test_other_words_are_written_in_runs(monkeypatch):
    rng = random.Random(9)
    words = [*LEXICON, *LEXICON, "3", "2.5", "$7", "-1", "x²", "7th", "1.2.3", *["word", "a", "-", "cent", "half"] * 20]
    for _ in range(4000):
        tokens = rng.choices(words, k=rng.randint(0, 12))
        assert fold_tokens(tokens) == _WordByWord(tokens).run(), tokens
    steps = []
    real = numbers._Folder.on_other
    monkeypatch.setattr(numbers._Folder, "on_other", lambda self, *a: steps.append(1) or real(self, *a))
    assert fold_tokens(["word"] * 500 + ["two", "dollars"] + ["word"] * 500) == ["word"] * 500 + ["$2"] + ["word"] * 500
    assert len(steps) == 0


@pytest.mark.parametrize("text", ["a1 b2c 3d", "1 21 1s x1 1x _1 1_ ²1 1² -1- 1s1", "é1 1é 11 1", "z9z9z9", "1", "$1 €1s ¢1"])
def test_rewrites_around_the_fold(text):
    import re

    spaced = re.sub("([a-z])([0-9])", r"\1 \2", text)
    assert numbers._LETTER_DIGIT.sub(r" \1", text) == spaced
    assert numbers._LONE_ONE.sub(r"one\1", text) == re.sub(r"\b1(s?)\b", r"one\1", text)
