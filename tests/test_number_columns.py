"""The number fold as column expressions against the token machine."""

import random

from pyspark.sql import functions as F

from tests.test_numbers import CASES
from uttermark.functions import number_columns, numbers
from uttermark.functions.english import spelling_table
from uttermark.operators.normalize import normalize_corpus
from uttermark.plans.catalogue import PHRASES

ODD = [
    "", "   ", None, "half", "and a half", "half and a half", "one and a half and a half", "two  and a half million half", "foo-and a half",
    "minus", "minus minus five", "minus $5 dollars", "point", "point five", "point five million", "five point point five", "2. 5",
    "two point -5 million", "3 point 2 point 1 thousand", "007 thousand", "00.50 hundred", "1.0 cents", "٣ thousand ٣٫ ٣.٥ million",
    "9" * 60 + " thousand one", "9" * 60 + " hundred", "1" + "9" * 45 + "1 million", "999" * 20 + " billion percent",
    "zero zero five and", "zeroth hundred", "0 million", "0 five", "double", "double zeroth triple nine", "percent per cent 5 per",
    "5 per cents", "hundred and", "hundred and foo", "hundred and point", "twenty fifths", "$0.05 $0.5 $0.50 $0.123", "$2 and ¢7 €3 ¢45 £1 ¢123",
    "a\x1cone\x85two three", "x2y 3rd 3 rd 10 st", "¢1s 1s 1", "five dollars cents", "-five +2 --2 €€2", "one. two, 1,5",
]


def same(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(8)
    got = {r.i: r.folded for r in rows.select("i", number_columns.fold_numbers(F.col("t")).alias("folded")).collect()}
    wrong = [(t, got[i], numbers.folded(t)) for i, t in enumerate(texts) if (None if t is None else numbers.folded(t)) != got[i]]
    assert not wrong, (len(wrong), wrong[:5])


def test_worked_cases(spark):
    same(spark, [spoken for spoken, _ in CASES] + ODD)
    got = spark.createDataFrame(CASES, "t string, want string").select("want", number_columns.fold_numbers(F.col("t")).alias("got"))
    assert got.where("want <> got").count() == 0


def test_phrases_and_random_words(spark):
    rng = random.Random(4)
    words = sorted(numbers.LEXICON)
    few = ["one", "twenty", "hundred", "thousand", "million", "and", "point", "oh", "double", "minus", "dollars", "cents", "per", "cent", "percent", "a", "half"]
    other = ["5", "12", "100", "3.5", "2.0", "$7", "-3", "€0.05", "¢9", "foo", "x", "1s", "th", "st", "200", "000", "1.2.3"]
    texts = [p.format(a=a, b=b, t=t) for p in PHRASES for a in ("one", "six") for b in ("two", "nine") for t in ("ten", "fifty")]
    texts += [" ".join(rng.choice(rng.choice([words, few, few, other])) for _ in range(rng.randint(1, 12))) for _ in range(6000)]
    same(spark, texts)


def test_long_text(spark):
    same(spark, ["five hundred and two foo " * 20_000 + "nine"])


def test_plan_has_no_python(spark):
    rows = spark.createDataFrame([("Twenty one colours, café and two and a half dollars",), ("no number",), (None,)], "t string")
    plans, results = [], []
    for engine in ("jvm", "arrow"):
        made = normalize_corpus(rows, "t", "english", engine=engine)
        plans.append(made._jdf.queryExecution().executedPlan().toString())
        results.append([r.norm_text for r in made.collect()])
    assert "Python" not in plans[0] and "Arrow" not in plans[0]
    assert results[0] == results[1]
    assert "colour" in "".join(spelling_table())
