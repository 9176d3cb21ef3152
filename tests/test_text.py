import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from uttermark.functions import english
from uttermark.functions import text as tx
from uttermark.operators.normalize import expand_words, normalize_by_language, normalize_corpus, profile_of_language


def test_multilingual(norm):
    texts = ["Hello, <noise> WORLD! (laughs) [x> y", "Crème  brûlée – œuf, Straße", "naïve\tño\nŁódź", "a_b", "½ kg", None, "", "a​b ​ c"]
    got = norm(texts, profile="multilingual")
    assert got == ["hello world y", "creme brulee oeuf strasse", "naive no lodz", "a b", "1 2 kg", None, "", "ab c"]


def test_basic_keeps_diacritics_and_edges(norm):
    assert norm([" Crème, (x) brûlée! "], profile="basic") == [" crème brûlée "]
    assert norm(["Crème!"], profile="basic", remove_diacritics=True) == ["creme "]
    assert norm(["ab c"], profile="basic", split_letters=True) == ["a b c"]


def test_engines_agree(norm):
    alphabet = "aZß œŁéñ½ﬁ한글हिन्दी’“”…ⅣǅÅ ́‍¿.<>()[]_0١"
    draw = random.Random(5)
    texts = ["".join(draw.choice(alphabet) for _ in range(30)) for _ in range(200)]
    for profile in ("basic", "multilingual", "english"):
        assert norm(texts, profile=profile, engine="jvm") == norm(texts, profile=profile, engine="arrow")


def _plain_python(text):
    """The multilingual profile as one would write it for a single string."""
    import re

    text = re.sub(r"[<\[][^>\]]*[>\]]", "", text.lower())
    text = re.sub(r"\(([^)]+?)\)", "", text)
    out = []
    for c in unicodedata.normalize("NFKD", text):
        category = unicodedata.category(c)
        out.append(tx.SPECIAL_LETTERS.get(c) or ("" if category == "Mn" else " " if category[0] in "MSP" else c))
    return " ".join(re.sub(r"[^\w\s]", "", "".join(out).lower()).split())


def test_multilingual_against_brute_force(norm):
    alphabet = "abcXYZ éüßœŁñ½ﬁ한글हि’“…ⅣÅ ́‍¿.,<>()[]_-0١\n\t\x07"
    draw = random.Random(7)
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40))) for _ in range(400)]
    assert norm(texts, profile="multilingual") == [_plain_python(t) for t in texts]


def test_nothing_but_words_left(norm):
    got = norm(["".join(map(chr, range(1, 0x2FF)))], profile="multilingual")[0]
    assert all(c == " " or unicodedata.category(c)[0] in "LN" for c in got)


ENGLISH = [
    ("Let's", "let us"),
    ("he's like", "he is like"),
    ("she's been like", "she has been like"),
    ("10km", "10 km"),
    ("RC232", "rc 232"),
    ("Mr. Park visited Assoc. Prof. Kim Jr.", "mister park visited associate professor kim junior"),
    ("I won't, y'all can't ain't", "i will not you all can not aint"),
    ("they'd gone; he'd go; I'd been", "they had gone he would go i had been"),
    ("don't 've we've I'm 'twas", "do not have we have i am twas"),
    ("um, the hmm uh thing 's", "the thing is"),
    ("1,234.50 dollars", "$1234.50"),
    ("the colour of grey theatres", "the color of gray theaters"),
    ("we organise, analysed and travelled", "we organize analyzed and traveled"),
    ("It costs $5. Or 20%!", "it costs $5 or 20%"),
    ("$ and % alone", " and alone"),
    ("don’t", "don t"),
    ("he'dn't", "he would not"),
    ("first and second", "1st and 2nd"),
    ("one two three", "123"),
    ("[noise] (cough) well", "well"),
]


@pytest.mark.parametrize("i", range(len(ENGLISH)))
def test_english(norm, i):
    got = norm([ENGLISH[i][0]], profile="english")[0]
    assert got.strip() == ENGLISH[i][1].strip()


def test_english_options(norm):
    assert norm(["don’t"], profile="english", fold_apostrophes=True) == ["do not"]
    assert norm(["my lorry"], profile="english", spelling={"lorry": "truck"}) == ["my truck"]


def test_second_pass(norm):
    assert norm(["1 1"], profile="english") == ["one one"]
    assert norm(["1 1"], profile="english", passes=2) == ["11"]


def test_rule_tables_have_their_size():
    assert len(english.CONTRACTIONS) + len(english.TITLES) + len(english.ENDINGS) == 49


def test_one_pass_rewrites_equal_rule_by_rule(spark):
    """All rules of a table at once against one rule after the other."""
    import re

    from uttermark.operators.normalize import expand_words

    pieces = ["won't", "can't", "y'all", "i'ma", "ma'am", "'d", " been", " gone", "'s", " got", "n't", "'ve", "mr", "mrs", "st", " ", ".", "x", "'", "imma", "é"]
    draw = random.Random(3)
    texts = ["".join(draw.choice(pieces) for _ in range(8)) for _ in range(500)]

    def one_by_one(t):
        t = re.sub(r"\b(hmm|mm|mhm|mmm|uh|um)\b", "", t)
        t = re.sub(r"\s+'", "'", t)
        for word, put in english.CONTRACTIONS + english.TITLES:
            t = re.sub(rf"\b{word}\b", put, t)
        for ending, put in english.ENDINGS:
            t = re.sub(rf"{ending}\b", put, t)
        return t

    df = spark.createDataFrame(list(enumerate(texts)), "i int, __text string")
    got = [r["__text"] for r in expand_words(df).orderBy("i").collect()]
    wrong = [(t, g, one_by_one(t)) for t, g in zip(texts, got) if g != one_by_one(t)]
    assert not wrong, wrong[:5]


def test_by_language(rows):
    df = rows([(1, "en", "twenty one"), (2, "de", "twenty one"), (3, None, "Twenty One")], "i int, lang string, t string")
    got = {r.i: r.norm_text for r in normalize_by_language(df, "t", "lang").collect()}
    assert got == {1: "21", 2: "twenty one", 3: "twenty one"}


def test_profiles():
    assert profile_of_language("en") == "english" and profile_of_language("pt") == "multilingual"
    with pytest.raises(NotImplementedError):
        profile_of_language("zh")


def test_unknown_profile(rows):
    with pytest.raises(NotImplementedError):
        normalize_corpus(rows([("a",)], "t string"), "t", "chinese")


def test_predicates(rows):
    df = rows(
        [(1, "aaa"), (2, "aab"), (3, "漢字"), (4, " \t"), (5, " ignore time segment in scoring "), (6, "a\n\n\nb"), (7, "漢漢漢")],
        "i int, t string",
    )
    ids = lambda cond: {r.i for r in df.where(cond).collect()}
    t = F.col("t")
    assert ids(tx.has_no_runs(t)) == {2, 3, 4, 5, 6}
    assert ids(tx.has_cjk(t)) == {3, 7}
    assert ids(tx.is_scorable(t)) == {1, 2, 3, 6, 7}
    blank = df.select(tx.blank_to_space(t).alias("b")).collect()
    assert [r.b for r in blank][3:5] == [" ", "ignore time segment in scoring"]


def test_special_tokens_and_dictionary(rows):
    df = rows([("  <|en|>hello<|end|> there <|x",)], "t string")
    assert df.select(tx.drop_special_tokens(F.col("t"))).first()[0] == "hello there <|x"
    big = {f"w{i}": f"v{i}" for i in range(100)}
    df = rows([("w1  other w99",)], "t string")
    assert df.select(english.rewrite_words(F.col("t"), big)).first()[0] == "v1 other v99"
    assert df.select(english.rewrite_words(F.col("t"), {"w1": "x"})).first()[0] == "x other w99"


@pytest.mark.parametrize("profile", ["basic", "multilingual", "english", "by_language"])
def test_later_filters_reach_the_scan(spark, tmp_path, profile):
    """Of conditions set after normalisation, those on other columns prune the scan; those on the result stay above it."""
    path = str(tmp_path / "texts")
    table = spark.createDataFrame([(1, "Café Two", "en"), (2, "Äpfel Drei", "de"), (3, None, "en")], "i int, t string, lang string")
    table.write.partitionBy("lang").parquet(path)
    df = spark.read.parquet(path)
    done = normalize_by_language(df, "t", "lang") if profile == "by_language" else normalize_corpus(df, "t", profile)
    some = done.where("lang = 'en' and i < 3 and length(norm_text) > 0")
    plan = some._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "(lang#" in scan.split("PartitionFilters:")[1].split("]")[0] and "LessThan(i,3)" in scan
    assert sum("Filter" in line and "length(" in line and "Scan" not in line for line in plan.splitlines()) == 1
    assert [r.i for r in some.collect()] == [1] and done.count() == 3


def test_result_replaces_a_column_in_its_place(rows):
    df = rows([("A b", 1)], "T string, k int")
    done = normalize_corpus(df, "T", "multilingual", out="t")
    assert [c.lower() for c in done.columns] == ["t", "k"] and tuple(done.first()) == ("a b", 1)


def _table_by_table(df):
    """The expansions as they are defined: the rules of each table at once, one table after another."""
    start, end = tx.WORD_START, tx.WORD_END
    t = F.regexp_replace("t", rf"{start}(?:{'|'.join(english.FILLERS)}){end}", "")
    t = F.regexp_replace(t, rf"[{tx.SPACE}]+'", "'")
    for rules, before in ((english.CONTRACTIONS, start), (english.TITLES, start), (english.ENDINGS[:7], ""), (english.ENDINGS[7:], "")):
        t = F.regexp_replace(t, f"{before}({'|'.join(word for word, _ in rules)}){end}", "<$1>")
        for word, new in rules:
            t = F.replace(t, F.lit(f"<{word}>"), F.lit(new))
    return df.select("i", t.alias("t"))


def test_expansions_in_two_passes_are_those_table_by_table(spark):
    rules = [*english.CONTRACTIONS, *english.TITLES, *english.ENDINGS]
    parts = [*[w for w, _ in rules], *[w for w, _ in rules], *english.FILLERS, " ", " ", " ", "'", "a", "e", "n", "é", "_", "7", "-", "\n", "𝐚", "™", "x'd", "been", ""]
    rng = random.Random(5)
    texts = ["", "he'dn't've", "gen't", "can't mr's been st'd", "y'all's got", "'s been'd", *("".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(4000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    expanded = expand_words(df.withColumnRenamed("t", "__text"))
    got, want = ({r.i: r[1] for r in x.collect()} for x in (expanded.select("i", "__text"), _table_by_table(df)))
    assert [(texts[i], got[i]) for i in got if got[i] != want[i]] == [(texts[i], want[i]) for i in got if got[i] != want[i]]
    # Fences in the text itself stay; null stays null.
    own = spark.createDataFrame([(0, " mr x won't "), (1, None)], "i int, __text string")
    assert [r[1] for r in expand_words(own).orderBy("i").collect()] == [" mister  x will not ", None]


def test_expansions_search_a_text_a_few_times(spark):
    """Forty-nine rules, but no search of the whole text for each of them."""
    df = expand_words(spark.createDataFrame([("a",)], "__text string"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") <= 4 and plan.replace("regexp_replace(", "").count("replace(") == 0


def test_decomposition_by_runs_is_that_of_the_text(spark):
    rng = random.Random(6)
    chars = "abz .-'" + "".join(tx.SPECIAL_LETTERS) + "éüñçǽﬁ½™№℃Å각가ᄀ़̣́̈ͅẛ̈́Å日本𝐚\U0001d15e "
    texts = ["", *("".join(rng.choices(chars, k=rng.randint(1, 40))) for _ in range(3000)), "é" * 100, "̣" * 30 + "́" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = df.select("i", tx.plain_letters(F.col("t"), "arrow").alias("a"), tx.plain_letters(F.col("t"), "jvm").alias("j")).collect()
    assert [(texts[r.i], r.a) for r in got if r.a != r.j] == [(texts[r.i], r.j) for r in got if r.a != r.j]
