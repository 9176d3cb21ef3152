import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from uttermark.functions import answers
from uttermark.operators import align, batching, chunks, indexing, metrics, nested, prepare
from uttermark.operators.normalize import rewrite_by_table
from uttermark.operators.spreading import spread
from uttermark.operators.staging import shared_folder, staged
from uttermark.sources import utterances

# --- numbering ---------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["int", "string", "double", "pair"])
def test_ranges_number_like_one_window(spark, kind):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(99).alias("g"),
        (F.col("id") * 7919 % 20_011).alias("k"),
        "id",
    )
    order = {
        "int": [F.col("k")],
        "string": [F.concat(F.lit("utt-"), F.col("k").cast("string"))],
        "double": [-F.sqrt(F.col("k"))],
        "pair": [F.col("k") % 3, F.col("id")],
    }[kind]
    split = indexing.dense_index(df, ["g"], order, "at", buckets=16)
    plain = df.withColumn("at", (F.row_number().over(Window.partitionBy("g").orderBy(*order)) - 1).cast("long"))
    assert split.exceptAll(plain).count() == 0 and plain.exceptAll(split).count() == 0


def test_ranges_are_even_for_a_hot_group(spark):
    df = spark.range(50_000).select(F.lit("hot").alias("g"), (F.col("id") % 5).alias("tied"), "id")
    key = F.struct(F.col("tied").alias("o0"), F.col("id").alias("o1"))
    cuts, heavy = indexing._cut_points(df, key, 20)
    assert heavy == []
    assert 15 <= len(cuts) <= 19
    array = F.array(*[F.struct(*[F.lit(v).cast("long").alias(f"o{i}") for i, v in enumerate(c)]) for c in cuts])
    sizes = df.select(indexing._bucket(key, array, len(cuts)).alias("b")).groupBy("b").count()
    assert sizes.agg(F.max("count")).first()[0] < 50_000 / 20 * 2.5


def test_numbering_without_group(spark):
    df = spark.range(5000)
    got = indexing.dense_index(df, [], [-F.col("id")], "at", buckets=8)
    assert got.where("at <> 4999 - id").count() == 0


def test_first_rows(spark):
    df = spark.range(100)
    assert indexing.first_rows(df, None, []).count() == 100
    assert indexing.first_rows(df, -1, []).count() == 100
    assert sorted(r.id for r in indexing.first_rows(df, 3, [-F.col("id")]).collect()) == [97, 98, 99]


@pytest.mark.parametrize("top", [5, 100_000])
def test_limits_are_exact_under_ties(spark, monkeypatch, top):
    """Few order keys, nulls, and a third of the rows equal in all columns; whatever is left to the top-k operator."""
    monkeypatch.setattr(indexing, "TOP_ROWS", top)
    monkeypatch.setattr(indexing, "_SELECT_BUCKETS", 4)
    df = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, F.col("id") % 2).alias("k"),
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("t"),
    )
    keys = sorted((-1 if r.k is None else r.k) for r in df.collect())
    for n in (1, 7, 299, 300, 301, 450, 700, 899, 900, 901, 5000):
        got = indexing.first_rows(df, n, [F.col("k")]).collect()
        assert sorted((-1 if r.k is None else r.k) for r in got) == keys[:n], n
        assert len({r.t for r in got if r.t != "same"}) == sum(r.t != "same" for r in got)
    assert indexing.first_rows(df.limit(0), 3, [F.col("k")]).count() == 0
    assert indexing.first_rows(df, 5, [F.col("k"), F.length("t")]).count() == 5


def test_equal_rows_are_numbered_from_their_count(spark):
    """Half of the rows are equal in all columns: no task gathers them, and the numbers have no gap."""
    df = spark.range(4_000).select(
        F.lit("g").alias("g"), F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") % 10).alias("k"), F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("i")
    )
    numbered = indexing.dense_index(df, ["g"], [F.col("k")], "at", buckets=8)
    assert "__block" in numbered._jdf.queryExecution().optimizedPlan().toString()
    got = numbered.collect()
    assert sorted(r.at for r in got) == list(range(4_000)) and sorted(r.i for r in got) == sorted(r.i for r in df.collect())
    order = [r.k for r in sorted(got, key=lambda r: r.at)]
    assert order == sorted(order)


# --- alignment ---------------------------------------------------------------------------------


def test_align(rows):
    refs = rows([(1, "a"), (2, "b"), (2, "b2")], "k int, text string")
    hyps = rows([(2, "x"), (3, "y")], "k int, pred_text string")
    assert align.align(refs, hyps, ["k"]).count() == 2
    assert [r.k for r in align.without_hypothesis(refs, hyps, ["k"]).collect()] == [1]
    assert [r.k for r in align.without_reference(refs, hyps, ["k"]).collect()] == [3]
    assert [(r.k, r.n) for r in align.duplicate_keys(refs, ["k"]).collect()] == [(2, 2)]


def test_matrix(rows):
    models = rows([("o/m",), ("o/n",)], "model string")
    plan = align.evaluation_matrix(models, align.matrix_entries(align.SHORT_FORM))
    assert plan.count() == 16
    assert plan.where("dataset = 'librispeech' and split = 'test.clean'").count() == 2
    languages = align.evaluation_matrix(models, align.multilingual_entries(align.MULTILINGUAL))
    assert languages.count() == 26 and languages.where("dataset = 'mls_pt'").count() == 2
    done = rows([("o/m", "ami", "test")] * 3, "model string, dataset string, split string")
    keys = ["model", "dataset", "split"]
    assert align.missing_runs(plan, done, keys).count() == 15
    assert align.present_runs(plan, done, keys).count() == 1
    assert "CartesianProduct" not in plan._jdf.queryExecution().toString()


def test_language_code(rows):
    df = rows([("el",), ("xx",), (None,)], "l string")
    assert [r[0] for r in df.select(align.language_code(F.col("l"))).collect()] == ["ell_Grek", "eng_Latn", "eng_Latn"]


# --- preparation -------------------------------------------------------------------------------


def test_column_resolution(rows):
    assert utterances.text_column(rows([(1, 2)], "transcription int, sentence int")) == "sentence"
    assert utterances.text_column(rows([(1, 2)], "meta_info int, Digit int"), utterances.EXTENDED_TEXT_COLUMNS) == "Digit"
    with pytest.raises(ValueError):
        utterances.text_column(rows([(1,)], "question int"))
    assert utterances.audio_column("x/ASMR-set") == "flac" and utterances.audio_column("x/y") == "audio"
    assert utterances.with_audio_column(rows([(1,)], "wav int")).columns == ["audio"]
    assert utterances.with_audio_column(rows([(1,)], "mp3 int"), "adi-gov-tw/x").columns == ["audio"]


def test_limit_stage(rows):
    df = rows([(i, "" if i < 3 else f"word {i}") for i in range(10)], "id int, text string")
    ids = lambda d: [r.id for r in d.orderBy("id").collect()]
    options = dict(limit=5, order=[F.col("id")], profile="multilingual")
    assert ids(prepare.prepare(df, limit_stage="before", **options)) == [3, 4]
    assert ids(prepare.prepare(df, limit_stage="after", **options)) == [3, 4, 5, 6, 7]
    with pytest.raises(ValueError):
        prepare.prepare(df, limit=5)


def test_chinese_filter(rows):
    df = rows([(1, "漢字"), (2, "word"), (3, "哈哈哈")], "id int, text string")
    assert [r.id for r in prepare.prepare(df, chinese=True, profile="multilingual").collect()] == [1]


def test_scalar_columns(rows):
    df = rows([("fleurs_pt_br", "fb/omni-ASR-7B"), ("ami", "x")], "c string, m string")
    got = df.select(
        prepare.language_of_config(F.col("c")).alias("l"),
        prepare.model_card(F.col("m")).alias("card"),
        prepare.path_safe(F.col("m")).alias("safe"),
    ).collect()
    assert [tuple(r) for r in got] == [("pt_br", "omni_ASR_7B", "fb-omni-ASR-7B"), ("en", "x", "x")]
    numbers = rows([(1.0,), (2.0,), (3.0,)], "x double")
    assert numbers.where(prepare.within(F.col("x"), 1, 3)).count() == 1


def test_truncation_keeps_reported_length(rows):
    df = rows([(([0.0] * 100, 2),), (([0.0] * 70, 2),)], "audio struct<array: array<float>, sampling_rate: int>")
    got = df.select(
        prepare.seconds().alias("s"), F.size(prepare.truncated(F.col("audio.array"), F.col("audio.sampling_rate"))).alias("n")
    ).collect()
    assert [tuple(r) for r in got] == [(50.0, 80), (35.0, 70)]


def test_page_plan(spark, rows):
    assert [tuple(r) for r in utterances.page_plan(spark, 250).collect()] == [(0, 100), (100, 100), (200, 50)]
    plans = utterances.page_plans(rows([("a", 101), ("b", 0)], "s string, total_rows long"))
    assert [(r.s, r.offset, r.length) for r in plans.collect()] == [("a", 0, 100), ("a", 100, 1)]


def test_partition_pruning(spark):
    path = shared_folder(spark) + "/pruning"
    spark.range(10).selectExpr("id", "if(id % 2 = 0, 'a', 'b') config", "'test' split").write.mode("overwrite").partitionBy(
        "config", "split"
    ).parquet(path)
    df = utterances.load_split(spark, path, "a", "test")
    assert df.count() == 5 and len(df.select("id").inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(config" in df._jdf.queryExecution().toString()


# --- nested records ----------------------------------------------------------------------------

SENTENCE = (
    "array<struct<id: int, transcription: string, audio: array<struct<array: array<float>, sampling_rate: int>>,"
    " whisper_asr_cer: array<double>, seamlessm4t_asr_cer: array<double>>>"
)


@pytest.fixture
def records(rows):
    """The published example record, signals scaled down by 160."""

    def sentence(i, sizes, whisper, seamless):
        return (i, f"s{i}", [([float(i)] * (n // 160), 100) for n in sizes], whisper, seamless)

    data = [
        sentence(452, [188160, 189120], [0.1, 0.1], [0.2, 0.2]),
        sentence(451, [207040, 195840], [0.01379, 0.04828], [0.01379, 0.06207]),
        sentence(453, [93760], [0.3], [0.1]),
        sentence(454, [190080, 163200], [0.1, 0.2], [0.4, 0.3]),
    ]
    return rows([(1, data)], f"record int, sentence_data {SENTENCE}")


@pytest.mark.parametrize(
    "language,strategy,positions",
    [
        ("eng_Latn", "best", [1, 1, 1, 1]),
        ("eng_Latn", "worst", [2, 1, 1, 1]),
        ("zul_Latn", "best", [1, 1, 1, 2]),
        ("hau_Latn", "worst", [2, 1, 1, 2]),
        ("xho_Latn", "best", [1, 1, 1, 2]),
    ],
)
def test_choice(records, language, strategy, positions):
    got = nested.select_recordings(records, strategy, F.lit(language)).first()["chosen"]
    assert [c.id for c in got] == [451, 452, 453, 454]
    assert [c.position for c in got] == positions


def test_random_choice_repeats(records):
    draw = lambda seed: [c.position for c in nested.select_recordings(records, "random", F.lit("x"), key=F.col("record"), seed=seed).first()["chosen"]]
    assert draw(1) == draw(1) and all(draw(s)[2] == 1 for s in range(5))
    assert len({tuple(draw(s)) for s in range(20)}) > 1
    with pytest.raises(ValueError):
        nested.select_recordings(records, "median", F.lit("x"))


def test_assembly(records):
    whole = nested.assemble_records(records, "best", F.lit("eng_Latn"), rate=100)
    got = whole.first()
    assert len(got.audio) == 679_040 // 160 and got.audio[0] == 451.0 and got.audio[-1] == 454.0
    assert nested.assemble_records(records, "best", F.lit("eng_Latn"), rate=100, max_seconds=42).count() == 0
    assert nested.assemble_records(records, "best", F.lit("eng_Latn"), rate=100, max_seconds=43).count() == 1


def test_flatten(records):
    flat = nested.flatten_recordings(records, ["record"])
    assert flat.count() == 7 and flat.select("record", "sentence_pos", "audio_pos").distinct().count() == 7
    assert nested.flatten_recordings(records, ["record"], max_seconds=12).count() == 5


def test_mono(rows):
    df = rows([([[1.0, 3.0], [2.0, 2.0]],)], "f array<array<double>>")
    assert df.select(nested.to_mono(F.col("f"))).first()[0] == [2.0, 2.0]


# --- answers -----------------------------------------------------------------------------------


@pytest.mark.parametrize("text,number", [("Answer: 2", 1), ("2", 2), ("d) C", 3), ("none", -1), ("", -1), ("5 4", 4), ("the D.", 4)])
def test_answers(rows, text, number):
    assert rows([(text,)], "t string").select(answers.answer_number(F.col("t"))).first()[0] == number


def test_join_segments(rows):
    df = rows([([(2, "b "), (1, " a")],)], "s array<struct<idx: int, text: string>>")
    assert df.select(answers.join_segments(F.col("s"))).first()[0] == "ab"


def test_join_nested_segments(rows):
    df = rows([([([("a",), (" b",)],), ([("c",)],)],)], "m array<struct<elements: array<struct<value: string>>>>")
    assert df.select(answers.join_nested_segments(F.col("m"))).first()[0] == "a bc"


def brute_common_substring(left, right):
    best = ""
    for end in range(1, len(left) + 1):
        for start in range(end):
            if left[start:end] in right and end - start > len(best):
                best = left[start:end]
    return best


def test_substring_helpers_against_brute_force():
    draw = random.Random(4)
    for _ in range(1500):
        texts = ["".join(draw.choice("abc") for _ in range(draw.randint(0, 9))) for _ in range(draw.randint(1, 5))]
        merged = texts[0]
        for text in texts[1:]:
            assert answers.common_substring(merged, text) == brute_common_substring(merged, text)
            merged += text[len(brute_common_substring(merged, text)) :]
        assert answers.merge_by_common_substring(texts) == merged
        if len(texts) > 1:
            sizes = [n for n in range(1, 10) if n <= min(map(len, texts[:2])) and texts[0].endswith(texts[1][:n])]
            assert answers.overlap_length(*texts[:2]) == max(sizes, default=0)


# --- chunks ------------------------------------------------------------------------------------


@pytest.mark.parametrize("length", [0, 1, 299, 300, 301, 400, 401, 450, 451, 3333])
def test_chunks_cover(rows, length):
    plan = chunks.chunk_plan(rows([(length,)], "n int"), "n", rate=10).orderBy("chunk_idx").collect()
    covered = set()
    for r in plan:
        covered |= set(range(r.chunk_start, r.chunk_end))
    assert covered == set(range(length))
    if length > 300:
        assert [r.chunk_start for r in plan] == list(range(0, length, 200))
    else:
        assert len(plan) == 1


def test_merge_restores_text(rows):
    draw = random.Random(1)
    text = "".join(draw.choice("abcdefghij klmnop") for _ in range(1500))
    pieces = [("t", i, text[i * 200 : i * 200 + 250]) for i in range(8)]
    df = rows(pieces, "p string, chunk_idx int, chunk_text string").repartition(5)
    assert chunks.merge_chunks(df, "p").first().merged == text
    with pytest.raises(ValueError):
        chunks.merge_chunks(df, "p", mode="x")


def test_merge_modes_differ(rows):
    """The fold drops as many leading characters as the match is long, wherever it lies."""
    df = rows([("t", 0, "hello world"), ("t", 1, "my world too")], "p string, chunk_idx int, chunk_text string")
    assert chunks.merge_chunks(df, "p", mode="reference").first().merged == "hello worldld too"
    assert chunks.merge_chunks(df, "p").first().merged == "hello worldmy world too"


def test_common_substring(rows):
    df = rows([("abcxbcd", "zbcd abc"), ("", "a"), ("ab", None)], "a string, b string")
    assert [r[0] for r in df.select(answers.longest_common_substring("a", "b")).collect()] == ["abc", "", None]


# --- batches -----------------------------------------------------------------------------------


def test_buckets_obey_budget(spark):
    df = spark.range(2000).select("id", (F.col("id") * 7919 % 997 + 1).alias("len"))
    got = batching.length_buckets(df, "id", "len", 5000, 256, [F.col("id")]).toPandas()
    assert len(got) == 2000 and got["id"].is_unique
    for _, bucket in got.groupby(["batch_id", "bucket_id"]):
        longest, count = bucket["len"].max(), len(bucket)
        assert count == 1 or longest * count < 5000
    for _, batch in got.groupby("batch_id"):
        ordered = batch.sort_values(["len", "id"])
        assert list(ordered["bucket_id"]) == sorted(ordered["bucket_id"]) and ordered["bucket_id"].min() == 0


def test_bucket_of_a_row_beyond_budget(rows):
    df = rows([(1, 900), (2, 10), (3, 950)], "id int, len int")
    got = {r.id: r.bucket_id for r in batching.length_buckets(df, "id", "len", 100, 10, [F.col("id")]).collect()}
    assert got == {2: 0, 1: 1, 3: 2}


def test_spread_evenly(rows):
    df = rows([("a", 1), ("a", 2), ("b", 3)], "k string, i int")
    got = {r.i: r.t for r in batching.spread_evenly(df, F.lit(6.0), ["k"], "t").collect()}
    assert got == {1: 3.0, 2: 3.0, 3: 6.0}


def test_map_batches_retries(rows):
    calls = {}

    def scorer(batch: dict[str, list]) -> dict[str, list]:
        key = batch["id"][0]
        calls[key] = calls.get(key, 0) + 1
        if key == 0:
            raise batching.PermanentError("no")
        if key == 4:
            raise RuntimeError("down")
        if key == 8 and calls[key] < 3:
            raise RuntimeError("busy")
        return {"predictions": [t + "!" for t in batch["text"]]}

    df = rows([(i, f"t{i}", b"x") for i in range(12)], "id int, text string, audio binary").coalesce(1)
    got = batching.map_batches(df, scorer, [("predictions", "string")], batch_size=4, retries=2, pause=0.0)
    assert "audio" not in got.columns
    by = {r.id: r for r in got.collect()}
    assert by[0].predictions is None and by[3].attempts == 1 and by[3].error == "no"
    assert by[4].predictions is None and by[4].attempts == 3 and by[4].error == "down"
    assert by[8].predictions == "t8!" and by[8].attempts == 3 and by[8].error is None
    assert by[8].transcription_time_s == by[11].transcription_time_s > 0
    assert batching.drop_failed(got).count() == 4
    report = batching.failure_report(got, []).first()
    assert (report.kept, report.dropped) == (4, 8)
    assert batching.map_batches(df, scorer, [("predictions", "string")], parallel=3).rdd.getNumPartitions() == 3


def test_spread_and_stage(spark):
    small = spark.range(10, numPartitions=1)
    assert spread(small, "id").rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    wide = spark.range(100, numPartitions=64)
    assert spread(wide, "id").rdd.getNumPartitions() == 64
    assert staged(small, "t").count() == 10
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_batches_run_over_frame_borders(spark):
    """Frames of 100 rows, batches of a size that does not divide them and of one above them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        for size, want in ((64, {64: 256, 44: 44}), (256, {256: 256, 44: 44})):
            df = spark.range(300).coalesce(1)
            got = batching.map_batches(df, lambda c: {"seen": [len(c["id"])] * len(c["id"])}, [("seen", "int")], batch_size=size, drop=())
            assert {r.seen: r["count"] for r in got.groupBy("seen").count().collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_result_of_the_wrong_length_fails(spark):
    got = batching.map_batches(spark.range(5), lambda c: {"seen": [1]}, [("seen", "int")], batch_size=5, drop=())
    with pytest.raises(Exception, match="the batch function got"):
        got.coalesce(1).collect()


def test_lost_hypotheses_count_as_deletions(rows):
    runs = rows([("m", "a b c", "a b c", 1.0, 1.0), ("m", "a b c d", None, 1.0, 1.0)], "model string, text string, pred_text string, duration double, time double")
    got = metrics.score_runs(runs, ["model"]).first()
    assert (got.errors, got.words) == (4, 7)


def test_options_reach_both_profiles(rows):
    from uttermark.operators.normalize import normalize_by_language, normalize_corpus

    docs = rows([("fr", "l’eau café"), ("en", "acme™ ℃")], "lang string, t string")
    got = {r.lang: r.norm_text for r in normalize_by_language(docs, "t", "lang", remove_diacritics=False, fold_apostrophes=True).collect()}
    alone = normalize_corpus(docs.where("lang = 'fr'"), "t", "multilingual", remove_diacritics=False, fold_apostrophes=True).first()
    assert got["fr"] == alone.norm_text and "é" in got["fr"]
    assert got["en"].split() == ["acmeTM", "C"]
    with pytest.raises(Exception, match="no profile for Chinese"):
        normalize_by_language(rows([("zh", "x")], "lang string, t string"), "t", "lang").collect()


def test_joined_segments_lose_all_white_space_at_the_ends(rows):
    from uttermark.functions.answers import join_segments

    df = rows([([(0, "\n a"), (1, "b\t")],)], "s array<struct<idx:int,text:string>>")
    assert df.select(join_segments(F.col("s"))).first()[0] == "ab"


def test_special_tokens_end_at_line_feeds_alone(rows):
    from uttermark.functions.text import drop_special_tokens

    df = rows([("<|a\rb|>x",), ("<|a\nb|>x",)], "t string")
    assert [r[0] for r in df.select(drop_special_tokens(F.col("t"))).collect()] == ["x", "<|a\nb|>x"]


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    def session(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None, set=lambda *_: None), sparkContext=SimpleNamespace(master=master))

    assert shared_folder(session("local[4]"))
    for master in ("local-cluster[2,1,1024]", "yarn", "spark://host:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master))


# --- refusals and plans ------------------------------------------------------------------------


def test_numbering_under_ties(spark):
    df = spark.range(5_000).select((F.col("id") % 2).alias("k"), "id")
    got = indexing.dense_index(df, [], [F.col("k")], "at", buckets=8)
    assert sorted(r.at for r in got.collect()) == list(range(5_000)) and got.where("(at >= 2500) <> (k = 1)").count() == 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, indexing.dense_index(df.repartition(3), [], [F.col("k")], "at", buckets=5).collect()))
    got = indexing.dense_index(df, [], [F.col("k"), F.col("id")], "at", buckets=8, ties=[])
    assert got.where("at <> id div 2 + k * 2500").count() == 0 and dict(got.dtypes)["at"] == "bigint"


def test_numbering_of_many_groups_with_few_order_keys(spark):
    df = spark.range(6_000).select(F.expr("id div 3").alias("g"), (F.col("id") % 3).alias("k"))
    assert indexing.dense_index(df, ["g"], [F.col("k")], "at", buckets=8).where("at <> k").count() == 0


def test_numbering_of_small_and_empty_tables(spark):
    assert indexing.dense_index(spark.range(0), [], [F.col("id")], "at", buckets=8).count() == 0
    assert [tuple(r) for r in indexing.dense_index(spark.range(1), [], [F.col("id")], "at", buckets=8).collect()] == [(0, 0)]
    nulls = spark.createDataFrame([(None, 2), (None, 1), ("a", None)], "g string, k int")
    got = {(r.g, r.k): r.at for r in indexing.dense_index(nulls, ["g"], [F.col("k")], "at", buckets=8).collect()}
    assert got == {(None, 1): 0, (None, 2): 1, ("a", None): 0}


def test_batches_are_numbered_once(spark):
    shared = batching.share_batches(spark.range(1_000), 64, [F.col("id")], F.lit(64.0))
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 1000") == 2  # shifts and numbers
    assert {(r.batch_id, r.transcription_time_s) for r in shared.collect() if r.batch_id in (0, 15)} == {(0, 1.0), (15, 1.6)}


def test_limit_filters_the_scan_by_key(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(200).select("id", F.when(F.col("id") % 2 == 0, " ").otherwise("a word").alias("text")).write.parquet(path)
    got = prepare.prepare(spark.read.parquet(path), limit=3, order=[F.col("id")], profile="multilingual")
    assert sorted(r.id for r in got.collect()) == [1, 3, 5]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(IsNull(id),LessThanOrEqual(id,5))]" in plan


def test_fold_streams_over_frames(spark, rows):
    """Parents run over the borders of small frames; nothing is gathered, and lost texts are refused."""
    rng = random.Random(4)
    data = [(f"p{p}" if p else None, i, "".join(rng.choice("ab c") for _ in range(rng.randint(0, 12)))) for p in range(12) for i in range(rng.randint(1, 30))]
    df = rows(data, "d string, chunk_idx int, chunk_text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.d: r.merged for r in chunks.merge_chunks(df, "d", mode="reference").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for d, i, t in sorted(data, key=lambda r: (r[0] or "", r[1])):
        text = want.get(d, "")
        shared = max((n for n in range(len(t) + 1) for s in range(len(t) - n + 1) if t[s : s + n] in text), default=0)
        want[d] = text + t[shared:]
    assert got == want
    plan = chunks.merge_chunks(df, "d", mode="reference")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    lost = rows([("p", 0, "a"), ("p", 1, None)], "d string, chunk_idx int, chunk_text string")
    for mode in ("reference", "overlap"):
        with pytest.raises(Exception, match="no text"):
            chunks.merge_chunks(lost, "d", mode=mode).collect()


def folded_by_automaton(texts):
    text, waiting = answers.GrowingText(), ""
    for t in texts:
        text.append(waiting)
        waiting = t[text.shared_length(t) :]
    return f"{text}{waiting}"


def test_fold_of_overlapping_chunks_needs_no_automaton():
    rng = random.Random(5)
    text = "".join(rng.choice("etaoin shrdlué😀") for _ in range(4_000))
    texts = [text[at : at + 250] for at in range(0, len(text), 200)]
    fold = answers.Fold()
    for t in texts:
        fold.add(t)
    assert fold.merged is None and str(fold) == text


def test_fold_equals_the_automaton():
    """Long, short and no matches, runs that repeat at very many places, and letters of every width."""
    rng = random.Random(6)
    for letters in ("a", "ab", "abc é😀", "etaoin shrdlu"):
        for _ in range(150):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) * rng.choice((1, 1, 9))
            texts = [text[at : at + rng.randint(0, 90)] for at in (rng.randint(0, len(text)) for _ in range(12))]
            texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3)]
            rng.shuffle(texts)
            assert answers.merge_by_common_substring(texts) == folded_by_automaton(texts)


def test_automaton_stays_small():
    text = answers.GrowingText()
    rng = random.Random(2)
    text.append("".join(rng.choice("etaoin shrdlu") for _ in range(20_000)))
    states = len(text.size)
    assert states <= 40_000 and len(text.more) < 20_000
    assert sum(a.itemsize * len(a) for a in (text.letter, text.target, text.link, text.size)) == 16 * states


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_dictionary_tables(spark, rows, threshold):
    df = rows([(1, "a b a c", 1), (2, "x", 2), (3, None, 3), (4, "", 4), (None, "b  b", 5)], "id int, t string, REWRITTEN int")
    table = rows([("a", "1"), ("b", "22"), ("b", "2"), ("zz", "9"), (None, "n"), ("c", None), ("", "_")], "word string, replacement string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = {r.id: r.rewritten for r in rewrite_by_table(df, ["id"], "t", table).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == {1: "1 2 1 c", 2: "x", 3: None, 4: "_", None: "2 _ 2"}


def test_two_chunks_at_one_place_fail(rows):
    df = rows([("p", 0, "abc"), ("p", 0, "zzz"), ("p", 1, "def")], "d string, chunk_idx int, chunk_text string")
    for mode in ("overlap", "reference"):
        with pytest.raises(Exception, match="same index"):
            chunks.merge_chunks(df, "d", mode=mode).collect()


def _record(rows, signals, kind, rates):
    audio = [(s, r) for s, r in zip(signals, rates)]
    sentences = [(i, "t", [a], [0.1], [0.1]) for i, a in enumerate(audio)]
    return rows(
        [(1, sentences)],
        f"record int, sentence_data array<struct<id:int,transcription:string,audio:array<struct<array:{kind},sampling_rate:int>>,"
        "whisper_asr_cer:array<double>,seamlessm4t_asr_cer:array<double>>>",
    )


def test_channels_are_averaged_in_assembly(rows):
    stereo = _record(rows, [[[1.0, 3.0], [2.0, 4.0]], [[0.0, 1.0]]], "array<array<double>>", [16, 16])
    assert nested.assemble_records(stereo, "best", F.lit("eng_Latn"), rate=16).first().audio == [2.0, 3.0, 0.5]


def test_mixed_rates_fail_in_assembly(rows):
    mixed = _record(rows, [[1.0], [2.0]], "array<double>", [16, 8])
    with pytest.raises(Exception, match="different sampling rates"):
        nested.assemble_records(mixed, "best", F.lit("eng_Latn"), rate=16).collect()


def test_lost_hypotheses_are_counted(rows):
    df = rows([("a b c", "a b c", 1.0, 1.0), ("a b c d", None, 1.0, 1.0)], "text string, pred_text string, duration double, time double")
    got = metrics.score_runs(df.withColumn("run", F.lit(1)), ["run"]).first()
    assert (got.samples, got.lost, got.errors, got.words) == (2, 1, 4, 7)


def test_numbering_shuffles_the_rows_once(spark):
    """The join with the counts of ranges finds the rows where the window has them; null groups and NaN are groups too."""
    df = spark.range(500).select(
        "id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.when(F.col("id") % 2 == 0, float("nan")).alias("h"), F.repeat(F.lit("x"), 50).alias("wide")
    )
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = indexing.dense_index(df, ["g", "h"], [-F.col("id")], "at", buckets=5)
        got = {}
        for r in numbered.collect():
            got.setdefault((r.g, str(r.h)), []).append((r.at, -r.id))
        plan = numbered._jdf.queryExecution().sparkPlan().toString()
        tree = numbered._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert len(got) == 6 and "SortMergeJoin" in plan
    for own in got.values():
        assert [at for at, _ in sorted(own, key=lambda x: x[1])] == list(range(len(own)))
    assert sum("Exchange" in line and "wide" in line for line in tree.splitlines()) <= 1
    assert tree.count("Exchange hashpartitioning") == 4
