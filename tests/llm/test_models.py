"""Language ID, quality rules, weak labels, near duplicates, packing and the pipeline against brute force and held-out rows."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from uttermark.llm import components, language_id, line_rules, packing, simhash, text_stats, weak_quality
from uttermark.llm.common import LOWER, UPPER
from uttermark.llm.queries import op2_language_id

SF = "/root/testdata/sf0.001"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


# Language ID


def test_language_of_held_out_rows(spark):
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op2_language_id(spark, SF).collect()
    assert len(got) == len(known)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_edges(rows):
    data = [(i, "der die das und ist " * 20, "de") for i in range(0, 40)] + [(i, "the and of is with " * 20, "en") for i in range(40, 80)]
    odd = [(100, None, None), (101, "", "de"), (102, "12 34 !?", "en"), (None, "the and of is with", None), (103, "die und das " * 30_000, None)]
    docs = rows(data + odd + odd[:1], "doc_id long, text string, lang string").selectExpr("*", "1 as SCORE")
    model = language_id.fit(docs)
    got = language_id.identify(docs, model).collect()
    answers = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert len(got) == 86 and answers[100] == answers[101] == answers[102] == ("und", 0.0)
    assert answers[None][0] == "en" and answers[103][0] == "de"
    assert language_id.in_known_language(docs, model).columns == docs.columns
    assert sorted(r.doc_id or 0 for r in language_id.in_known_language(docs, model).collect()) == sorted([*range(80), 0, 103])


def test_unlearnt_languages_and_gibberish_go(spark, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(12)

    def noise(letters, n):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(n))

    pl = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. "
    ru = "Все люди рождаются свободными и равными в своем достоинстве и правах. "
    fi = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. "
    out = [pl, pl * 3, ru, ru * 200, "Привет", "Привет мир", fi * 2, "すべての人間は、生まれながらにして自由である。"]
    out += [noise("abcdefghijklmnopqrstuvwxyz", n) for n in (5, 20, 400)] + [noise("bcdfghjklmnpqrstvwxz", 40), noise("bcdfghjklmnpqrstvwxz", 2)]
    held = docs.where(language_id.held_out("doc_id")).orderBy("doc_id").collect()
    clean = [r.text for r in held if re.fullmatch(r"[^\W\d_]+(?:[ .,\n]+[^\W\d_]+)*[.,]?", r.text)]
    assert len(clean) > 20
    short = [" ".join(t.split()[at : at + n]) for t in clean for n in (1, 2) for at in (0, 5)]
    stay = clean + [x for x in short if x]
    data = [(-1 - i, t) for i, t in enumerate(out)] + list(enumerate(stay))
    got = {r.i for r in language_id.in_known_language(rows(data, "i long, text string"), language_id.fit(docs)).collect()}
    assert not [t[:60] for i, t in data if i < 0 and i in got]
    assert not [t[:60] for i, t in data if i >= 0 and i not in got]


def test_numerals_are_no_letters(rows):
    texts = ["½ ② ²", "Ⅷ", "12 %", "", "é", "日", "ªx", "Ⅷ a"]
    assert [language_id.has_letter(t) for t in texts] == [False, False, False, False, True, True, True, True]
    docs = rows([(i, t, "en" if i % 2 else "de") for i, t in enumerate(texts * 6)], "doc_id long, text string, lang string")
    got = {texts[r.doc_id % 8]: r.lang_pred for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert {t for t, lang in got.items() if lang == "und"} == set(texts[:4])


def test_language_without_labels(rows):
    docs = rows([(1, "a b", None), (2, "12", None)], "doc_id long, text string, lang string")
    assert language_id.fit(docs) is None
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}
    assert [r.doc_id for r in language_id.in_known_language(docs, None).collect()] == [1]


def test_collapsed_scores_are_the_kernel_machine():
    """Presence rows times the collapsed weights equal the kernel against the landmarks times the ridge weights."""
    kernel = language_id.Kernel(dims=2**10)
    texts = [f"{w} {w}s {w}ing" for w in ("alpha", "beta", "gamma", "delta", "omega", "sigma")]
    dense = np.vstack([kernel.presence(*kernel.cells(t)) for t in texts])
    model = language_id.fit_rows(kernel, dense.copy(), list("ababab"), 6, 0.1)
    unit = dense / np.sqrt(dense.sum(1, keepdims=True))
    gram = unit @ unit.T
    for i, j in itertools.product(range(6), repeat=2):
        a, b = set(np.flatnonzero(dense[i])), set(np.flatnonzero(dense[j]))
        assert gram[i, j] == pytest.approx(len(a & b) / np.sqrt(len(a) * len(b)), abs=1e-5)
    targets = np.array([[1, -1], [-1, 1]] * 3)
    alpha = np.linalg.solve(gram @ gram + 0.1 * gram + 1e-6 * np.eye(6), gram.T @ targets)
    rank = [0, 2, 4, 1, 3, 5]
    assert model.scores(dense) == pytest.approx(gram @ alpha, abs=1e-2), rank


# SimHash


def slow_fingerprint(text):
    words = BLANK.findall((text or "").translate(str.maketrans(UPPER, LOWER)))
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, near):
    """Smallest id reachable, by plain search."""
    left, out = set(nodes), {}
    while left:
        seen, todo = set(), [min(left)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [y for y in left - seen if near(x, y)]
        out |= dict.fromkeys(seen, min(seen))
        left -= seen
    return out


def test_near_duplicates(rows):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(120)) for _ in range(12)]
    data = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "changed"
        data.append((100 + i, " ".join(words)))
    data += [(500, None), (501, ""), (502, " \n"), (503, "One two"), (504, "oNE TWO"), (504, "oNE TWO"), (None, "one two"), (600, "long " * 60_000)]
    docs = rows([(i, t, "x") for i, t in data], "doc_id long, text string, Component_ID string")
    got = simhash.near_duplicates(docs).collect()
    prints = {i: slow_fingerprint(t) for i, t in data if i is not None}
    want = classes(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert len(got) == len(data)
    for r in got:
        assert r.component_id == (503 if r.doc_id is None else want[r.doc_id])
        assert r.doc_id is None or r.fingerprint == f"{prints[r.doc_id]:016x}"
    left = simhash.without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted({w for w in want.values()})


@pytest.mark.parametrize("most", [4_000_000, 5_000])
def test_meeting_finds_all_links(most):
    """All planted distances up to five, with the working memory split and not."""
    rng, bits = random.Random(8), 6
    nodes = {0, (1 << 64) - 1}
    for _ in range(12):
        center = rng.getrandbits(64)
        nodes |= {center ^ sum(1 << b for b in rng.sample(range(64), d)) for d in range(6)}
    near = classes(nodes, lambda a, b: (a ^ b).bit_count() <= 4)
    fps = np.array(sorted(nodes), np.uint64)
    links = []
    reach = [simhash.masks(64 - bits, 64, n) for n in range(3)]
    for prefix in range(1 << bits):
        parts = [np.concatenate([fps[((fps ^ m) >> np.uint64(64 - bits)) == prefix] for m in some]) for some in reach]
        u, v = simhash.meet(parts, bits, prefix, 4, most)
        links += list(zip(u.tolist(), v.tolist()))
    linked = set(links) | {(b, a) for a, b in links}
    assert classes(nodes, lambda a, b: (a, b) in linked) == near


def test_components_of_paths_stars_and_loops(rows):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300), (301, 300)]
    got = {r.node: r.root for r in components.components(rows(edges, "u long, v long")).collect()}
    want = classes({x for e in edges for x in e} - {200}, lambda a, b: (a, b) in edges or (b, a) in edges)
    assert got == want
    assert components.components(rows([], "u long, v long")).count() == 0


# Quality rules


def slow_counts(text):
    words = BLANK.findall(text or "")
    lines = [x for x in (text or "").split("\n") if BLANK.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    repeats = len(covered)
    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, sum(x in lines[:i] for i, x in enumerate(lines)), repeats, failed


def odd_texts():
    rng = random.Random(6)
    parts = ["a", "b", "É€", "#", "*$", "\n", "\n\n", "\t", "\x0b", "\x1c", " ", "same line here\n", "日本"]
    return [None, "", "\n \n"] + [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 150))) for _ in range(80)] + ["word " * 3000]


def test_base_counts(rows):
    data = list(enumerate(odd_texts())) + [(None, "a b"), (3, "a b"), (3, "a b")]
    docs = rows([(i, t, "x") for i, t in data], "doc_id long, text string, KEPT string")
    got = line_rules.quality_rules(docs, line_rules.fit(docs)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:7])
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(((i, *slow_counts(t)) for i, t in data), key=key)
    assert not any(r.kept and r.base_failed for r in got)


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(3)
    for n in range(1, 7):
        chain = line_rules.Chain(rng.normal(size=(11, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
        signs = (rng.random((n, 11)) < 0.4).astype(float)
        emit = signs @ chain.emit

        def score(labels):
            return chain.start[labels[0]] + sum(emit[i, x] for i, x in enumerate(labels)) + sum(chain.step[a, b] for a, b in itertools.pairwise(labels))

        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert chain.decode(signs).tolist() == list(best)


def test_expectations_are_those_of_all_labellings():
    rng = np.random.default_rng(5)
    scores, step, start = rng.normal(size=(1, 4, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    total, labels, steps = 0.0, np.zeros((4, 2)), np.zeros((2, 2))
    for some in itertools.product((0, 1), repeat=4):
        w = np.exp(start[some[0]] + sum(scores[0, i, x] for i, x in enumerate(some)) + sum(step[a, b] for a, b in itertools.pairwise(some)))
        total += w
        for i, x in enumerate(some):
            labels[i, x] += w
        for a, b in itertools.pairwise(some):
            steps[a, b] += w
    padded = np.concatenate([scores, np.zeros((1, 2, 2))], axis=1)
    there = np.array([[True] * 4 + [False] * 2])
    got, got_steps = line_rules._expected(padded, there, step, start)
    assert got[0, :4] == pytest.approx(labels / total) and not got[0, 4:].any()
    assert got_steps == pytest.approx(steps / total)


def test_quality_rules_keep_good_texts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = line_rules.quality_rules(docs, line_rules.fit(docs)).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.95 * len(good) and sum(r.kept for r in bad) <= 0.5 * len(bad)


# Weak labels


def test_labellers_recover_planted_accuracy():
    rng = np.random.default_rng(1)
    patterns, truth = {}, {}
    for _ in range(20_000):
        good = rng.random() < 0.8
        cast = []
        for i in range(9):
            rates = [0.5, 0.001, 0.499] if good else [0.2, 0.5, 0.3]  # false alarms are rare: see fit_labellers
            cast.append(int(rng.choice(3, p=rates)))
        code = weak_quality.pattern_code(tuple(cast))
        patterns[code] = patterns.get(code, 0) + 1
        truth.setdefault(code, []).append(good)
    def right(posterior):
        return sum(sum(t == (posterior[c] > 0.5) for t in some) for c, some in truth.items())

    assert right(weak_quality.fit_labellers(patterns)[0]) > 0.9 * 20_000
    posterior, table = weak_quality.fit_labellers(patterns, strength=0.05)
    assert right(posterior) > 0.95 * 20_000 and (table[:, 1, weak_quality.BAD] > table[:, 0, weak_quality.BAD]).all()


def test_labellers_recover_planted_rates_by_default():
    """The default belief is a fixed number of rows: the rates come out at every size, the closer the more rows there are."""
    rates = np.array([[[0.5, 0.01, 0.49], [0.2, 0.1 + 0.05 * i, 0.7 - 0.05 * i]] for i in range(9)])
    off = []
    for size in (4_000, 40_000):
        rng, patterns = np.random.default_rng(2), {}
        for good in rng.random(size) < 0.86:
            code = weak_quality.pattern_code(tuple(int(rng.choice(3, p=r[0 if good else 1])) for r in rates))
            patterns[code] = patterns.get(code, 0) + 1
        off.append(np.abs(weak_quality.fit_labellers(patterns)[1] - rates)[..., weak_quality.BAD].max())
    assert off[0] < 0.1 and off[1] < 0.03


def test_symbol_noise_meets_two_labellers():
    raw = b"annd*** eaing,$$$ to%%% thr&&& onst### then"
    cast = dict(zip(weak_quality.LABELLERS, weak_quality.votes(weak_quality.ratios(raw, raw.split()))))
    assert cast["symbols"] == cast["doubled"] == weak_quality.BAD


def test_weak_quality_ranks_good_above_bad(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = weak_quality.quality_scores(docs, weak_quality.fit(docs)).join(labels, "doc_id").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.85
    assert sum(r.kept for r in got if r.quality == 1) >= 0.95 * len(good)


def test_weak_quality_edges(rows):
    data = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "a"), (2, None), (2, None)]
    docs = rows([(i, t, "x") for i, t in data], "doc_id long, text string, SCORE string")
    got = weak_quality.quality_scores(docs, weak_quality.fit(docs)).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 and 0 <= r.weak_label <= 1 for r in got)
    none = rows([], "doc_id long, text string")
    assert weak_quality.quality_scores(none, weak_quality.fit(none)).count() == 0
    assert line_rules.quality_rules(none, line_rules.fit(none)).count() == 0


def test_stats_of_empty_text():
    assert text_stats.repeated_words([]) == 0 and text_stats.word_chars(b"") == 0


# Packing


def slow_best_fit(sizes, sources, clusters, capacity):
    """Try every open bin for every item."""
    bins, placed = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        full = (size - 1) // capacity if size > capacity else 0
        first = len(bins)
        bins += [None] * full
        rest = size - full * capacity
        fits = [
            (b["left"], i)
            for i, b in enumerate(bins)
            if b and b["left"] >= rest and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])
        ]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append({"left": capacity, "s": set(), "c": set()})
        placed.append((first, full, i, capacity - bins[i]["left"]))
        bins[i]["left"] -= rest
        bins[i]["s"].add(source)
        bins[i]["c"].add(cluster)
    return placed, len(bins)


def test_one_hot_id_is_dealt_over_all_shards(rows):
    """A third of the ids are null, as many are one number, and very many rows are the same."""
    data = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"t{i}", None) for i in range(3000)] + [(9, "the same", None)] * 1500
    docs = rows(data, "doc_id long, text string, source string")
    got = packing.pack(docs, capacity=200, per_shard=500)
    assert got.count() == 4500
    by = {r.s: r.n for r in got.groupBy(F.shiftright("bin_id", 32).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(by) == 9 and max(by.values()) < 900
    used = got.groupBy("bin_id").agg(F.sum("size").alias("bytes"), F.count_if(F.col("doc_id") == 9).alias("same"))
    assert used.where("bytes > 200 or same > 1").count() == 0


def test_lines_are_learnt_from_all_of_a_text():
    """Windows have the signs that their lines have in the whole text, and reach its end as they do its beginning."""
    places = set()
    for i in range(60):
        raw = b"\n".join(f"line {k} of {i} is here.".encode() for k in range(8)) + b"\nline 0 of %d is here.\nAll rights reserved" % i
        whole, window = line_rules.line_signs(line_rules.worded_lines(raw)), line_rules.window_signs(raw, 4)
        at = [k for k in range(7) if (whole[k : k + 4] == window).all()]
        assert len(window) == 4 and at
        places |= {at[0], at[-1]}
    assert {0, 6} <= places
    assert len(line_rules.window_signs(b"a\nb", 32)) == 2 and len(line_rules.window_signs(b"", 32)) == 0


def test_near_duplicates_of_an_empty_table(rows):
    none = rows([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0 and simhash.without_near_duplicates(none).count() == 0


def test_near_copies_with_clashing_names(rows):
    data = [(i, f"some words of text number {i} here", "a", i) for i in range(30)] + [(100 + i, "some words of text number 3 here", "b", i) for i in range(20)]
    data += [(None, "some words of text number 3 here", "c", 0)]
    docs = rows(data, "doc_id long, text string, _LOST string, _maybe int")
    left = simhash.without_near_duplicates(docs, radius=0)
    assert left.dtypes == docs.dtypes
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in left.collect()) == [-1, *range(30)]


def test_best_fit_against_all_bins():
    rng = random.Random(9)
    for _ in range(30):
        n = rng.randint(0, 120)
        sizes = sorted((rng.randint(1, 250) for _ in range(n)), reverse=True)
        sources, clusters = [rng.choice([None, "a", "b", "c", "d"]) for _ in range(n)], [rng.choice([None, 1, 2, 3]) for _ in range(n)]
        assert packing.best_fit(sizes, sources, clusters, 100) == slow_best_fit(sizes, sources, clusters, 100)


def test_pack(rows):
    rng = random.Random(10)
    data = [(i, "x" * rng.randint(0, 300), rng.choice(["a", "a", "b", None])) for i in range(400)]
    data += [(i, "copy of one text" if i % 2 else "Copy of ONE text", f"s{i}") for i in range(500, 560)] + [(None, None, None), (7, "again", "z"), (7, "again", "z"), (900, "y" * 5000, "a")]
    docs = rows(data, "doc_id long, text string, source string").selectExpr("*", "0 as SHARD", "1 as Bin_Id")
    got = packing.pack(docs, capacity=200, per_shard=100).collect()
    assert len(got) == len(data) and sum(r.size for r in got) == sum(len((t or "").encode()) + 1 for _, t, _ in data)
    used = {}
    for r in got:
        rest = r.size - 200 * r.full_bins
        assert 0 < rest <= 200
        used.setdefault(r.bin_id, []).append((r.bin_offset, r.bin_offset + rest, r.doc_id))
        for k in range(r.full_bins):
            assert (r.first_full_bin + k) not in used
    source = {i: s for i, _, s in data}
    text = {i: t for i, t, _ in data}
    for some in used.values():
        some.sort(key=lambda x: x[:2])
        assert some[0][0] == 0 and some[-1][1] <= 200 and all(a[1] == b[0] for a, b in itertools.pairwise(some))
        sources = [source[i] for _, _, i in some if source[i] is not None]
        texts = [text[i].lower() for _, _, i in some if text[i]]
        assert len(sources) == len(set(sources)) and len(texts) == len(set(texts))
    assert packing.pack(rows([], "doc_id long, text string, source string")).count() == 0


# Pipeline


def test_pipeline_against_its_stages_by_brute_force(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {i: r.text for i, r in docs.items() if r.text and re.search(r"[^\W\d_]", r.text)}
    newest = {}
    for i, t in kept.items():
        newest[t.translate(str.maketrans(UPPER, LOWER))] = max(i, newest.get(t.translate(str.maketrans(UPPER, LOWER)), -1))
    kept = {i: kept[i] for i in newest.values()}
    prints = {i: slow_fingerprint(t) for i, t in kept.items()}
    first = classes(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    want = sorted(set(first.values()))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "secret_scans", "best_fit_packing"]


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.simpleString() == docs.schema.simpleString()


def test_fit_spreads_out_few_rows_at_once():
    """Bits and dense rows give one model, and the bits of a whole sample are never dense at once."""
    import tracemalloc

    draw = np.random.default_rng(4)
    kernel = language_id.Kernel(dims=2**12)
    dense = (draw.random((1500, kernel.dims)) < draw.random((3, kernel.dims))[np.arange(1500) % 3] ** 6).astype(np.float32)
    langs = ["abc"[i % 3] for i in range(1500)]
    packed = [np.packbits(row > 0).tobytes() for row in dense]
    tracemalloc.start()
    got = language_id.fit_rows(kernel, packed, langs, 60, 0.3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < dense.nbytes / 2
    assert np.allclose(got.weights, language_id.fit_rows(kernel, dense, langs, 60, 0.3).weights)
