"""Personal data against plain regexes, known reliabilities and planted spans."""

import hashlib
import random
import re

import numpy as np
import pytest

from uttermark.llm import private_spans as ps

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def sums_to_ten(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def holds(kind, span):
    digits = "".join(c for c in span if c.isascii() and c.isdigit())
    if kind == ps.IP:
        return all(int(p) <= 255 for p in span.split("."))
    if kind == ps.CARD:
        return 16 <= len(digits) <= 19 and sums_to_ten(digits)
    return kind == ps.EMAIL or 8 <= len(digits) <= 15


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text) if holds(k, m[0])]


def card(rng, size=16):
    digits = "".join(rng.choice("0123456789") for _ in range(size - 1))
    return next(digits + d for d in "0123456789" if sums_to_ten(digits + d))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(4)
    parts = ["@", ".", "a", "b-", "_", "+", "1", "25", "256", "0", " ", "-", "(", ")", "é", "日", "a@b.c", "1.2.3.4", "+1 (234) 567-8901", card(rng), "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        if rng.random() < 0.3:
            text += rng.choice([" ", "-", ""]).join(card(rng, rng.choice([16, 19]))[i : i + 4] for i in range(0, 16, 4))
        assert ps.base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    size = 200_000
    for run in ("a", "1", "@", "a@", "1.", "+1", "+1 ", "1 ", "a.", "(at)", ":1", "00", "-"):
        text = run * (size // len(run))
        base = ps.base_spans(text)
        assert len(ps.more_spans(text, base)) >= 0


def test_more_spans_touch_nothing():
    rng = random.Random(8)
    parts = ["a (at) b.com", "x [at] y [dot] org", "555-123-4567", "(555) 123-4567", "0049 170 1234567", card(rng, 15), card(rng), "a@b.de", "1:2:3:4:5:6:7:8", "1.2.3.4", " ", "-", ", "]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(12))
        base = ps.base_spans(text)
        more = ps.more_spans(text, base)
        ends = sorted((s, e) for _, s, e in more)
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
        assert not any(s < e2 and s2 < e for _, s, e in more for _, s2, e2 in base)


def test_em_finds_the_reliabilities():
    """Overlapping labellers of known rates, some of them worse than the belief, with the strength that the query uses."""
    rng = np.random.default_rng(5)
    n, rates = 20_000, [(0.9, 0.1), (0.8, 0.3), (0.7, 0.05), (0.6, 0.4), (0.85, 0.2), (0.5, 0.45), (0.75, 0.1), (0.9, 0.5)]
    truth = rng.random(n) < 0.6
    patterns, cast = {}, np.full((n, len(rates)), ps.ABSTAIN)
    for i, (hit, false) in enumerate(rates):
        says = rng.random(n) < np.where(truth, hit, false)
        speaks = rng.random(n) < 0.8
        cast[speaks, i] = np.where(says, ps.PRIVATE, ps.PLAIN)[speaks]
    for row in cast.tolist():
        code = ps.pattern_code(tuple(row))
        patterns[code] = patterns.get(code, 0) + 1
    posterior, table = ps.fit_labellers(patterns)
    for i, (hit, false) in enumerate(rates):
        assert table[i, 0, ps.PRIVATE] == pytest.approx(0.8 * hit, abs=0.03) and table[i, 1, ps.PRIVATE] == pytest.approx(0.8 * false, abs=0.03)
    right = sum((posterior[ps.pattern_code(tuple(row))] >= 0.5) == t for row, t in zip(cast.tolist(), truth))
    assert right > 0.93 * n


WORDS = "the plain words of a text that holds nothing at all".split()


def document(rng, i):
    words = [rng.choice(WORDS) for _ in range(20)]
    private, clean = [], []
    for _ in range(rng.randint(0, 2)):
        private.append(rng.choice(["mail me.{0}@mail.example.com", "call (555) 1{0}2-4567", "write to joe{0} (at) mail (dot) org", "phone +1 (234) 567-{0}901", "visa " + card(rng).replace("{", "")]).replace("{0}", str(i % 10)))
    if rng.random() < 0.5:
        clean.append(rng.choice(["order {0}", "serial {0}", "hash ab{0}ef", "invoice {0}"]).format("9" + "".join(rng.choice("0123456789") for _ in range(13))))
    return " ".join([*words, *private, *words[:3], *clean]), private


def table(n=400, seed=6):
    rng = random.Random(seed)
    rows = [(i, *document(rng, i)) for i in range(n)]
    same = document(rng, 3)
    return rows + [(5000 + i, *same) for i in range(n // 2)] + [(None, "mail a@b.com", ["mail a@b.com"]), (3, None, []), (4, "", []), (7, "é" * 100_000 + " a.b@c.de", ["a.b@c.de"])]


def test_private_spans(rows):
    """Base columns by brute force; what the classifier adds is planted, and clean rows stay clean."""
    data = table()
    df = rows([(i, t, 1) for i, t, _ in data], "doc_id long, text string, SPANS int")
    model = ps.fit(df)
    got = ps.private_spans(df, model).collect()
    assert len(got) == len(data)
    want = {}
    for i, text, private in data:
        base = plain_spans(text or "")
        shown = ",".join(f"{ps.KINDS[k]}:{s}:{e}" for k, s, e in base)
        counts = tuple(sum(k == kind for k, _, _ in base) for kind in range(4))
        want.setdefault(i, []).append((*counts, hashlib.sha256(shown.encode()).hexdigest(), text or "", private, base))
    added = 0
    for r in got:
        options = want[r.doc_id]
        n = [o for o in options if tuple(r)[1:6] == o[:5]]
        assert n, r.doc_id
        text, private, base = n[0][5:]
        if len(options) == 1:
            spans = [x.split(":") for x in r.spans.split(",") if x]
            assert {(ps.KINDS.index(k), int(s), int(e)) for k, s, e in spans} >= set(base)
            assert r.n_added == len(spans) - len(base)
            more = [text[int(s) : int(e)] for k, s, e in spans if (ps.KINDS.index(k), int(s), int(e)) not in base]
            assert all(any(m.strip() in p for p in private) for m in more), (more, private)
            added += len(more)
    planted = sum(p.startswith(("call", "write")) for i, _, private in data for p in private)
    assert added >= 0.9 * sum(p.startswith(("call", "write")) for i, _, private in data if i is not None and len(want[i]) == 1 for p in private) and planted


def test_masking(rows):
    data = table(60)
    df = rows([(i, t, i) for i, t, _ in data], "Doc_ID long, text string, _0 long")
    model = ps.fit(df)
    got = ps.without_private(df, model)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    left = got.collect()
    assert len(left) == len(data) and sum(r.text is None for r in left) == 1
    assert not any(ps.base_spans(r.text or "") for r in left)
    assert {r.text for r in left if r._0 == 7 and r.text.startswith("é")} == {"é" * 100_000 + " [email]"}


def test_empty_tables(rows):
    for data in ([], [(1, None)], [(None, "")]):
        df = rows(data, "doc_id long, text string")
        model = ps.fit(df)
        got = ps.private_spans(df, model).collect()
        empty = hashlib.sha256(b"").hexdigest()
        assert [tuple(r) for r in got] == [(i, 0, 0, 0, 0, empty, "", 0) for i, _ in data]
        assert ps.without_private(df, model).count() == len(data)
