"""Personal data: regex, gazetteer and context labellers vote on candidate spans, EM weighs them, its labels train the span classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from uttermark.llm.common import staged, text_of

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
PRIVATE, PLAIN, ABSTAIN = 0, 1, 2

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# The patterns of the base kinds, written so that no run of characters is read from each of its places:
# a start within a run of digits fails as the start of the run does, and no match ends within one.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Wider forms, which the labellers judge.
_AT = re.compile(r" ?[\[({](?:at|AT)[\])}] ?")
_DOTTED = re.compile(r"[A-Za-z0-9-]++(?:(?: ?[\[({](?:dot|DOT)[\])}] ?|\.)[A-Za-z0-9-]++)++")
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])")
_BARE_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+])00[1-9][0-9 ().-]{6,18}[0-9](?![0-9])")
_ANY_DIGIT = re.compile(r"[0-9]")


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """Every second digit from the right counts double, less nine above nine; the sum ends in zero."""
    doubled = (2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return (sum(doubled) + sum(map(int, digits[-1::-2]))) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def emails(text: str, mark: re.Pattern | None = None, domain: re.Pattern = _DOMAIN) -> list[tuple[int, int]]:
    """Leftmost matches, found from their ``@``: what is left of it up to the last match or ``@`` is read once."""
    found, low = [], 0
    places = ((m.start(), m.end()) for m in mark.finditer(text)) if mark else _signs(text)
    for at, after in places:
        before = text[low:at]
        size = len(before) - len(before.rstrip(LOCAL))
        low = after
        if size and (m := domain.match(text, after)):
            found.append((at - size, m.end()))
            low = m.end()
    return found


def _signs(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    while at >= 0:
        yield at, at + 1
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, in their order."""
    found = [(EMAIL, s, e) for s, e in emails(text)]
    if _ANY_DIGIT.search(text):
        found += [(IP, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _DIGITS.finditer(text):
            if 16 <= m.end() - m.start() <= 37:
                digits = digits_of(m[0])
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append((CARD, m.start(), m.end()))
        if "+" in text:
            found += [(PHONE, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return found


def more_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of a wider form that touch no base span and no other one of their kind."""
    wide: list[tuple[int, int, int]] = []
    if "at" in text or "AT" in text:
        wide += [(EMAIL, s, e) for s, e in emails(text, _AT, _DOTTED)]
    if _ANY_DIGIT.search(text):
        if ":" in text:
            wide += [(IP, m.start(), m.end()) for m in _IP6.finditer(text)]
        for m in _DIGITS.finditer(text):
            if 13 <= m.end() - m.start() <= 37 and 13 <= len(digits_of(m[0])) <= 19:
                wide.append((CARD, m.start(), m.end()))
        wide += [(PHONE, m.start(), m.end()) for m in _BARE_PHONE.finditer(text)]
    if not wide:
        return []
    taken = sorted((s, e) for _, s, e in base)
    free, i, high = [], 0, 0
    for kind, s, e in sorted(wide, key=lambda x: (x[1], x[0])):
        while i < len(taken) and taken[i][0] < e:
            high = max(high, taken[i][1])
            i += 1
        if high <= s:
            free.append((kind, s, e))
            high = e
    return free


# Public top-level domains, calling codes, first digits of card issuers, and words around personal data.
DOMAINS = "com org net edu gov mil int info biz io dev app eu uk de fr es it nl be ch at pl pt se no dk fi ie ca us mx br ar cl jp cn kr in au nz za ru".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
ISSUERS = "4 51 52 53 54 55 22 23 24 25 26 27 34 37 35 36 38 6011 65 62".split()
FILES = "png jpg jpeg gif svg js css py java txt html xml json zip".split()
NEAR = (
    "mail email e-mail contact write correo courriel kontakt escriba".split(),
    "ip host server address adresse direction client login dirección".split(),
    "card visa mastercard amex credit debit karte kreditkarte tarjeta carte".split(),
    "tel phone call fax mobile cell telefon anruf téléphone teléfono llame".split(),
)
AGAINST = "version release build isbn order invoice ref reference serial part section page chapter hash commit token".split()

_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
CONTEXT = 40


def near_words(text: str, start: int) -> list[str]:
    """Words that end within the ``CONTEXT`` characters before a span, nearest last, in lower case."""
    return [w.lower() for w in _WORD.findall(text[max(0, start - CONTEXT) : start])]


def _strict(kind: int, span: str, base: bool, **_) -> int:
    """Regex: the base pattern and its check."""
    return PRIVATE if base else ABSTAIN


def _form(kind: int, span: str, **_) -> int:
    """Regex: written the way such data is written."""
    if kind == EMAIL:
        local, _at, domain = span.partition("@")
        return PLAIN if ".." in local or local[0] in ".-" or domain.startswith("-") or "-." in domain else PRIVATE
    if kind == IP:
        return PRIVATE if ":" in span or all(p == "0" or p[0] != "0" for p in span.split(".")) else PLAIN
    if kind == CARD:
        groups = re.split("[ -]", span)
        return PRIVATE if len(groups) == 1 or all(len(g) >= 4 for g in groups) else PLAIN
    return PRIVATE if span.count("(") == span.count(")") and not re.search(r"[ .-]{3}", span) else PLAIN


def _number(kind: int, span: str, **_) -> int:
    """Regex: checksums and lengths."""
    digits = digits_of(span)
    if kind == CARD:
        return PRIVATE if luhn(digits) else PLAIN
    if kind == PHONE:
        return PRIVATE if 8 <= len(digits.lstrip("0")) <= 15 else PLAIN
    return ABSTAIN if kind == EMAIL else PRIVATE if ":" in span or span[0] != "0" else PLAIN


def _listed(kind: int, span: str, **_) -> int:
    """Gazetteer: a known domain, calling code or issuer."""
    digits = digits_of(span).lstrip("0")
    if kind == EMAIL:
        return PRIVATE if re.split(r"[^A-Za-z0-9]+", span)[-1].lower() in DOMAINS else ABSTAIN
    if kind == CARD:
        return PRIVATE if digits.startswith(tuple(ISSUERS)) else PLAIN
    if kind == PHONE:
        return PRIVATE if span[0] == "+" and digits.startswith(tuple(CALLING)) else ABSTAIN
    return ABSTAIN


def _unlisted(kind: int, span: str, **_) -> int:
    """Gazetteer: file names, addresses of no host, numbers of one digit."""
    if kind == EMAIL:
        return PLAIN if re.split(r"[^A-Za-z0-9]+", span)[-1].lower() in FILES else ABSTAIN
    if kind == IP:
        return PLAIN if span.startswith(("0.", "127.", "255.")) else ABSTAIN
    return PLAIN if len(set(digits_of(span)[-7:])) == 1 else ABSTAIN


def _near(kind: int, words: list[str], **_) -> int:
    """Context: a word before the span that goes with its kind."""
    return PRIVATE if any(w in NEAR[kind] for w in words[-3:]) else ABSTAIN


def _against(kind: int, words: list[str], **_) -> int:
    """Context: a word before the span that goes with numbers of other sorts."""
    return PLAIN if any(w in AGAINST for w in words[-3:]) else ABSTAIN


def _loose(kind: int, before: str, after: str, **_) -> int:
    """Context: stands on its own, or within a longer run of letters and digits."""
    return PLAIN if before.isalnum() or after.isalnum() or before in "_/=" and before else PRIVATE


LABELLERS: tuple[Callable[..., int], ...] = (_strict, _form, _number, _listed, _unlisted, _near, _against, _loose)
#: Prior belief about any labeller, as shares of votes (private, plain, abstain) given private and given plain.
BELIEF = np.array([[0.55, 0.03, 0.42], [0.1, 0.4, 0.5]])


def votes(text: str, kind: int, start: int, end: int, base: bool) -> tuple[int, ...]:
    seen = {
        "kind": kind,
        "span": text[start:end],
        "base": base,
        "words": near_words(text, start),
        "before": text[start - 1 : start] if start else "",
        "after": text[end : end + 1],
    }
    return tuple(labeller(**seen) for labeller in LABELLERS)


def pattern_code(cast: tuple[int, ...]) -> int:
    return sum(v * 3**i for i, v in enumerate(cast))


def fit_labellers(patterns: dict[int, int], labellers: int = len(LABELLERS), rounds: int = 200, strength: float = 10.0) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of being private for each vote pattern, and each labeller's votes given private and plain (labeller x class x vote).

    Expectation-maximisation over pattern counts, which stand for all candidates of a kind: at most 3 to the
    number of labellers.  ``BELIEF`` counts as ``strength`` candidates of each class at every size.
    """
    codes = sorted(patterns)
    cast = np.array([[c // 3**i % 3 for i in range(labellers)] for c in codes], np.int64).reshape(len(codes), labellers)
    weight = np.array([patterns[c] for c in codes], np.float64)
    for_, against = (cast == PRIVATE).sum(1), (cast == PLAIN).sum(1)
    private = (for_ + 1) / (for_ + against + 2)
    table = np.repeat(BELIEF[None], labellers, axis=0)
    for _ in range(rounds):
        share = np.stack([private, 1 - private]) * weight
        prior = (share.sum(1) + 1) / (weight.sum() + 2)
        for i in range(labellers):
            for v in range(3):
                table[i, :, v] = share[:, cast[:, i] == v].sum(1) + strength * BELIEF[:, v]
        table /= table.sum(2, keepdims=True)
        logs = np.log(prior)[:, None] + sum(np.log(table[i][:, cast[:, i]]) for i in range(labellers))
        fresh = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))
        if not len(codes) or np.abs(fresh - private).max() < 1e-9:
            break
        private = fresh
    return dict(zip(codes, private.tolist())), table


def features(text: str, kind: int, start: int, end: int, dims: int) -> list[int]:
    """Hashed signs of a span and its surroundings, of its kind: shape, lengths, first and last characters, words before it."""
    span, digits = text[start:end], digits_of(text[start:end])
    shape = re.sub(r"[0-9]+", lambda m: f"0{min(len(m[0]), 9)}", re.sub(r"[A-Za-z]+", "x", span))
    before, after = text[start - 1 : start] if start else "^", text[end : end + 1] or "$"
    around = ["a" if c.isalpha() else "0" if c.isdigit() else c for c in (before, after)]
    signs = [f"shape:{shape[:40]}", f"digits:{len(digits)}", f"first:{digits[:1]}", f"first2:{digits[:2]}", f"before:{around[0]}", f"after:{around[1]}"]
    signs += [f"luhn:{luhn(digits)}"] if kind == CARD else [f"end:{re.split(r'[^A-Za-z0-9]+', span)[-1].lower()[:12]}"] if kind == EMAIL else []
    signs += [f"word:{w[:20]}" for w in set(near_words(text, start)[-3:])]
    return [crc32(f"{KINDS[kind]} {s}".encode()) % dims for s in [*signs, "any"]]


def fit_classifier(rows: list[tuple[list[int], float]], dims: int, rounds: int = 30, rate: float = 0.2) -> np.ndarray:
    """Logistic regression on posterior labels by Adagrad, in the order of the rows."""
    weights, squares = np.zeros(dims), np.full(dims, 1e-6)
    for _ in range(rounds):
        for cells, target in rows:
            at = np.unique(cells)
            slope = 1 / (1 + np.exp(-np.clip(weights[at].sum(), -30, 30))) - target
            squares[at] += slope**2
            weights[at] -= rate * slope / np.sqrt(squares[at])
    return weights


@dataclass(frozen=True)
class Classifier:
    """``labellers``: by kind, each one's votes given private and plain; ``posterior``: by (kind, pattern)."""

    dims: int
    weights: np.ndarray
    posterior: dict[tuple[int, int], float]
    labellers: dict[int, np.ndarray]

    def score(self, text: str, kind: int, start: int, end: int) -> float:
        cells = np.unique(features(text, kind, start, end, self.dims))
        return float(1 / (1 + np.exp(-np.clip(self.weights[cells].sum(), -30, 30))))


def _candidates(docs: DataFrame, text_col: str, dims: int) -> DataFrame:
    """(kind, code, at, cells): every candidate of every whole text; ``at`` is a hash of its document, place and text."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            out: tuple[list, ...] = ([], [], [], [])
            for text in frame.column(0).to_pylist():
                base = base_spans(text)
                for own, spans in ((True, base), (False, more_spans(text, base))):
                    for kind, s, e in spans:
                        cells = features(text, kind, s, e, dims)
                        at = int.from_bytes(sha256(f"{kind} {text[max(0, s - CONTEXT) : e + CONTEXT]}".encode("utf-8", "replace")).digest()[:7])
                        for column, value in zip(out, (kind, pattern_code(votes(text, kind, s, e, own)), at, cells)):
                            column.append(value)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["kind", "code", "at", "cells"])

    return docs.select(text_of(text_col).alias("text")).mapInArrow(run, "kind int, code int, at long, cells array<int>")


def fit(docs: DataFrame, text_col: str = "text", sample: int = 1000, dims: int = 2**16) -> Classifier:
    """Learn the labellers' reliabilities from the votes on every candidate of the corpus, by kind, and the classifier from a sample.

    Votes are counted by pattern on Spark.  Of each kind at most ``sample`` candidates that differ with their
    surroundings train the classifier, drawn by hash, for each way they are taken by EM (private or not): what
    is rare in the corpus is learnt too.  Nothing is labelled by hand.
    """
    found = staged(_candidates(docs, text_col, dims), "private-candidates")
    counted = found.groupBy("kind", "code").agg(F.count(F.lit(1)).alias("n")).collect()
    posterior, tables, drawn = {}, {}, []
    for kind in range(len(KINDS)):
        own, tables[kind] = fit_labellers({r["code"]: r["n"] for r in counted if r["kind"] == kind})
        posterior |= {(kind, code): p for code, p in own.items()}
        for side in (True, False):
            codes = [code for code, p in own.items() if (p >= 0.5) == side]
            if codes:
                some = found.where((F.col("kind") == kind) & F.col("code").isin(codes)).select("at", "code", "cells").distinct()
                drawn += [(r["at"], kind, r["code"], r["cells"]) for r in some.orderBy("at", "code", "cells").limit(sample).collect()]
    rows = [(cells, posterior[kind, code]) for _, kind, code, cells in sorted(drawn)]
    return Classifier(dims, fit_classifier(rows, dims), posterior, tables)


def spans_of(text: str, model: Classifier, least: float) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base): all base spans, and the wider ones that the classifier takes for private."""
    base = base_spans(text)
    more = [x for x in more_spans(text, base) if model.score(text, *x) >= least]
    return sorted([(*x, True) for x in base] + [(*x, False) for x in more])


def _mapped(docs: DataFrame, schema: StructType, row: Callable[[str | None], tuple], text_at: int, passed: list[int]) -> DataFrame:
    """The columns ``passed`` of ``docs`` and what ``row`` makes of the text, row by row."""
    arrow = to_arrow_schema(schema)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            made = list(zip(*map(row, frame.column(text_at).to_pylist()))) or [()] * (len(arrow) - len(passed))
            arrays = [*[frame.column(i) for i in passed], *map(pa.array, made)]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow)

    return docs.mapInArrow(run, schema)


def private_spans(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", least: float = 0.9) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every whole text.

    Counts and digest are of the base spans; ``spans`` has the added ones too, by kind and start, places in
    code points, ends exclusive.  An added span touches no other one and has a score of ``least`` or more.
    Null texts are empty; ids may be null or repeated; other columns are not read.  No shuffle.
    """
    slim = docs.select(F.col(f"`{id_col}`"), text_of(f"`{text_col}`").alias("_text"))
    counts = ", ".join(f"n_{kind} long" for kind in KINDS)
    schema = StructType([slim.schema[0], *StructType.fromDDL(f"{counts}, base_sha256 string, spans string, n_added long").fields])

    def row(text: str) -> tuple:
        found = spans_of(text, model, least)
        shown = [(f"{KINDS[kind]}:{s}:{e}", base) for kind, s, e, base in found]
        numbers = Counter(kind for kind, _, _, base in found if base)
        digest = sha256(",".join(x for x, base in shown if base).encode()).hexdigest()
        return (*[numbers[k] for k in range(len(KINDS))], digest, ",".join(x for x, _ in shown), sum(not base for _, base in shown))

    return _mapped(slim, schema, row, 1, [0])


def without_private(docs: DataFrame, model: Classifier, text_col: str = "text", least: float = 0.9) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; spans that overlap go as one, under the first one's kind.

    All rows and columns stay; null texts stay null.
    """
    at = docs.columns.index(text_col)

    def masked(text: str | None) -> tuple:
        if not text:
            return (text,)
        parts, high = [], 0
        for s, e, kind in sorted((s, e, kind) for kind, s, e, _ in spans_of(text, model, least)):
            if s >= high:
                parts += [text[high:s], f"[{KINDS[kind]}]"]
            high = max(high, e)
        return ("".join([*parts, text[high:]]),)

    numbered = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    others = [i for i in range(len(docs.columns)) if i != at]
    schema = StructType([*[numbered.schema[i] for i in others]]).add(f"_{at}", StringType())
    made = _mapped(numbered, schema, masked, at, others)
    return made.select(*[f"_{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
