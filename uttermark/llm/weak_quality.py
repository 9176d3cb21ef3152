"""Quality classifier from weak labels: EM over heuristic labellers, then a hashed linear scorer of their posterior."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttermark.llm import text_stats
from uttermark.llm.common import text_of
from uttermark.llm.line_rules import DIGITS, LOWER, UPPER, worded_lines

GOOD, BAD, ABSTAIN = 0, 1, 2
LABELLERS = ("length", "upper", "symbols", "doubled", "lines", "phrases", "word_size", "endings", "digits")

#: Runs of marks, of those the symbols labeller counts too: shouting and symbol noise both show in them.
DOUBLED = (b"!!", b"??", b"###", b"***", b"$$$", b"%%%", b"&&&", b"|||", b"<<<", b">>>")


def vote(value: float, good: tuple[float, float] | None, bad: tuple[float, float] | None) -> int:
    """GOOD or BAD where ``value`` lies in an interval, ends included, else ABSTAIN."""
    if good and good[0] <= value <= good[1]:
        return GOOD
    return BAD if bad and bad[0] <= value <= bad[1] else ABSTAIN


def ratios(raw: bytes, words: list[bytes]) -> tuple[float, ...]:
    """What the labellers look at, in their order."""
    lines, n = worded_lines(raw), max(len(words), 1)
    upper, lower = len(raw.translate(None, UPPER)), len(raw.translate(None, LOWER))
    size = max(text_stats.word_chars(raw), 1)
    ends = sum(line.rstrip().endswith((b".", b"!", b"?", b":", b'"')) for line in lines)
    return (
        float(len(words)),
        upper / max(upper + lower, 1),
        text_stats.symbols(raw) / n,
        sum(map(raw.count, DOUBLED)) / n,
        text_stats.repeated_lines(lines) / max(len(lines), 1),
        text_stats.repeated_words(words) / n,
        size / n,
        ends / max(len(lines), 1),
        len(raw.translate(None, DIGITS)) / size,
    )


#: By labeller: where it votes good, and where bad.  Most only tell bad signs and abstain without them.
RANGES = (
    ((40, np.inf), (0, 0)),
    (None, (0.5, 1)),
    (None, (0.25, np.inf)),
    (None, (0.2, np.inf)),
    (None, (0.4, 1)),
    (None, (0.5, 1)),
    ((3, 9), (14, np.inf)),
    ((0.7, 1), None),
    (None, (0.3, 1)),
)
#: Prior belief about any labeller, as shares of votes (good, bad, abstain) given good and given bad quality.
BELIEF = np.array([[0.4, 0.005, 0.595], [0.3, 0.3, 0.4]])


def votes(values: tuple[float, ...]) -> tuple[int, ...]:
    return tuple(vote(x, good, bad) for x, (good, bad) in zip(values, RANGES))


def pattern_code(votes_: tuple[int, ...]) -> int:
    return sum(v * 3**i for i, v in enumerate(votes_))


def fit_labellers(patterns: dict[int, int], rounds: int = 100, strength: float = 10.0) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of good quality for each vote pattern, and what each labeller votes given good and bad (labeller x class x vote).

    Expectation-maximisation over pattern counts, which stand for all rows: at most 3**9 of them.  All three
    votes enter the posterior, an abstention by its own rate: what is left out of the likelihood cannot be
    estimated.  ``BELIEF`` counts as ``strength`` rows of each class, whatever the size of the corpus; it
    decides for labellers that hardly vote, and the start takes every vote for bad at its word.
    """
    codes = sorted(patterns)
    n = len(LABELLERS)
    cast = np.array([[code // 3**i % 3 for i in range(n)] for code in codes], np.int64).reshape(len(codes), n)
    weight = np.array([patterns[c] for c in codes], np.float64)
    good = np.where((cast == BAD).any(1), 0.1, 0.9)
    table = np.repeat(BELIEF[None], n, axis=0)
    for _ in range(rounds):
        share = np.stack([good, 1 - good]) * weight
        prior = np.clip((share.sum(1) + 1) / (weight.sum() + 2), 0.01, 0.99)
        for i in range(n):
            for v in range(3):
                table[i, :, v] = share[:, cast[:, i] == v].sum(1) + strength * BELIEF[:, v]
        table /= table.sum(2, keepdims=True)
        logs = np.log(prior)[:, None] + sum(np.log(table[i][:, cast[:, i]]) for i in range(n))
        fresh = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))
        if len(codes) == 0 or np.abs(fresh - good).max() < 1e-9:
            break
        good = fresh
    return dict(zip(codes, good.tolist())), table


class Features:
    """Hashed features of a text: the shapes and endings of its words, and its ratios in steps; square roots of shares."""

    def __init__(self, dims: int = 2**16):
        self.dims, self.known = dims, {}

    def _word(self, word: bytes) -> tuple[int, int]:
        shape, last = [], ""
        for c in word.decode("utf-8", "replace"):
            kind = "X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c
            if kind != last or not kind.isalnum():
                shape.append(kind)
            last = kind
        return crc32("".join(shape).encode()) % self.dims, crc32(b"e" + word[-3:]) % self.dims

    def __call__(self, words: list[bytes], values: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
        known, n, times = self.known, max(len(words), 1), Counter(words)
        if len(known) >= 300_000:
            known.clear()
        cells = []
        for word in times:
            pair = known.get(word)
            if pair is None:
                pair = known[word] = self._word(word)
            cells += pair
        weights = np.repeat(np.fromiter(times.values(), np.float64, len(times)), 2)
        for i, value in enumerate(values):
            step = min(int(4 * np.log2(1 + value)) if i == 0 else int(10 * min(value, 20.0)), 200)
            cells.append(crc32(f"{LABELLERS[i]}:{step}".encode()) % self.dims)
        cells, where = np.unique(np.array(cells, np.int64), return_inverse=True)
        return cells, np.sqrt(np.bincount(where, np.append(weights, np.full(len(values), n))) / n)


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], dims: int, rounds: int = 8, rate: float = 0.3) -> np.ndarray:
    """Logistic regression on posterior labels by Adagrad, in the order of the rows; the last weight is the bias."""
    weights, squares = np.zeros(dims + 1), np.full(dims + 1, 1e-6)
    for _ in range(rounds):
        for cells, values, target in rows:
            at, x = np.append(cells, dims), np.append(values, 1.0)
            slope = (1 / (1 + np.exp(-np.clip(weights[at] @ x, -30, 30))) - target) * x
            squares[at] += slope**2
            weights[at] -= rate * slope / np.sqrt(squares[at])
    return weights


@dataclass(frozen=True)
class Scorer:
    dims: int
    weights: np.ndarray
    posterior: dict[int, float]
    labellers: np.ndarray


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).cast("binary").alias("text"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 4000, dims: int = 2**16) -> Scorer:
    """Learn the labellers from the votes on every row, and the scorer from at most ``sample`` rows drawn by the hash of their id.

    Votes are counted by pattern before they leave a task.  No label table is read.
    """

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times: Counter = Counter()
            for t in batch.column(1):
                raw = t.as_buffer().to_pybytes()
                times[pattern_code(votes(ratios(raw, raw.split())))] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(times), pa.int64()), pa.array(list(times.values()), pa.int64())], ["code", "n"])

    slim = _slim(docs, id_col, text_col)
    counted = slim.mapInArrow(cast, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    posterior, table = fit_labellers({r["code"]: r["n"] for r in counted})
    total = sum(r["n"] for r in counted)
    at = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(13)), F.lit(2**30))
    share = int(min(1.0, (1.2 * sample + 100) / max(total, 1)) * 2**30)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(dims)
        for batch in batches:
            codes, cells, values = [], [], []
            for t in batch.column(1):
                raw = t.as_buffer().to_pybytes()
                words = raw.split()
                seen = ratios(raw, words)
                codes.append(pattern_code(votes(seen)))
                c, v = features(words, seen)
                cells.append(c.astype(np.int32).tobytes())
                values.append(v.astype(np.float32).tobytes())
            columns = [batch.column(0), pa.array(codes, pa.int64()), pa.array(cells, pa.binary()), pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["at", "code", "cells", "vals"])

    drawn = slim.select(at.alias("at"), "text").where(F.col("at") < share)
    taken = drawn.mapInArrow(describe, "at long, code long, cells binary, vals binary").orderBy("at", "code", "cells").limit(sample).collect()
    rows = [
        (np.frombuffer(r["cells"], np.int32).astype(np.int64), np.frombuffer(r["vals"], np.float32).astype(np.float64), posterior[r["code"]])
        for r in taken
    ]
    return Scorer(dims, fit_scorer(rows, dims), posterior, table)


def quality_scores(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, n_good, n_bad, weak_label, score, kept) of every whole text.

    ``weak_label``: posterior of good quality given the votes (a pattern not met in fitting: the score);
    ``score``: the linear scorer's probability; kept with ``least`` or more.  Null texts are empty ones,
    which get the votes and the score of an empty text.  One row per row, without a shuffle; ids may be null
    or repeated, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(scorer.dims)
        for batch in batches:
            good, bad, weak, scores = [], [], [], []
            for t in batch.column(1):
                raw = t.as_buffer().to_pybytes()
                words = raw.split()
                seen = ratios(raw, words)
                cells, values = features(words, seen)
                cast = votes(seen)
                score = float(1 / (1 + np.exp(-np.clip(scorer.weights[cells] @ values + scorer.weights[-1], -30, 30))))
                good.append(cast.count(GOOD))
                bad.append(cast.count(BAD))
                weak.append(scorer.posterior.get(pattern_code(cast), score))
                scores.append(score)
            columns = [pa.array(good, pa.int64()), pa.array(bad, pa.int64()), pa.array(weak, pa.float64()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_good", "n_bad", "weak_label", "score"])

    slim = _slim(docs, id_col, text_col)
    kind = slim.schema["doc_id"].dataType.simpleString()
    scored = slim.mapInArrow(run, f"doc_id {kind}, n_good long, n_bad long, weak_label double, score double")
    return scored.withColumn("kept", F.col("score") >= least).withColumnRenamed("doc_id", id_col)
