"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttermark.llm import text_stats
from uttermark.llm.common import text_of

CONTENT, BOILERPLATE = 0, 1
NOTICE = re.compile(rb"(?i)licen[sc]e|copyright|rights reserved|cookie|subscribe|terms of|privacy policy|\xc2\xa9")
UPPER, LOWER, DIGITS = (bytes(c for c in range(256) if c not in keep) for keep in (range(65, 91), range(97, 123), range(48, 58)))
SIGNS = ("always", "few_words", "many_words", "sentence_end", "symbols", "upper", "digits", "seen_before", "doubled_marks", "notice", "edge")


def line_signs(lines: list[bytes]) -> np.ndarray:
    """The signs of each line, 0 or 1, in the order of ``SIGNS``."""
    out, seen = np.zeros((len(lines), len(SIGNS)), np.float64), set()
    out[:, 0] = 1
    for i, line in enumerate(lines):
        words, row, key = line.split(), out[i], line.strip()
        upper, lower = len(line.translate(None, UPPER)), len(line.translate(None, LOWER))
        row[1] = len(words) < 4
        row[2] = len(words) > 8
        row[3] = key.endswith((b".", b"!", b"?", b":", b";", b'"'))
        row[4] = 20 * text_stats.symbols(line) > len(key)
        row[5] = upper > lower
        row[6] = 4 * len(line.translate(None, DIGITS)) > len(key)
        row[7] = key in seen
        row[8] = 3 * (line.count(b"!!") + line.count(b"??")) > len(words)
        row[9] = NOTICE.search(line) is not None
        row[10] = i in (0, len(lines) - 1)
        seen.add(key)
    return out


def seeds(signs: np.ndarray) -> np.ndarray:
    """Lines whose label is taken as known: boilerplate (1) with a telling sign, content (0) that reads like prose, else -1.

    A repeated line, a notice, shouting or symbols tell; prose is many words up to a sentence end and none
    of those signs.  All other lines are left to the model.
    """
    telling = signs[:, [4, 7, 8, 9]].sum(1) + signs[:, 5] * signs[:, 8]
    prose = (signs[:, 2] > 0) & (signs[:, 3] > 0) & (signs[:, 4:10].sum(1) == 0)
    return np.where(telling > 0, BOILERPLATE, np.where(prose, CONTENT, -1))


@dataclass(frozen=True)
class Chain:
    """``emit``: signs x 2 scores, ``step``: 2 x 2 scores of a label after another, ``start``: of the first label."""

    emit: np.ndarray
    step: np.ndarray
    start: np.ndarray

    def decode(self, signs: np.ndarray) -> np.ndarray:
        """The most probable labels (Viterbi); content wins ties."""
        if not len(signs):
            return np.zeros(0, np.int64)
        scores = (signs @ self.emit).tolist()
        (cc, cb), (bc, bb) = self.step.tolist()
        c, b = (x + y for x, y in zip(self.start.tolist(), scores[0]))
        back = []
        for to_c, to_b in scores[1:]:
            back.append((CONTENT if c + cc >= b + bc else BOILERPLATE, CONTENT if c + cb >= b + bb else BOILERPLATE))
            c, b = max(c + cc, b + bc) + to_c, max(c + cb, b + bb) + to_b
        labels = [CONTENT if c >= b else BOILERPLATE]
        for choice in reversed(back):
            labels.append(choice[labels[-1]])
        return np.array(labels[::-1])


def _expected(scores: np.ndarray, there: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label and step expectations of padded sequences (texts x lines x 2) by forward-backward in log space."""
    texts, lines, _ = scores.shape
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = start + scores[:, 0]
    for i in range(1, lines):
        new = np.logaddexp(ahead[:, i - 1, :1] + step[0], ahead[:, i - 1, 1:] + step[1]) + scores[:, i]
        ahead[:, i] = np.where(there[:, i, None], new, ahead[:, i - 1])
    for i in range(lines - 2, -1, -1):
        onward = behind[:, i + 1] + scores[:, i + 1]
        new = np.logaddexp(onward[:, :1] + step[:, 0], onward[:, 1:] + step[:, 1])
        behind[:, i] = np.where(there[:, i + 1, None], new, behind[:, i])
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])[:, None, None]
    labels = np.exp(ahead + behind - total) * there[:, :, None]
    pairs = ahead[:, :-1, :, None] + step + (scores + behind)[:, 1:, None, :] - total[..., None]
    return labels, (np.exp(pairs) * there[:, 1:, None, None]).sum((0, 1))


def fit_chain(texts: list[np.ndarray], rounds: int = 200, rate: float = 0.1, shrink: float = 1e-3) -> Chain:
    """Maximum likelihood of the seeds, the other labels summed out: gradient ascent with Adam from zero, no chance involved."""
    size = len(SIGNS)
    texts = [t for t in texts if len(t)]
    theta = np.zeros(2 * size + 6)
    if not texts:
        return Chain(np.zeros((size, 2)), np.zeros((2, 2)), np.zeros(2))
    most = max(map(len, texts))
    signs, there, fixed = np.zeros((len(texts), most, size)), np.zeros((len(texts), most), bool), np.zeros((len(texts), most, 2))
    for i, t in enumerate(texts):
        signs[i, : len(t)], there[i, : len(t)] = t, True
        known = seeds(t)
        fixed[i, : len(t)] = np.where((known[:, None] >= 0) & (known[:, None] != np.arange(2)), -1e3, 0.0)
    # A window out of the middle of a text says nothing about first labels; the first line of a text is an edge.
    begins = signs[:, 0, SIGNS.index("edge"), None]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        emit, step, start = theta[: 2 * size].reshape(size, 2), theta[2 * size : -2].reshape(2, 2), theta[-2:]
        scores, own_start = signs @ emit, begins * start
        given, given_steps = _expected(scores + fixed, there, step, own_start)
        free, free_steps = _expected(scores, there, step, own_start)
        slope = np.concatenate(
            [np.einsum("tls,tlk->sk", signs, given - free).ravel(), (given_steps - free_steps).ravel(), ((given - free)[:, 0] * begins).sum(0)]
        )
        slope = slope / len(texts) - shrink * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Chain(theta[: 2 * size].reshape(size, 2), theta[2 * size : -2].reshape(2, 2), theta[-2:])


def worded_lines(raw: bytes) -> list[bytes]:
    return [line for line in raw.split(b"\n") if line.strip()]


def window_signs(raw: bytes, lines: int) -> np.ndarray:
    """The signs of ``lines`` lines in a row, of all lines if there are no more."""
    signs = line_signs(worded_lines(raw))
    start = crc32(raw) % max(len(signs) - lines + 1, 1)
    return signs[start : start + lines]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 1000, lines: int = 32) -> Chain:
    """Fit the chain to at most ``sample`` texts, drawn by the hash of their id, and a window of ``lines`` lines of each.

    The signs are those of the lines in the whole text; the window lies where a hash of the text says, beginning
    and end being as likely as any other place.  What comes to the driver is ``sample`` x ``lines`` rows of eleven
    bits at the utmost.
    """
    total = docs.count()
    share = min(1.0, (2 * sample + 50) / max(total, 1))
    at = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(2**30))
    drawn = docs.select(at.alias("at"), text_of(text_col).cast("binary").alias("text")).where(F.col("at") < int(share * 2**30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(window_signs(t, lines) > 0, axis=1).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["at", "bits"])

    rows = drawn.mapInArrow(run, "at long, bits binary").orderBy("at", "bits").limit(sample).collect()
    wide = -(-len(SIGNS) // 8)
    return fit_chain([np.unpackbits(np.frombuffer(r["bits"], np.uint8).reshape(-1, wide), axis=1)[:, : len(SIGNS)].astype(np.float64) for r in rows])


def judge(raw: bytes, chain: Chain, least: float) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept)."""
    words, lines = raw.split(), worded_lines(raw)
    repeats = text_stats.repeated_words(words)
    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    labels = chain.decode(line_signs(lines))
    content = sum(len(line.split()) for line, label in zip(lines, labels) if label == CONTENT)
    share = content / len(words) if words else 0.0
    counts = (len(words), text_stats.word_chars(raw), text_stats.symbols(raw), text_stats.repeated_lines(lines), repeats)
    return (*counts, failed, share, not failed and share >= least)


def quality_rules(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The base counts of every whole text, the share of its words in content lines and whether it is kept.

    A text that fails a base rule is not kept; any other is if ``least`` of its words or more lie in lines
    that the chain labels content.  Null texts are empty ones: no words, failed.  One row comes back per row,
    without a shuffle; ids may be null or repeated, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t.as_buffer().to_pybytes(), chain, least) for t in batch.column(1)]
            columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(FIELDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *[name for name, _ in FIELDS]])

    slim = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    kinds = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}
    schema = ", ".join([f"doc_id {slim.schema['doc_id'].dataType.simpleString()}", *[f"{name} {kinds[kind]}" for name, kind in FIELDS]])
    return slim.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)


FIELDS = [
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()),
    ("content_share", pa.float64()),
    ("kept", pa.bool_()),
]
