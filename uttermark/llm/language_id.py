"""Language identification with blended-spectrum presence kernels, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters, and numerals that are no decimal digits.
_LETTER_OR_NUMERAL = re.compile(r"[^\W\d_]")
DIGIT = re.compile(r"\d")
NONE = "und"
#: Cells of the n-grams that tell whether a text is in a language at all: so many that unlike n-grams seldom share one.
FINE = 2**18


def has_letter(text: str) -> bool:
    """A character of a Unicode category of letters is in the text; numerals such as a half or a Roman one are none."""
    return any(m[0].isalpha() for m in _LETTER_OR_NUMERAL.finditer(text))


@dataclass(frozen=True)
class Kernel:
    """k(s, t) = |S & T| / sqrt(|S| |T|), S and T the hashed character n-grams of ``orders`` present in two windows."""

    orders: tuple[int, ...] = (1, 2, 3, 4)
    dims: int = 2**14
    window: int = 1000

    def windows(self, length: int) -> int:
        return max(1, length // self.window)

    def cells(self, text: str) -> tuple[int, np.ndarray]:
        """Number of windows, and window * dims + cell of every n-gram, repeats included; a short rest joins the last window."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        count, shift = self.windows(len(codes)), np.uint64(65 - self.dims.bit_length())
        found = []
        for order in self.orders:
            n = len(codes) - order + 1
            if n <= 0:
                break
            mixed = codes[:n] + np.uint64(order << 24)
            for k in range(1, order):
                mixed = mixed * np.uint64(0x100000001B3) + codes[k : k + n]
            place = ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
            found.append(np.minimum(np.arange(n) // self.window, count - 1) * self.dims + place)
        return count, np.concatenate(found) if found else np.zeros(0, np.int64)

    def presence(self, count: int, cells: np.ndarray) -> np.ndarray:
        rows = np.zeros((count, self.dims), np.float32)
        rows.ravel()[cells] = 1
        return rows


@dataclass(frozen=True)
class Model:
    """``weights``: dims x languages.  The landmarks' rows times their ridge weights, since the kernel is linear in the presence row."""

    kernel: Kernel
    languages: tuple[str, ...]
    weights: np.ndarray
    #: Which of the ``FINE`` cells hold known n-grams; and by language, what share of known ones a text has at least.
    known: np.ndarray | None = None
    floors: np.ndarray | None = None

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """One-versus-rest outputs of presence rows, -1 to 1 in the main, by one matrix product."""
        out = rows @ self.weights
        return out[:, :-1] / np.sqrt(np.maximum(out[:, -1:], 1))


def unit_rows(kernel: Kernel, rows: Sequence[np.ndarray | bytes]) -> np.ndarray:
    """Presence rows, some of them as bits, scaled to length 1."""
    unit = np.empty((len(rows), kernel.dims), np.float32)
    for own, row in zip(unit, rows):
        own[:] = row if isinstance(row, np.ndarray) else np.unpackbits(np.frombuffer(row, np.uint8))[: kernel.dims]
    unit /= np.sqrt(np.maximum(unit.sum(1, keepdims=True), 1))
    return unit


def fit_rows(kernel: Kernel, rows: Sequence[np.ndarray | bytes], langs: list[str], landmarks: int, ridge: float, block: int = 256) -> Model:
    """Kernel ridge regression in the span of the landmarks: the first ``landmarks`` rows, dealt over the languages in turn.

    ``rows`` are presence rows or their bits; besides the landmarks only ``block`` of them are spread out at once.
    """
    languages = tuple(sorted(set(langs)))
    turn: dict[str, int] = {}
    rank = []
    for i, lang in enumerate(langs):
        turn[lang] = turn.get(lang, 0) + 1
        rank.append((turn[lang], lang, i))
    chosen = [i for _, _, i in sorted(rank)[:landmarks]]
    marks = unit_rows(kernel, [rows[i] for i in chosen])
    near = np.concatenate([unit_rows(kernel, rows[at : at + block]) @ marks.T for at in range(0, len(rows), block)]).astype(np.float64)
    own = near[chosen]
    targets = np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    share = 1.0 / np.maximum((targets > 0).sum(0), 1)
    weight = share[np.array([languages.index(x) for x in langs])]
    weight *= len(langs) / weight.sum()
    weighted = near * weight[:, None]
    alpha = np.linalg.solve(near.T @ weighted + ridge * own + 1e-6 * np.eye(len(chosen)), weighted.T @ targets)
    flat = marks.T @ alpha.astype(np.float32)
    return Model(kernel, languages, np.hstack([flat, np.ones((kernel.dims, 1), np.float32)]).astype(np.float32))


def spoken(text: str) -> str:
    """The words without a digit: keys and numbers are in no language.  The whole text if those hold no letter."""
    words = " ".join(word for word in text.split() if not DIGIT.search(word))
    return words if has_letter(words) else text


def calibrated(model: Model, windows: list[tuple[str, np.ndarray, np.ndarray]], rate: float = 0.01, lost: float = 0.005) -> Model:
    """The model with the n-grams it knows and a floor per language, from (language, cells, times) of learnt windows.

    An n-gram is known if a ``rate`` of the windows of any language hold it: a text may mix languages.  Each
    window is measured twice as if it had not been learnt: without itself (a clean text), and by the other
    languages only (a text in an unlearnt one).  The floor lies midway between the medians of the two, but no
    higher than lets all but ``lost`` of the clean windows of its language pass.
    """
    at = {lang: i for i, lang in enumerate(model.languages)}
    counts, rows = np.zeros((len(at), FINE), np.int32), np.zeros(len(at), np.int64)
    for lang, cells, _ in windows:
        counts[at[lang], cells] += 1
        rows[at[lang]] += 1
    need = np.maximum(1, np.ceil(rate * rows)).astype(np.int64)
    holders = (counts >= need[:, None]).sum(0)
    clean: dict[str, list[float]] = {lang: [] for lang in at}
    foreign = []
    for lang, cells, times in windows:
        total = times.sum()
        if total:
            own = counts[at[lang], cells]
            others = holders[cells] > (own >= need[at[lang]])
            foreign.append(times[others].sum() / total)
            clean[lang].append(times[others | (own > need[at[lang]])].sum() / total)
    if not foreign:
        return replace(model, known=holders > 0, floors=np.zeros(len(at)))
    middle = (np.median(foreign) + np.median(np.concatenate(list(clean.values())))) / 2
    floors = [min(middle, np.quantile(some, lost)) if some else middle for some in clean.values()]
    return replace(model, known=holders > 0, floors=np.array(floors))


def is_claimed(text: str, lang: str, model: Model, block: int = 128_000) -> bool:
    """Whether enough of the n-grams of the whole text, repeats included, are known for its winner ``lang``.

    The floor is lower by two standard deviations of the share in a text of so many characters: a clean word
    may hold a rare n-gram.
    """
    if model.known is None:
        return True
    fine, found, total, text = replace(model.kernel, dims=FINE), 0, 0, spoken(text)
    for start in range(0, len(text), block):
        _, cells = fine.cells(text[start : start + block])
        found += np.count_nonzero(model.known[cells % FINE])
        total += len(cells)
    floor = model.floors[model.languages.index(lang)]
    return found / total >= floor - 2 * np.sqrt(floor * (1 - floor) / len(text))


def held_out(id_col: str) -> Column:
    """Rows never learnt from: CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = 2000,
    landmarks: int = 300,
    ridge: float = 0.3,
    kernel: Kernel = Kernel(),
) -> Model | None:
    """Learn from at most ``sample`` labelled rows that are not held out, as many of each language as there are.

    The sample is drawn by the hash of the id; of each drawn text one window, chosen by its own checksum,
    comes to the driver as a bit row of ``dims`` / 8 bytes and as its counted n-grams, six bytes each.  None if
    no row bears a label.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    counts = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    each = max(1, sample // len(counts))
    order = F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(2**30))
    limit = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 2 * each / n + 20 / n) * 2**30))])
    drawn = known.select(F.col(lang_col).alias("lang"), order.alias("at"), F.col(text_col).alias("text"))
    drawn = drawn.where(F.col("at") < limit[F.col("lang")])
    fine = replace(kernel, dims=FINE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, seen, often = [], [], []
            for text in batch.column(2).to_pylist():
                start = crc32(text.encode("utf-8", "surrogatepass")) % kernel.windows(len(text)) * kernel.window
                window = text[start : start + kernel.window]
                _, cells = kernel.cells(window)
                bits.append(np.packbits(kernel.presence(1, cells % kernel.dims)[0] > 0).tobytes())
                places, times = np.unique(fine.cells(spoken(window))[1] % FINE, return_counts=True)
                times = np.minimum(times, 2**16 - 1) if has_letter(window) else 0 * times
                seen.append(places.astype(np.int32).tobytes())
                often.append(times.astype(np.uint16).tobytes())
            more = [pa.array(x, pa.binary()) for x in (bits, seen, often)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *more], ["lang", "at", "bits", "cells", "times"])

    rows = drawn.mapInArrow(run, "lang string, at long, bits binary, cells binary, times binary")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("at", "bits", "cells", "times"))
    ranked = rows.withColumn("rank", first).where(F.col("rank") <= each).orderBy("lang", "rank")
    taken = ranked.select("lang", "bits", "cells", "times").collect()
    model = fit_rows(kernel, [r["bits"] for r in taken], [r["lang"] for r in taken], landmarks, ridge)
    windows = [(r["lang"], np.frombuffer(r["cells"], np.int32), np.frombuffer(r["times"], np.uint16).astype(np.float64)) for r in taken]
    return calibrated(model, windows)


def predict(texts: list[str | None], model: Model | None, most: int = 128) -> list[tuple[str, float]]:
    """(language, score) of whole texts: the mean output over all windows; score is the winner's, scaled to 0..1."""
    done: list[tuple[str, float]] = [(NONE, 0.0)] * len(texts)
    if model is None:
        return done
    kernel, sums = model.kernel, {}
    pending: list[tuple[int, int, np.ndarray]] = []
    held = 0

    def flush() -> None:
        nonlocal pending, held
        if not pending:
            return
        starts = np.cumsum([0] + [count for _, count, _ in pending])
        flat = np.concatenate([cells + at * kernel.dims for (_, _, cells), at in zip(pending, starts)])
        out = model.scores(kernel.presence(int(starts[-1]), flat))
        for (i, count, _), total in zip(pending, np.add.reduceat(out, starts[:-1], axis=0)):
            so_far, windows = sums.get(i, (0, 0))
            sums[i] = (so_far + total, windows + count)
        pending, held = [], 0

    for i, text in enumerate(texts):
        if text is None or not has_letter(text):
            continue
        block = most * kernel.window
        for at in range(0, len(text), block):
            count, cells = kernel.cells(text[at : at + block])
            pending.append((i, count, cells))
            held += count
            if held >= most:
                flush()
    flush()
    for i, (total, windows) in sums.items():
        mean = total / windows
        best = int(mean.argmax())
        done[i] = (model.languages[best], float(np.clip((mean[best] + 1) / 2, 0.0, 1.0)))
    return done


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text, one row per row.

    ``und`` with score 0 where the text is null, empty or without a letter, and everywhere if there is no
    model.  Only the text decides; equal texts get equal answers, repeated ids and other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = predict(part.column(2).to_pylist(), model)
                columns = [part.column(0), part.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    slim = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("doc_id", id_col)


def in_known_language(docs: DataFrame, model: Model | None, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text is in a learnt language: not ``und``, and enough known n-grams (see ``is_claimed``).

    The scores hardly tell: outputs go to 0 for what was never learnt, which is a score of a half.  ``least``
    is a lower bound of the winner's score besides.  Rows pass through in place, with all columns; without a
    model all rows with a letter stay.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(place).to_pylist()
                if model is None:
                    keep = [text is not None and has_letter(text) for text in texts]
                else:
                    got = predict(texts, model)
                    keep = [lang != NONE and score >= least and is_claimed(text, lang, model) for text, (lang, score) in zip(texts, got)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
