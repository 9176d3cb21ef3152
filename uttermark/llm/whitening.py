"""Embedding whitening: exact cross-products from bit planes, centred as integers before the eigenvectors are taken."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from uttermark.llm.common import staged

SCALE = 256
#: A cross-product leaves a task as two numbers, so that sums of either fit a decimal of 38 digits.
LOW_BITS = 60


def whole(vector: Column) -> Column:
    """Each entry ``c`` as the long ``floor(256 * c)``; beyond the range of longs, the nearest one."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))


def usable(vector: Column) -> Column:
    """Neither null nor with an entry that is null or not finite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(finite(c.cast("double")), F.lit(False))), F.lit(False))


def fit_list(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """(x): each distinct vector of longs once; repeats meet before they are shuffled."""
    kept = vectors.where(usable(F.col(f"`{vector_col}`")))
    return kept.select(whole(F.col(f"`{vector_col}`")).alias("x")).groupBy("x").agg(F.lit(1).alias("_one")).select("x")


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Lists of longs as rows of ``dims`` columns, short ones filled up with zeros."""
    lengths = lists.value_lengths().to_numpy()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == dims).all():
        return flat.reshape(len(lists), dims)
    out = np.zeros((len(lists), dims), np.int64)
    out[np.arange(dims)[None] < lengths[:, None]] = flat
    return out


def bit_planes(shifted: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bit planes of all columns (column by column, low bits first) as words of 64 rows each."""
    rows = shifted.shape[0]
    planes = np.concatenate([(shifted[:, d, None] >> np.arange(b, dtype=np.uint64)) & np.uint64(1) for d, b in enumerate(bits)], axis=1)
    packed = np.packbits(planes.astype(np.uint8).T, axis=1)
    words = np.zeros((packed.shape[0], -(-rows // 64) * 8), np.uint8)
    words[:, : packed.shape[1]] = packed
    return words.view(np.uint64)


def and_counts(words: np.ndarray) -> np.ndarray:
    """Rows in which two planes are both set, for every pair (a, b) of planes with a <= b."""
    counts = np.zeros((len(words), len(words)), np.int64)
    for a, plane in enumerate(words):
        counts[a, a:] = np.bitwise_count(words[a:] & plane).sum(1, dtype=np.int64)
    return counts


def cross_products(counts: np.ndarray, bits: list[int]) -> dict[tuple[int, int], int]:
    """(i, j): the sum of products of columns i <= j, as each pair of planes weighs the product of its powers of two."""
    counts = counts + np.triu(counts, 1).T
    ends = np.cumsum([0, *bits])
    found = {}
    for i, p in enumerate(bits):
        for j in range(i, len(bits)):
            block = counts[ends[i] : ends[i + 1], ends[j] : ends[j + 1]]
            diagonals = [int(np.trace(block[:, ::-1], k)) for k in range(bits[j] - 1, -p, -1)]
            found[i, j] = sum(n << k for k, n in enumerate(diagonals))
    return found


@dataclass(frozen=True)
class Whitening:
    """``sums`` are those of the fit list, ``axes`` (dims x components) unit eigenvectors, ``values`` their eigenvalues."""

    dims: int
    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    reach: int
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S`` exactly: as longs where they hold them, else as Python's integers."""
        if self.n * self.reach >= 2**62:
            return x.astype(object) * self.n - np.array(self.sums, object)
        return x * self.n - np.array(self.sums, np.int64)

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        """Sums of squares, exactly; null where a long can't hold it."""
        if centred.dtype != object and self.dims * (self.n * self.reach) ** 2 < 2**62:
            return (centred**2).sum(1).tolist()
        sums = (centred.astype(object) ** 2).sum(1) if self.dims else [0] * len(centred)
        return [int(s) if s < 2**63 else None for s in sums]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / max(self.n, 1)) @ self.axes / np.sqrt(self.values)


def _ranges(fitted: DataFrame) -> tuple[int, int, list[int], list[int]]:
    """Rows, length, and the least and greatest entry of each place (short vectors count as zero there)."""
    shape = fitted.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dims"), F.min(F.size("x")).alias("shortest")).first()
    n, dims = shape["n"], shape["dims"] or 0

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dims, np.iinfo(np.int64).max), np.full(dims, np.iinfo(np.int64).min)
        for frame in frames:
            if frame.num_rows:
                x = matrix(frame.column(0), dims)
                low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(low), pa.array(high)], ["d", "low", "high"])

    found = fitted.mapInArrow(run, "d int, low long, high long").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    rows = sorted(found.collect())
    return n, dims, [r["low"] for r in rows], [r["high"] for r in rows]


def _products(fitted: DataFrame, dims: int, low: list[int], bits: list[int], block: int = 4096) -> tuple[dict, list[int]]:
    """Cross-products and sums of the shifted fit list; a task sends one number for each pair of places.

    A column of ones stands beside the places: its cross-products are the sums.
    """
    shift = np.array([x % 2**64 for x in low], np.uint64)
    wide = [*bits, 1]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((sum(wide), sum(wide)), np.int64)
        for frame in frames:
            for at in range(0, frame.num_rows, block):
                x = matrix(frame.column(0).slice(at, block), dims).view(np.uint64) - shift
                counts += and_counts(bit_planes(np.concatenate([x, np.ones((len(x), 1), np.uint64)], axis=1), wide))
        pairs = cross_products(counts, wide)
        arrays = [
            pa.array([i for i, _ in pairs], pa.int32()),
            pa.array([j for _, j in pairs], pa.int32()),
            pa.array([v >> LOW_BITS for v in pairs.values()], pa.decimal128(38, 0)),
            pa.array([v & (2**LOW_BITS - 1) for v in pairs.values()], pa.decimal128(38, 0)),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["i", "j", "high", "low"])

    made = fitted.mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)")
    rows = made.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    found = {(r["i"], r["j"]): (int(r["high"]) << LOW_BITS) + int(r["low"]) for r in rows}
    return {k: v for k, v in found.items() if k[1] < dims}, [found[d, dims] for d in range(dims)]


def covariance(products: dict[tuple[int, int], int], sums: list[int], n: int) -> np.ndarray:
    """``n`` squared times the covariance, exactly, as integers rounded once to doubles."""
    out = np.zeros((len(sums), len(sums)))
    for (i, j), v in products.items():
        out[i, j] = out[j, i] = float(n * v - sums[i] * sums[j])
    return out


def _identity_error(fitted: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance, measured on its rows, less the identity."""
    k = len(model.values)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for frame in frames:
            if frame.num_rows:
                z = model.whitened(model.centred(matrix(frame.column(0), model.dims)))
                total += z.T @ np.concatenate([z, np.ones((len(z), 1))], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(k * (k + 1)), pa.int32()), pa.array(total.ravel())], ["cell", "v"])

    rows = sorted(fitted.mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect())
    total = np.array([r["v"] for r in rows]).reshape(k, k + 1) / model.n
    means = total[:, k]
    return float(np.abs(total[:, :k] - np.outer(means, means) - np.eye(k)).max())


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = 4) -> Whitening:
    """Whitening of the distinct vectors.  The driver gets one number for each pair of places, whatever the rows.

    A component whose eigenvalue is no more than the rounding of the decomposition has no direction and is
    left out; so vectors that are all equal, and an empty table, have none.
    """
    fitted = staged(fit_list(vectors, vector_col), "whitening-fit")
    n, dims, low, high = _ranges(fitted)
    if not n or not dims:
        return Whitening(dims, n, (0,) * dims, np.zeros((dims, 0)), np.zeros(0), np.zeros(0), 0)
    bits = [(b - a).bit_length() for a, b in zip(low, high)]
    products, shifted = _products(fitted, dims, low, bits)
    scaled = covariance(products, shifted, n) / float(n) ** 2
    values, axes = np.linalg.eigh(scaled)
    values, axes = values[::-1], axes[:, ::-1]
    trace = float(np.trace(scaled))
    kept = min(components, int((values > dims * np.finfo(np.float64).eps * max(values[0], 0)).sum()))
    sums = tuple(s + n * a for s, a in zip(shifted, low))
    reach = max(max(abs(a), abs(b)) for a, b in zip(low, high)) * 2
    model = Whitening(dims, n, sums, axes[:, :kept].copy(), values[:kept].copy(), values[:kept] / trace if trace else values[:kept], reach)
    error = _identity_error(fitted, model) if kept else 0.0
    return Whitening(dims, n, sums, model.axes, model.values, model.explained, reach, error)


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row per usable vector and component.

    Vectors that are null, or hold a null or an entry that is not finite, are dropped.  Short vectors count
    as filled up with zeros.  ``deviation`` is exact, and null where a long can't hold it.  Ids may be null
    or repeated, equal vectors get equal rows, other columns are not read.  One pass without a shuffle.
    """
    slim = vectors.where(usable(F.col(f"`{vector_col}`"))).select(F.col(f"`{id_col}`"), whole(F.col(f"`{vector_col}`")).alias("_x"))
    found = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = StructType([slim.schema[0], *StructType.fromDDL(found).fields])
    arrow = to_arrow_schema(schema)
    k = len(model.values)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            rows = frame.num_rows
            if not rows or not k:
                continue
            centred = model.centred(matrix(frame.column(1), model.dims))
            far = model.deviations(centred)
            each = np.repeat(np.arange(rows), k)
            arrays = [
                frame.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, model.n)),
                pa.array(far, pa.int64()).take(pa.array(each)),
                pa.array(model.whitened(centred).ravel()),
                pa.array(np.tile(model.explained, rows)),
                pa.array(np.full(rows * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow)

    return slim.mapInArrow(run, schema)
