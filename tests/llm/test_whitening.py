"""Whitening against plain integer and double arithmetic."""

import math
import random

import numpy as np
import pytest

from uttermark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, N int"


def vectors(n, dims=6, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        base = rng.gauss(0, 1)
        out.append((i, [float(np.float32(base * (d + 1) / dims + rng.gauss(0, 0.3))) for d in range(dims)], 1))
    return out


def expected(data, k=4):
    kept = [(i, v) for i, v, *_ in data if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(256 * c) for c in v] for _, v in kept]
    fit = sorted({tuple(v) for v in x})
    n, dims = len(fit), len(fit[0])
    sums = [sum(v[d] for v in fit) for d in range(dims)]
    cov = np.array([[float(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in fit)) for j in range(dims)] for i in range(dims)]) / n**3
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    rows = {}
    for (i, _), v in zip(kept, x):
        centred = [n * a - s for a, s in zip(v, sums)]
        rows.setdefault(i, []).append((n, sum(c * c for c in centred), np.array(centred, float) / n @ axes / np.sqrt(values), values / np.trace(cov)))
    return rows


def compare(got, want, k=4):
    assert len(got) == k * sum(map(len, want.values()))
    signs = {}
    for r in got:
        n, far, white, explained = want[r.vec_id][0]
        assert (r.n, r.deviation) == (n, far) and r.identity_error < 1e-9
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs(white[r.component - 1]), rel=1e-7, abs=1e-9)
        if abs(r.whitened) > 1e-6:
            signs.setdefault(r.component, set()).add(np.sign(r.whitened) == np.sign(white[r.component - 1]))
    assert all(len(s) == 1 for s in signs.values())


def test_whitening(rows):
    """Repeats of a third of the rows, null and broken vectors, repeated and null ids, a clashing column."""
    data = vectors(200)
    data += [(500 + i, data[0][1], 1) for i in range(100)]
    data += [(900, None, 1), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (902, [float("nan")] * 6, 1), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0, -0.0], 1)]
    data += [(None, data[3][1], 1), (7, data[7][1], 1), (904, [-0.0] * 6, 1)]
    df = rows(data, SCHEMA)
    compare(whitening.whiten(df, whitening.fit(df)).collect(), expected(data))


@pytest.mark.parametrize("low,high", [(0, 1), (-3, 3), (-(2**40), 2**40), (-(2**62), 2**62), (5, 5)])
def test_cross_products_are_exact(low, high):
    rng = random.Random(high)
    x = np.array([[rng.randint(low, high) for _ in range(5)] for _ in range(131)], np.int64)
    least = x.min(0)
    bits = [int(b - a).bit_length() for a, b in zip(least.tolist(), x.max(0).tolist())]
    shifted = x.view(np.uint64) - least.astype(np.uint64)
    got = whitening.cross_products(whitening.and_counts(whitening.bit_planes(shifted, bits)), bits)
    y = [[a - b for a, b in zip(row, least.tolist())] for row in x.tolist()]
    assert got == {(i, j): sum(r[i] * r[j] for r in y) for i in range(5) for j in range(i, 5)}


def test_large_entries(rows):
    """Deviations are exact beyond doubles, and null beyond longs."""
    data = [(i, v, 1) for i, v, _ in [(0, [1.0, 0.0], 0), (1, [2.0**20, 3.0], 0), (2, [-(2.0**20), 5.0], 0), (3, [0.0, 2.0**10], 0)]]
    df = rows(data, SCHEMA)
    compare(whitening.whiten(df, whitening.fit(df)).collect(), expected(data, 2), 2)
    far = rows([(0, [2.0**60, 0.0], 1), (1, [0.0, 1.0], 1), (2, [3e38, 2.0], 1)], SCHEMA)
    got = whitening.whiten(far, whitening.fit(far)).collect()
    assert got and {r.deviation for r in got} == {None} and all(math.isfinite(r.whitened) for r in got)


def test_short_vectors_count_zeros(rows):
    data = vectors(40, 3)
    full = rows([(i, [*v, 0.0], n) for i, v, n in data] + [(99, [1.0, 2.0, 3.0, 4.0], 1)], SCHEMA)
    short = rows([*data, (99, [1.0, 2.0, 3.0, 4.0], 1)], SCHEMA)
    key = lambda r: (r.vec_id, r.component)
    a, b = (sorted(whitening.whiten(df, whitening.fit(df)).collect(), key=key) for df in (full, short))
    assert [(r.n, r.deviation) for r in a] == [(r.n, r.deviation) for r in b] and len(a) == 4 * 41


def test_no_direction(rows):
    for data in ([], [(1, None, 1)], [(1, [], 1)], [(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1)]):
        df = rows(data, SCHEMA)
        got = whitening.whiten(df, whitening.fit(df))
        assert got.count() == 0 and got.columns[:2] == ["vec_id", "component"]
    line = rows([(i, [float(i), 2.0 * i, 0.0], 1) for i in range(5)], SCHEMA)
    got = whitening.whiten(line, whitening.fit(line)).collect()
    assert {r.component for r in got} == {1} and len(got) == 5
