import math
import random

import numpy as np
import pytest

from fleetlens.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, n string, component int"


def symmetric(values, seed):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values),) * 2))[0]
    return q @ np.diag(values) @ q.T


SPECTRA = {
    "spread": [1000.0 / (i + 1) for i in range(40)],
    "close": [10 + 1e-3 * i for i in range(30)],
    "tied": [5.0] * 3 + [4.0] * 12 + [1.0] * 5,
    "all equal": [7.0] * 12,
    "low rank": [9.0, 3.0, 1.0] + [0.0] * 20,
    "steep": [10.0 ** (8 - i) for i in range(12)],
    "one": [2.0], "two": [2.0, 2.0],
}


@pytest.mark.parametrize("name", SPECTRA)
def test_eigenpairs(spark, name):
    values = np.array(sorted(SPECTRA[name], reverse=True))
    matrix = symmetric(values, 3)
    matrix = (matrix + matrix.T) / 2
    found, vectors = w.eigenpairs(spark, matrix, 8)
    want = values[values > 1e-9 * values[0]][:8]
    assert len(found) == len(want)
    assert np.allclose(found, want, rtol=1e-6, atol=1e-13 * values[0])
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-12 * values[0]


def test_inertia_counts():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17):
        a = rng.standard_normal((n, n))
        a = a + a.T
        shifts = np.linspace(-6, 6, 41)
        want = [(np.linalg.eigvalsh(a) > s).sum() for s in shifts]
        assert w.inertia(*w.tridiagonal(a), shifts).tolist() == want
        assert np.allclose(w.leading(*w.tridiagonal(a), n), np.linalg.eigvalsh(a)[::-1])


def test_slices_count_what_they_hold():
    values = np.array(SPECTRA["close"])
    for low, high, count in w.slices(symmetric(values, 1), 8):
        assert count == ((values > low) & (values < high)).sum() > 0


def brute_force(rows):
    """Integer vectors, covariance eigenvalues and exact deviations."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    dev = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    y = np.array([[c - s / n for c, s in zip(v, sums, strict=True)] for v in x])
    return dev, y, y.T @ y / n


def vectors(seed, n, dim):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, dim)) * np.linspace(2, 0.1, dim)).astype(np.float32).tolist()


def test_whole_result(spark):
    rows = vectors(1, 300, 12)
    rows += rows[:30] * 3
    bad = [None, [], [1.0] * 11, [None] + [1.0] * 11, [math.nan] + [1.0] * 11, [math.inf] + [0.0] * 11, [1e30] + [0.0] * 11]
    table = [(i if i % 7 else None, v, "x", 1) for i, v in enumerate(rows)] + [(10_000 + i, v, "x", 1) for i, v in enumerate(bad)]
    random.Random(2).shuffle(table)
    got = w.whiten(spark.createDataFrame(table, SCHEMA).repartition(6)).collect()
    dev, y, cov = brute_force(rows)
    values, directions = np.linalg.eigh(cov)
    values, directions = values[::-1][:8], directions[:, ::-1][:, :8]
    assert len(got) == 8 * len(rows) and {r.component for r in got} == set(range(1, 9))
    assert {r.n for r in got} == {len(rows)} and got[0].identity_error < 1e-10
    for k in range(8):
        mine = [r for r in got if r.component == k + 1]
        assert mine[0].explained == pytest.approx(values[k] / np.trace(cov), rel=1e-10)
        want = y @ directions[:, k] / math.sqrt(values[k])
        by_id = {r.vec_id: r for r in mine if r.vec_id is not None}
        ids = [i for i in range(len(rows)) if i % 7]
        assert [by_id[i].deviation for i in ids] == [dev[i] for i in ids]
        have = np.array([by_id[i].whitened for i in ids])
        sign = np.sign(have @ want[ids])
        assert np.abs(have * sign - want[ids]).max() < 1e-9
        white = np.array([r.whitened for r in mine])
        assert abs(white.mean()) < 1e-10 and white.var() == pytest.approx(1)


def test_deviations_beyond_a_long():
    centre = w.Centre(3, [0, 3])
    far = 2**40
    assert centre.deviations(np.array([[far, 1], [2, 0]])) == [None, (3 * 2) ** 2 + 9]
    centre = w.Centre(1000, [1, 2])
    assert centre.deviations(np.array([[10**6, 5]])) == [(10**9 - 1) ** 2 + 4998**2]


@pytest.mark.parametrize("rows", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, None]])
def test_nothing_to_whiten(spark, rows):
    assert w.whiten(spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(rows)], SCHEMA)).count() == 0


def test_fewer_components_than_asked(spark):
    rows = [(i, [float(i % 5), 2.0 * (i % 5), 7.0], "x", 1) for i in range(40)]
    got = w.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1)
