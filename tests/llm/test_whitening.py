import math

import numpy as np
import pytest

from resultloom.llm.bindings import op11_whitening
from resultloom.llm.whitening import clusters, eigen, refine, whiten

TESTDATA = "/root/testdata/sf0.001"


def brute(rows, k=16):
    """{id: list of (component, n, deviation, whitened, explained)} with numpy's own solver."""
    good = [(i, v) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    width = max({len(v) for _, v in good}, key=lambda s: (sum(len(v) == s for _, v in good), s))
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in good if len(v) == width]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = fit - fit.mean(axis=0)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in kept:
        z = (np.array(x) - fit.mean(axis=0)) @ vectors[:, :k] / np.sqrt(values[:k])
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        out += [(i, c + 1, n, deviation, z[c], values[c] / np.trace(cov)) for c in range(min(k, width))]
    return out


def same(got, want):
    """Equal but for the sign of each component."""
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for c in {r[1] for r in got}:
        a, b = [np.array([r[4] for r in rows if r[1] == c]) for rows in (got, want)]
        sign = np.sign((a * b).sum())
        assert np.allclose(a, sign * b, atol=1e-8)
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-10)
    assert len({r[6] for r in got}) == 1 and got[0][6] < 1e-10


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{TESTDATA}/embeddings.parquet").collect()
    same(op11_whitening(spark, TESTDATA).collect(), brute([(r.vec_id, r.embedding) for r in rows]))


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(30)] + [(3, [0.25, 1.0, -2.0])] * 2
    rows += [(40, None), (41, []), (42, [1.0, None, 2.0]), (43, [1.0, float("nan"), 2.0]), (44, [float("inf"), 0.0, 0.0]), (45, [1.0, 2.0])]
    rows += [(None, [0.5, 0.5, 0.5]), (46, rows[0][1]), (47, rows[0][1])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, size int, vector int")
    same(whiten(frame).collect(), brute(rows))
    assert len(whiten(frame, components=2).columns) == 7
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [1.0, 3.0]), (3, [2.0, 2.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id for r in whiten(huge).collect()} == {2, 3, 4}
    # Two vectors have one component with variance, one vector or none has no row.
    assert {r.component for r in whiten(huge.filter("vec_id in (2, 3)")).collect()} == {1}
    assert whiten(huge.filter("vec_id = 2")).collect() == []
    assert whiten(huge.limit(0)).collect() == []


def test_deviation_beyond_int64_is_null(spark):
    frame = spark.createDataFrame([(1, [2.0**40]), (2, [0.0]), (3, [1.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in whiten(frame).collect()}
    assert got[1].deviation is None and got[1].n == 3
    frame = spark.createDataFrame([(1, [2.0**20]), (2, [0.0]), (3, [1.0])], "vec_id long, embedding array<double>")
    xs = [2**26 + 10**6, 10**6, 10**6 + 64]
    assert {r.vec_id: r.deviation for r in whiten(frame).collect()} == {i + 1: (3 * x - sum(xs)) ** 2 for i, x in enumerate(xs)}


def symmetric(values, seed=1):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    return (q * np.array(values)) @ q.T, q


def test_eigen_is_double_precision_where_float32_is_not():
    values = np.linspace(1, 2, 40)
    a, q = symmetric(values)
    got, x = eigen(a)
    assert np.abs(got - values[::-1]).max() < 1e-14 * 40
    assert np.abs(np.abs((x * q[:, ::-1]).sum(axis=0)) - 1).max() < 1e-13
    rough = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1].astype(float)
    assert np.abs(a @ x - x * got).max() < 1e-14 * 40 < np.abs(a @ rough - rough * got).max()


def test_clustered_eigenvalues():
    # Gaps under what float32 can tell apart, equal ones, and a wide rest.
    values = np.sort([1, 1 + 1e-9, 1 + 2e-9, 1 + 1e-6, 2, 2, 2, 5, 5 + 1e-10, 9])
    a, _ = symmetric(values, 2)
    got, x = eigen(a)
    assert np.abs(got - values[::-1]).max() < 1e-13
    assert np.abs(x.T @ x - np.eye(10)).max() < 1e-14
    assert np.abs(a @ x - x * got).max() < 1e-13
    # Without the sub-solves the refining step alone leaves a cluster mixed.
    y = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    found, y, bound = refine(np.asarray(a, np.longdouble), y)
    assert [len(g) for g in clusters(found, bound)] and np.abs(a @ y - y * found).max() > 1e-11
    assert np.array_equal(eigen(np.zeros((3, 3)))[0], np.zeros(3))
