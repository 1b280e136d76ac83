import math
import random

import numpy as np
import pytest

from spanforge.llm import whiten


def brute(rows, most=8):
    """{(id, deviation): whitened components up to their sign}, eigenvalues, trace: by numpy over all rows at once."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in kept], dtype=np.float64)
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    y = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = y @ vectors[:, :most] / np.sqrt(values[:most])
    return [(i, sum((n * int(a) - s) ** 2 for a, s in zip(r, sums)), w) for (i, _), r, w in zip(kept, x, white)], values


def vectors(n, d, seed=5):
    rng = np.random.default_rng(seed)
    shape = rng.normal(size=(d, d)) * np.geomspace(1, 0.05, d)
    return [(i, [float(c) for c in v]) for i, v in enumerate((rng.normal(size=(n, d)) @ shape / 4).astype(np.float32))]


def test_against_numpy_with_odd_rows_and_clashing_columns(spark):
    rows = vectors(400, 12)
    odd = [(900, None), (901, []), (902, [None] * 12), (903, [float("nan")] + [0.0] * 11), (904, [float("inf")] + [0.0] * 11), (905, [0.0] * 11), (None, rows[3][1]), (7, rows[9][1]), (7, rows[9][1])]
    data = [(i, v, 1, "x", 2, "d") for i, v in rows + odd]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, id int, v string, n int, deviation string").repartition(5)
    got = whiten.whitening_report(df).collect()
    want, values = brute([(i, v) for i, v in rows + odd if v is None or len(v) != 11])
    assert len(got) == 8 * len(want) and {r.n for r in got} == {len(want)}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    shares = {r.component: r.explained for r in got}
    assert np.allclose([shares[k + 1] for k in range(8)], values[:8] / values.sum(), rtol=1e-10)
    found = {}
    for r in got:
        found.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    assert {(i, d) for i, d, _ in want} == set(found)
    signs = np.sign([sum(found[i, d][k + 1][0] * w[k] for i, d, w in want) for k in range(8)])
    for i, d, w in want:
        assert np.allclose([found[i, d][k + 1][0] for k in range(8)], signs * w, atol=1e-8)


def test_jacobi_keeps_small_eigenvalues_accurate():
    rng = np.random.default_rng(2)
    for d in (1, 2, 5, 40):
        basis, _ = np.linalg.qr(rng.normal(size=(d, d)))
        values = np.geomspace(1e6, 1e-4, d)
        matrix = (basis * values) @ basis.T
        found, vectors = whiten.jacobi((matrix + matrix.T) / 2)
        assert np.allclose(found, values, rtol=1e-9, atol=1e-9)
        assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-12) and np.allclose(matrix @ vectors, vectors * found, atol=1e-8)
    graded = np.diag([1e8, 1.0, 1e-8]) + 1e-9 * (np.ones((3, 3)) - np.eye(3))
    assert np.allclose(whiten.jacobi(graded)[0], [1e8, 1.0, 1e-8], rtol=1e-6)


def test_no_rows_no_variance_and_few_dimensions(spark):
    schema = "vec_id long, embedding array<double>"
    assert whiten.whitening_report(spark.createDataFrame([], schema)).collect() == []
    assert whiten.whitening_report(spark.createDataFrame([(1, None), (2, [float("nan")])], schema)).collect() == []
    same = whiten.whitening_report(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], schema)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(2, 0, 0.0, 0.0, 0.0)] * 4
    flat = whiten.whitening_report(spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i]) for i in range(9)], schema)).collect()
    assert len(flat) == 27 and max(r.identity_error for r in flat) < 1e-9 and {r.whitened for r in flat if r.component > 1} == {0.0}


def test_values_that_no_long_holds(spark):
    rows = [(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [3.0, 2.0])]
    got = whiten.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [r.deviation for r in sorted(got, key=lambda r: r.vec_id)][:2] == [None, None] and all(np.isfinite(r.whitened).all() for r in got)


def test_deviation_is_exact():
    x = np.array([[100_000, 99_000], [1 << 40, 5]], dtype=np.int64)
    assert whiten.deviations(x, 3, [300_000, 7]) == [(3 * 99_000 - 7) ** 2, None]
    assert whiten.deviations(x[:1], 2, [2, 1]) == [199_998**2 + 197_999**2]
