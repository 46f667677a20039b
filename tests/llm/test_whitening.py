"""Whitening by spectrum slicing against numpy's eigendecomposition."""

import math

import numpy as np
import pytest

from topicloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute(vectors):
    """(n, sums, eigenvalues, eigenvectors, trace) of the distinct x vectors."""
    x = np.floor(np.array(vectors, dtype=np.float64) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    v = np.cov(fit.T, bias=True)
    w, u = np.linalg.eigh(v)
    return x, fit, w[::-1], u[:, ::-1], np.trace(v)


def sample(seed=3, rows=60, d=6):
    rng = np.random.default_rng(seed)
    scales = np.array([3.0, 2.0, 1.5, 1.0, 0.5, 0.25][:d])
    return (rng.normal(size=(rows, d)) * scales * 0.2).astype(np.float32)


def test_against_numpy_with_odd_rows(spark):
    data = sample()
    rows = [(i, [float(c) for c in v], "x", "y") for i, v in enumerate(data)]
    rows += [(1000, None, None, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0], None, None)]
    rows += [(1002, [float("nan")] * 6, None, None), (1003, [float("inf")] + [0.0] * 5, None, None)]
    rows += [(1004, [0.5, 0.5], None, None)]  # another length: dropped
    rows += [rows[0], (None, rows[1][1], None, None)]  # a repeated row, a null key
    got = whitening.whiten(table(spark, rows)).collect()
    kept = [r for r in rows if r[1] is not None and len(r[1]) == 6 and all(
        c is not None and math.isfinite(c) for c in r[1])]
    x, fit, w, u, trace = brute([r[1] for r in kept])
    assert len(got) == 4 * len(kept)
    mean = fit.mean(axis=0)
    for g in got:
        c = g["component"] - 1
        assert g["n"] == len(fit) == len(data)
        assert g["eigenvalue"] == pytest.approx(w[c], rel=1e-10)
        assert g["explained"] == pytest.approx(w[c] / trace, rel=1e-10)
        assert g["certified"]
        assert g["identity_error"] < 1e-9
    by_key = {}
    for g in got:
        by_key.setdefault((g["vec_id"], g["component"]), set()).add(round(g["whitened"], 9))
    for row, xi in zip(kept, x, strict=True):
        for c in range(4):
            want = (xi - mean) @ u[:, c] / math.sqrt(w[c])
            have = by_key[(row[0], c + 1)]
            assert any(abs(abs(h) - abs(want)) < 1e-9 for h in have)
        dev = int(((len(fit) * xi - fit.sum(axis=0)) ** 2).sum())
        assert dev in {g["deviation"] for g in got if g["vec_id"] == row[0]}


def test_sign_is_fixed_and_equal_rows_count_once(spark):
    data = sample(seed=5)
    rows = [(i, [float(c) for c in v], None, None) for i, v in enumerate(data)]
    once = whitening.whiten(table(spark, rows)).orderBy("vec_id", "component").collect()
    twice = whitening.whiten(table(spark, rows + rows)).orderBy("vec_id", "component").collect()
    assert [r["whitened"] for r in twice[::2]] == pytest.approx([r["whitened"] for r in once], abs=1e-12)
    assert {r["n"] for r in twice} == {len(data)}


def test_repeated_eigenvalue_gives_orthonormal_basis(spark):
    # +-e1, +-e2, +-e3 scaled alike: three equal eigenvalues.
    vectors = []
    for i in range(3):
        for s in (1.0, -1.0):
            v = [0.0, 0.0, 0.0]
            v[i] = s
            vectors.append(v)
    rows = [(i, v, None, None) for i, v in enumerate(vectors)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert {r["component"] for r in got} == {1, 2, 3}
    assert max(r["identity_error"] for r in got) < 1e-9


def test_constant_empty_and_short_tables(spark):
    same = [(i, [0.25, 0.5], None, None) for i in range(5)]
    assert whitening.whiten(table(spark, same)).count() == 0
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, [], None, None)])).count() == 0
    two = [(0, [0.0, 0.0], None, None), (1, [1.0, 0.5], None, None)]
    got = whitening.whiten(table(spark, two)).collect()
    assert len(got) == 2 and {r["component"] for r in got} == {1}
    assert sorted(r["whitened"] for r in got) == pytest.approx([-1.0, 1.0])


def test_inertia_counts():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(9, 9))
    v = a @ a.T
    w = np.linalg.eigvalsh(v)
    for shift in np.linspace(w[0] - 1, w[-1] + 1, 23):
        assert whitening.below(v, shift) == int((w < shift).sum())
