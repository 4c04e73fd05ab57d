"""Whitening against numpy's solver and exact sums; odd vectors, wide deviations, clashing names, empty tables."""

import random

import numpy as np
import pytest

from foliant.llm import whitening

KIND = "vec_id long, embedding array<float>"


def made(n, d, seed=1):
    random.seed(seed)
    base = [[random.gauss(0, 1) for _ in range(d)] for _ in range(d)]
    rows = []
    for i in range(n):
        z = [random.gauss(0, 1) / (j + 1) for j in range(d)]
        rows.append((i, [float(np.float32(sum(a * b for a, b in zip(z, col, strict=True)))) for col in base]))
    return rows


def held(rows, out):
    """The result of a table against whole-number sums and numpy's eigen-solver."""
    xs = np.array([[int(np.floor(1024 * c)) + 100000 for c in v] for _, v in rows], dtype=object)
    n, d = xs.shape
    off = xs * n - xs.sum(axis=0)
    v = (off.T @ off).astype(float) / float(n) ** 3
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(8, d)
    w = (off.astype(float) / n) @ vectors[:, :k] / np.sqrt(values[:k])
    got = {}
    for r in out.collect():
        got.setdefault(r.vec_id, []).append(r)
    assert sorted(got) == sorted(i for i, _ in rows)
    signs = None
    for (i, _), o, each in zip(rows, off, w, strict=True):
        mine = sorted(got[i], key=lambda r: r.component)
        assert [r.component for r in mine] == list(range(1, k + 1)) and {r.n for r in mine} == {n}
        assert {r.deviation if r.deviation is not None else int(r.deviation_wide) for r in mine} == {int((o * o).sum())}
        signs = np.sign([r.whitened * x for r, x in zip(mine, each, strict=True)]) if signs is None else signs
        assert np.allclose([r.whitened for r in mine], each * signs, rtol=1e-7, atol=1e-9)
        assert np.allclose([r.explained for r in mine], values[:k] / values.sum(), rtol=1e-9)
        assert mine[0].identity_error < 1e-9
    return got


def test_against_numpy(spark):
    rows = made(400, 12)
    held(rows, whitening.whitening_query(spark.createDataFrame(rows, KIND).repartition(70)))


def test_few_dimensions_and_wide_deviations(spark):
    rows = [(i, [float(v[0] * 3e8), float(np.float32(v[1]))]) for i, v in made(60, 2)]
    rows = [(i, [float(np.float32(a)), b]) for i, (a, b) in rows]
    got = held(rows, whitening.whitening_query(spark.createDataFrame(rows, KIND)))
    assert any(r.deviation is None for each in got.values() for r in each)


def test_odd_vectors(spark):
    rows = made(50, 3)
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0]), (None, [0.5, 0.25, 0.125])]
    out = whitening.whitening_query(spark.createDataFrame(rows + odd, KIND)).collect()
    assert {r.vec_id for r in out} == {i for i, _ in rows} | {None} and {r.n for r in out} == {51} and len(out) == 51 * 3


def test_equal_rows_empty_tables_and_names(spark):
    same = spark.createDataFrame([(1, [0.5, 0.5]), (1, [0.5, 0.5])], KIND)
    out = whitening.whitening_query(same).collect()
    assert len(out) == 4 and {(r.deviation, r.whitened, r.explained, r.identity_error) for r in out} == {(0, 0.0, 0.0, 0.0)}
    empty = whitening.whitening_query(same.limit(0))
    assert empty.count() == 0 and empty.columns == whitening.whitening_query(same).columns
    clashing = spark.createDataFrame([(1, [1.0, 0.0], "a", 7), (2, [0.0, 1.0], "b", 8), (3, [0.5, 0.1], None, 9)], "vec_id long, `my.vec` array<double>, white string, v int")
    frame, model = whitening.whitened(clashing, "my.vec", 1)
    assert frame.columns == [*clashing.columns, "white1"] and model.n == 3 and all(len(r.white1.whitened) == 1 for r in frame.collect())


def test_rank_that_is_short(spark):
    rows = [(i, [float(i), float(i), 1.0]) for i in range(20)]
    out = whitening.whitening_query(spark.createDataFrame(rows, KIND)).collect()
    assert all(r.whitened == 0 for r in out if r.component > 1) and out[0].identity_error < 1e-9 and abs(sum(r.whitened**2 for r in out) / 20 - 1) < 1e-9


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_symmetric_qr(n):
    rng = np.random.default_rng(n)
    for a in (rng.normal(size=(n, n)), np.zeros((n, n)), np.diag(np.arange(n) ** 9.0), np.ones((n, n))):
        a = a @ a.T
        values, vectors = whitening.symmetric_qr(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-10, atol=1e-10 * max(1, np.abs(a).max()))
        assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-12) and np.allclose(vectors * values @ vectors.T, a, atol=1e-10 * max(1, np.abs(a).max()))
        assert (np.diff(values) <= 0).all()
