"""Whitening: against dense eigenvectors and exact integers."""

import numpy as np
import pytest

from palaver.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, label int"


def dense(x, k=4):
    """Eigenpairs, n, sums and trace of the distinct rows of x."""
    u = np.unique(x, axis=0)
    v = np.cov(u.T.astype(float), bias=True)
    values, vectors = np.linalg.eigh(np.atleast_2d(v))
    return values[::-1][:k], vectors[:, ::-1][:, :k], len(u), u.sum(0), np.trace(np.atleast_2d(v))


def test_whitened_rows_equal_dense_algebra(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = table.unionByName(table.where("vec_id % 3 = 0").withColumn("vec_id", table.vec_id + 10_000))
    got = w.whitened(rows).collect()
    x = {r.vec_id: np.floor(256 * np.array(r.embedding, float)).astype(int) for r in rows.collect()}
    values, vectors, n, sums, trace = dense(np.stack(list(x.values())))
    assert len(got) == 4 * len(x) and {r.n for r in got} == {n}
    sign = {}
    for r in got:
        c, v = r.component - 1, x[r.vec_id]
        assert r.deviation == int(((n * v - sums) ** 2).sum())
        want = (v - sums / n) @ vectors[:, c] / np.sqrt(values[c])
        sign.setdefault(c, np.sign(want * r.whitened) if abs(want) > 1e-3 else None)
        if sign[c]:
            assert abs(want - sign[c] * r.whitened) < 1e-9
        assert abs(r.explained - values[c] / trace) < 1e-10 and r.identity_error < 1e-10


@pytest.mark.parametrize(("d", "spectrum"), [(64, None), (64, [5, 5, 5, 5, 5, 1]), (300, None), (40, [9, 4, 0, 0]), (3, None), (1, None), (12, [0])])
def test_lanczos_finds_the_largest_eigenvalues(d, spectrum):
    rng = np.random.default_rng(d)
    values = np.sort(rng.exponential(size=d))[::-1] if spectrum is None else np.array(spectrum + [0.5 * min(spectrum)] * (d - len(spectrum)), float)
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
    matrix, passes = turn @ np.diag(values) @ turn.T, []

    def apply(block):
        assert np.abs(block.T @ block - np.eye(block.shape[1])).max() < 1e-12
        passes.append(block.shape[1])
        return matrix @ block

    found, vectors = w.lanczos(apply, d, 4, most=24)
    k = min(4, d)
    assert np.abs(found - np.sort(values)[::-1][:k]).max() < 1e-11 * max(1, values.max())
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-10 and np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-10
    assert spectrum is None or len(passes) <= 5


def test_deviations_are_exact_or_null():
    rng = np.random.default_rng(1)
    for top, n in ((200, 5_000), (1 << 20, 2_000), (1 << 40, 1 << 25), (1 << 62, 3)):
        x = rng.integers(-top, top, (50, 4))
        sums = [int(s) for s in x.astype(object).sum(0)]
        about, exact = w.deviations(x, n, sums)
        want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
        assert exact == [v if v < 1 << 63 else None for v in want]
        assert np.allclose(about, [float(v) for v in want], rtol=1e-9)


def test_odd_vectors(spark):
    rows = [(1, [0.1, 0.2], 1), (2, [0.3, -0.2], None), (None, [0.3, -0.2], 1), (2, [0.3, -0.2], 1), (3, None, 1), (4, [None, 0.1], 1), (5, [float("nan"), 0.0], 1), (6, [float("inf"), 0.0], 1), (7, [], 1), (8, [1.0], 1), (9, [-0.0, 0.5], 1), (10, [0.0, 0.5], 1)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = w.whitened(table).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.component) for r in got) == sorted((i, c) for i in (1, 2, -1, 2, 9, 10) for c in (1, 2))
    assert {r.n for r in got} == {3}
    assert len({r.deviation for r in got if r.vec_id in (9, 10)}) == 1
    clash = table.selectExpr("*", "1 as x", "2 as n", "3 as at", "4 as part")
    assert sorted(map(repr, map(tuple, w.whitened(clash).collect()))) == sorted(map(repr, map(tuple, got)))


def test_no_variance_no_rows(spark):
    for rows in ([], [(1, [0.5, 0.5], 0)], [(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)], [(1, None, 0)]):
        assert w.whitened(spark.createDataFrame(rows, SCHEMA)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 0) for i in range(9)], SCHEMA)
    got = w.whitened(line).collect()
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12
    huge = spark.createDataFrame([(i, [1e30 * i, -1.0], 0) for i in range(3)], SCHEMA)
    assert w.whitened(huge).where("deviation is null").count() >= 2
