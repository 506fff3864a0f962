import math
from fractions import Fraction

import numpy as np
import pytest

from thoughtloom.llm import whitening
from thoughtloom.llm.catalog import QUERIES


def plain(vectors, k=16):
    """vectors: id -> list of floats. The fit by numpy's own solver, deviations by integers."""
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in vectors.items()}
    fit = sorted(set(map(tuple, x.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = {i: np.array([float(Fraction(n * c - s, n)) for c, s in zip(v, sums)]) for i, v in x.items()}
    rows = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in fit])
    covariance = rows.T @ rows / n
    values, vectors_ = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:k]
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for i, v in x.items()}
    return n, centred, covariance, values[order], vectors_[:, order], deviation


def test_against_another_solver(spark, tmp_path):
    r = np.random.default_rng(3)
    base = (r.standard_normal((150, 24)) @ r.standard_normal((24, 24))).astype(np.float32)
    vectors = {i: base[i % 140].tolist() for i in range(150)}  # some repeated
    odd = [(900, None), (901, [None] * 24), (902, [float("nan")] + [0.0] * 23), (903, [float("inf")] * 24), (904, [1.0] * 3), (905, []), (906, [3e38] * 24)]
    rows = [(i, v, "c", 1) for i, v in [*vectors.items(), *odd]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string, n int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op12_whitening"](spark, str(tmp_path)).collect()
    n, centred, covariance, values, columns, deviation = plain(vectors)
    assert len(got) == 150 * 16 and {g.n for g in got} == {n} == {140}
    table = np.zeros((150, 16))
    for g in got:
        table[g.vec_id, g.component - 1] = g.whitened
        assert g.deviation == deviation[g.vec_id] and g.identity_error < 1e-9
        assert g.explained == pytest.approx(values[g.component - 1] / np.trace(covariance), rel=1e-9)
    want = np.array([centred[i] for i in range(150)]) @ columns / np.sqrt(values)
    sign = np.sign((table * want).sum(axis=0))
    assert np.allclose(table, want * sign, atol=1e-8)


@pytest.mark.parametrize(
    "matrix",
    [np.eye(20), np.diag([3.0, 3, 3, 1, 1]), np.ones((30, 30)), np.array([[2.0]]), np.array([[2.0, 1], [1, 2]]), np.kron(np.eye(6), [[2.0, 1], [1, 2]]),
     np.diag(np.logspace(0, -12, 40)), np.diag([1.0] * 8 + [1.0 - 1e-13] * 8)],
)
def test_equal_and_close_eigenvalues(matrix):
    values, vectors = whitening.leading_vectors(matrix, 16)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:16], atol=1e-13 * abs(matrix).max() * len(matrix))
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * len(matrix)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_sturm_counts():
    r = np.random.default_rng(0)
    a = r.standard_normal((15, 15))
    diagonal, off, _ = whitening.tridiagonal(a + a.T)
    x = np.linspace(-15, 15, 61)
    assert whitening.below(diagonal, off, x).tolist() == [(np.linalg.eigvalsh(a + a.T) < y).sum() for y in x]


def test_few_and_degenerate_rows(spark, nothing):
    assert QUERIES["op12_whitening"](spark, nothing).count() == 0
    run = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert run([(1, [1.0, 2.0])]) == [] and run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    got = run([(1, [0.0, 5.0]), (2, [2.0, 5.0]), (None, [2.0, 5.0])])  # one component has variance
    assert [(g.vec_id, g.component, abs(round(g.whitened, 12)), g.explained) for g in got] == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0), (None, 1, 1.0, 1.0)]
    assert got[0].deviation == 128**2 and got[1].whitened == got[2].whitened == -got[0].whitened


def test_large_deviations_are_exact_or_null():
    model = whitening.Model(3, [3_000_001, 10**16], np.ones(1), np.zeros((2, 1)), 1.0)
    x = np.array([[1_000_000, 10**16 // 3], [2, 10**12]])
    want = [sum((3 * a - b) ** 2 for a, b in zip(row, model.sums)) for row in x.tolist()]
    assert model.deviations(x) == [v if v < 1 << 63 else None for v in want] and model.deviations(x)[1] is None
