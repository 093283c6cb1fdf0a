import random
from fractions import Fraction

import numpy as np
import pytest

from pourline.llm.charpoly import combined, largest_roots, null_space, primes, primes_needed, residues
from pourline.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, n int, x string, component int"


def polynomial(matrix):
    moduli = primes(primes_needed(matrix))
    return combined(moduli, residues(matrix, moduli).tolist())


def by_faddeev(matrix):
    """The characteristic polynomial by traces of powers, in fractions."""
    d = len(matrix)
    m, c, out = [[Fraction(0)] * d for _ in range(d)], Fraction(1), [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(matrix[i][h] * m[h][j] for h in range(d)) + (c if i == j else 0) for j in range(d)] for i in range(d)]
        c = -sum(matrix[i][h] * m[h][i] for i in range(d) for h in range(d)) / k
        out.append(c)
    return [int(v) for v in reversed(out)]


@pytest.mark.parametrize("d, n", [(1, 3), (2, 5), (4, 2), (7, 40), (9, 9)])
def test_polynomial_and_roots_are_exact(d, n):
    rng = np.random.default_rng(d)
    x = rng.integers(-30, 30, (n, d))
    matrix = (x.T @ x).tolist()
    poly = polynomial(matrix)
    assert poly == by_faddeev(matrix)
    want = np.linalg.eigvalsh(np.array(matrix, float))[::-1]
    got = [float(r) for r, m in largest_roots(poly, d) for _ in range(m)]
    assert len(got) == np.linalg.matrix_rank(np.array(matrix, float))
    assert np.allclose(got, want[: len(got)], rtol=1e-9)


def test_equal_roots_have_orthonormal_vectors():
    matrix = [[5, 0, 0, 0], [0, 5, 0, 0], [0, 0, 5, 0], [0, 0, 0, 2]]
    roots = largest_roots(polynomial(matrix), 4)
    assert [m for _, m in roots] == [3, 1] and abs(roots[0][0] - 5) < Fraction(1, 10**20)
    vectors = np.array([v for r, m in roots for v in null_space(matrix, r, m)])
    assert np.allclose(vectors @ vectors.T, np.eye(4), atol=1e-15)


def brute(rows, components=16):
    """whiten by numpy over all rows at once; vectors up to their sign."""
    good = [(i, np.floor(np.array(v, np.float64) * 64) + 1e6) for i, v in rows if v and all(e is not None and np.isfinite(e) for e in v)]
    x = np.array([v for _, v in good])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    away = fit - s / n
    e, v = np.linalg.eigh(away.T @ away / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ v / np.sqrt(e), e / (away**2).sum() * n


def test_whitening_agrees_with_numpy(spark):
    rng = np.random.default_rng(8)
    vectors = [[float(np.float32(c)) for c in v] for v in rng.normal(0, 0.4, (300, 20)) * np.linspace(0.5, 2, 20)]
    vectors += [vectors[0]] * 150  # a hot vector
    rows = list(enumerate(vectors))
    odd = [(1000, None), (1001, []), (1002, [None] + vectors[0][1:]), (1003, [float("nan")] + vectors[0][1:]), (1004, [float("inf")] + vectors[0][1:]), (1005, vectors[0][:5]), (1006, [1e30] + vectors[0][1:])]
    given = spark.createDataFrame([(i, v, 1, "x", 1) for i, v in rows + odd], SCHEMA).repartition(4)
    got = {(r["vec_id"], r["component"]): r for r in whiten(given).collect()}
    n, deviation, white, explained = brute(rows)
    assert len(got) == len(rows) * 16 and {r["n"] for r in got.values()} == {n}
    assert all(got[i, c]["deviation"] == int(deviation[i]) for i, _ in rows for c in (1, 16))
    for c in range(16):
        own = np.array([got[i, c + 1]["whitened"] for i, _ in rows])
        own *= np.sign(own @ white[:, c])
        assert np.allclose(own, white[:, c], atol=1e-6)
        assert abs(got[0, c + 1]["explained"] / explained[c] - 1) < 1e-9
    assert {r["identity_error"] for r in got.values()} == {got[0, 1]["identity_error"]} and got[0, 1]["identity_error"] < 1e-9


def test_large_entries_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) * 2.0**e for e in (0, 10, 30, 50)], 1, "x", 1) for i in range(12)]
    out = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 48 and max(r["identity_error"] for r in out) < 1e-6 and {r["deviation"] for r in out} == {None}


def test_without_variance_there_is_no_row(spark):
    for rows in ([], [(1, [0.5, 0.5], 1, "x", 1)] * 3, [(1, None, 1, "x", 1)]):
        assert whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []
    flat = [(i, [float(i), 1.0, float(-i)], 1, "x", 1) for i in range(5)]
    assert {r["component"] for r in whiten(spark.createDataFrame(flat, SCHEMA)).collect()} == {1}
