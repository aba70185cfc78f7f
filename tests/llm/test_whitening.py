import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tidewatch.llm import whitening as W


def leverrier(a):
    """Coefficients of det(x I - a) in exact fractions, by Faddeev and LeVerrier."""
    d = len(a)
    c, m = [Fraction(0)] * d + [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) + (c[d - k + 1] if i == j else 0) for j in range(d)] for i in range(d)]
        c[d - k] = -Fraction(sum(a[i][t] * m[t][i] for i in range(d) for t in range(d)), k)
    return [int(x) for x in c]


def gram(d, seed, rank=None, size=10**6):
    rng = random.Random(seed)
    rows = [[rng.randrange(-size, size) for _ in range(d)] for _ in range(rank or d + 3)]
    return [[sum(r[i] * r[j] for r in rows) for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("matrix", [
    gram(6, 1), gram(7, 2, rank=3), [[5]], [[0, 0], [0, 0]], [[4, 0, 0], [0, 4, 0], [0, 0, 1]], gram(5, 3, size=10**30),
    [[(1 << 31) - 1, 0], [0, (1 << 31) - 1]],
])
def test_polynomial_is_exact(spark, matrix):
    assert W.characteristic_polynomial(spark, matrix) == leverrier(matrix)


def test_polynomial_modulo_small_primes():
    rng = np.random.default_rng(4)
    for p in (2, 3, 7, 101):  # many zero pivots
        for d in (1, 2, 3, 6):
            a = rng.integers(0, p, (d, d))
            assert W.polynomial_modulo(a, p).tolist() == [c % p for c in leverrier(a.tolist())]


def test_roots_are_counted_and_isolated():
    roots = [1, 5, 5, 5, 9, 1000000, 0]
    poly = [1]
    for r in roots:
        poly = [(poly[i - 1] if i else 0) - r * (poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
    for at in (Fraction(0), Fraction(1), Fraction(9, 2), Fraction(5), Fraction(10**6), Fraction(-1)):
        assert W.roots_above(poly, at) == sum(r > at for r in roots)
    found = W.largest_roots(poly, 4)
    assert [(round(float(r), 9), m) for r, m in found] == [(1000000, 1), (9, 1), (5, 3)]
    near = [(10**40 + 1), 10**40]  # equal as doubles, told apart
    poly = [near[0] * near[1], -sum(near), 1]
    assert [m for _, m in W.largest_roots(poly, 2, bits=200)] == [1, 1]


def made(n, d=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.arange(d, 0, -1)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = [(i, v.tolist(), "k") for i, v in enumerate(x)]
    rows += [(n + i, x[0].tolist(), "copy") for i in range(n // 3)]
    return rows + [(-1, None, None), (-2, [math.nan] + [0.0] * (d - 1), ""), (-3, [math.inf] + [0.0] * (d - 1), ""),
                   (-4, [None] + [0.0] * (d - 1), ""), (-5, [], ""), (-6, [1.0], ""), (None, x[1].tolist(), "")]


SCHEMA = "vec_id long, embedding array<float>, x string"


def plain(rows, d, k=4):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v, _ in rows if v and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    m = fit * n - s
    cov = (m.T @ m).astype(float) / n**3
    e, u = np.linalg.eigh(cov)
    order = np.argsort(-e)[:k]
    out = {}
    for i, x in kept:
        far = [n * a - b for a, b in zip(x, s)]
        for c, at in enumerate(order):
            out.setdefault((i, c + 1), []).append((n, int(sum(f * f for f in far)), abs(float(np.dot(far, u[:, at])) / n / math.sqrt(e[at])), e[at] / e.sum()))
    return out


@pytest.mark.parametrize("n, d", [(300, 6), (40, 3), (9, 5)])
def test_against_floating_point(spark, n, d):
    rows = made(n, d)
    want = plain(rows, d)
    got = W.whiten(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        near = [w for w in want[r.vec_id, r.component] if w[:2] == (r.n, r.deviation)]
        assert any(abs(r.whitened) == pytest.approx(w[2], abs=1e-8) and r.explained == pytest.approx(w[3], rel=1e-9) for w in near)
        assert r.identity_error < 1e-9
    signs = {}
    for r in got:  # same sign for all rows: each component's mean over the fit list is zero
        signs.setdefault(r.component, {})[round(r.whitened, 9)] = r.whitened
    assert len(signs) == min(4, d)


def test_wide_integers(spark):
    """Sums, products and squares beyond 64 bits."""
    rng = random.Random(1)
    rows = [[rng.randrange(-(2**62), 2**62), rng.randrange(-5, 5), rng.randrange(2**40)] for _ in range(200)]
    n, sums, centred = W.scatter(spark.createDataFrame([(r,) for r in rows], "x array<long>").repartition(3))
    assert n == 200 and sums == [sum(r[j] for r in rows) for j in range(3)]
    assert centred == [[n * sum(r[i] * r[j] for r in rows) - sums[i] * sums[j] for j in range(3)] for i in range(3)]


def test_equal_eigenvalues(spark):
    rows = [(k, [float(s * (i == j)) for j in range(3)]) for k, (i, s) in enumerate((i, s) for i in range(3) for s in (1, -1))]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.component for r in got} == {1, 2, 3} and all(r.identity_error < 1e-12 for r in got)
    assert all(r.explained == pytest.approx(1 / 3) for r in got)


def test_small_tables(spark):
    whiten = lambda rows: W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert whiten([]) == [] and whiten([(1, None, "")]) == []
    assert whiten([(1, [1.0, 2.0], ""), (2, [1.0, 2.0], "")]) == []
    two = whiten([(1, [1.0, 2.0], ""), (1, [1.0, 2.0], ""), (2, [3.0, 2.0], "")])
    assert [(r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in two] == [(1, 2, 512**2, 1.0, 1.0)] * 3


def test_whole_table_whitens_to_the_identity(spark):
    got = W.whiten(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")).toPandas()
    assert got["identity_error"].max() < 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.cov(wide.T, bias=True) - np.eye(4)).max() < 1e-6  # its vectors are all different
