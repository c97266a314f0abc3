import math
from fractions import Fraction

import numpy as np
import pytest

from tallyflow.llm import whitening as w
from tallyflow.llm.queries import op13_whitening

ROWS = "vec_id long, embedding array<double>, n int, component string"


def exact_determinant(a, x):
    """det(x - a) by fractions."""
    m = [[Fraction((x if i == j else 0) - int(a[i][j])) for j in range(len(a))] for i in range(len(a))]
    det = Fraction(1)
    for k in range(len(m)):
        pivot = next((i for i in range(k, len(m)) if m[i][k]), None)
        if pivot is None:
            return 0
        if pivot != k:
            m[k], m[pivot], det = m[pivot], m[k], -det
        det *= m[k][k]
        for i in range(k + 1, len(m)):
            f = m[i][k] / m[k][k]
            m[i] = [p - f * q for p, q in zip(m[i], m[k])]
    return det


@pytest.mark.parametrize("d,size", [(1, 5), (2, 10), (5, 1000), (9, 10**9), (6, 10**15)])
def test_polynomial_is_exact(spark, d, size):
    rng = np.random.default_rng(d)
    x = rng.integers(-size, size, (d + 2, d))
    a = w.products(x)
    assert a.tolist() == [[sum(int(r[i]) * int(r[j]) for r in x) for j in range(d)] for i in range(d)]
    poly = w.characteristic_polynomial(spark, a)
    assert len(poly) == d + 1 and poly[d] == 1
    for t in range(-2, d):
        assert sum(c * t**k for k, c in enumerate(poly)) == exact_determinant(a, t)


def test_roots_repeated_near_and_zero():
    def poly(*roots):
        p = [1]
        for r in roots:
            p = [(p[k - 1] if k else 0) - r * (p[k] if k < len(p) else 0) for k in range(len(p) + 1)]
        return p

    near = 10**30
    for roots in ([7], [0, 0, 3], [5, 5, 5, 2], [near, near + 1, near + 1, 1, 0], [8, 4, 2, 1, 1], [0, 0], [16, 16]):
        want = sorted(roots, reverse=True)
        for count in (1, 2, len(roots)):
            got = w.largest_roots(poly(*roots), count)
            assert len(got) == min(count, len(roots))
            assert all(abs(g - t) <= Fraction(t, 1 << 150) for g, t in zip(got, want))


def test_components_of_equal_and_near_eigenvalues(spark):
    for diagonal in ([9, 9, 4, 4, 1], [10**9, 10**9 + 1, 10**9 + 2, 5, 0]):
        # A reflection with whole numbers: (v'v) I - 2 v v'.
        v = np.array([1, 2, 3, 4, 5], object)
        q = np.eye(5, dtype=int).astype(object) * int(v @ v) - 2 * np.outer(v, v)
        a = q @ np.diag(np.array(diagonal, object)) @ q.T
        axes, roots = w.components_of(spark, a, 5)
        known = np.array([float(r) for r in roots])
        used = known > 0
        assert np.allclose(axes[:, used].T @ axes[:, used], np.eye(used.sum()), atol=1e-13)
        # The remainder is exact up to the rounding of the components themselves.
        rest = a.astype(float) @ axes[:, used] - axes[:, used] * known[used]
        assert np.abs(rest).max() <= 1e-13 * known[0] * 5


def expected(vectors, most):
    """Whitening with exact sums and the library's eigenvectors in double precision."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    far = n * x - s
    e, u = np.linalg.eigh((far.T @ far / n).astype(float) / n**2)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return (far * far).sum(axis=1).tolist(), (far / n).astype(float) @ u / np.sqrt(e), e / np.trace((far.T @ far).astype(float) / n**3)


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = sorted(vectors)
    deviation, want, explained = expected([vectors[i] for i in ids], 32)
    rows = op13_whitening(spark, sf).collect()
    assert len(rows) == 32 * len(ids) and {r.n for r in rows} == {len(ids)}
    assert {r.vec_id: r.deviation for r in rows} == dict(zip(ids, deviation))
    got = np.array([r.whitened for r in sorted(rows, key=lambda r: (r.vec_id, r.component))]).reshape(-1, 32)
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-8
    assert np.allclose([next(r.explained for r in rows if r.component == k) for k in range(1, 33)], explained, rtol=1e-9)
    assert len({r.identity_error for r in rows}) == 1 and 0 < rows[0].identity_error < 1e-9


def test_odd_rows_lengths_and_large_numbers(spark):
    rng = np.random.default_rng(1)
    good = [[float(t) for t in v] for v in rng.normal(size=(40, 3)) * [1, 100, 1e4]]
    other = [[float(t) for t in v] for v in rng.normal(size=(5, 2))]
    odd = [None, [], [1.0, None, 2.0], [math.nan, 1.0, 1.0], [math.inf, 0.0, 0.0]]
    rows = [(k, v, 1, "x") for k, v in enumerate(good)] + [(100 + k, v, 1, "x") for k, v in enumerate(other)]
    rows += [(None, v, None, None) for v in odd] + [(7, good[7], 1, "x"), (None, good[8], 1, "x")]
    got = w.whitened(spark.createDataFrame(rows, ROWS), 2).collect()
    assert len(got) == 2 * (42 + 5)
    three = [*good, good[7], good[8]]
    deviation, want, _ = expected(three, 2)
    by_id = {(r.vec_id, r.component): r for r in got if r.n == 42}
    assert all(int(by_id[k, 1].deviation) == deviation[k] for k in range(40))
    for c in (1, 2):
        mine = np.array([by_id[k, c].whitened for k in range(40)])
        assert min(np.abs(mine - s * want[:40, c - 1]).max() for s in (1, -1)) < 1e-6
    assert got[0].identity_error < 1e-9


def test_no_variance_and_empty(spark):
    one = w.whitened(spark.createDataFrame([(1, [0.5, 2.0], 1, "x")] * 3, ROWS)).collect()
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(3, 0, None, 0.0, 0.0)}
    line = w.whitened(spark.createDataFrame([(k, [float(k), 2.0 * k], 1, "x") for k in range(4)], ROWS)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line)
    assert w.whitened(spark.createDataFrame([], ROWS)).count() == 0
    with pytest.raises(Exception, match="is 70368744177664 or more"):
        w.whitened(spark.createDataFrame([(1, [1e300], 1, "x")], ROWS)).collect()
