"""Whitening against exact fractions and a plain eigensolver; polynomials against determinants."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticklake.llm import charpoly, whitening

SCHEMA = "vec_id long, embedding array<float>, w string, n int, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], SCHEMA)


def poly_of(matrix):
    primes = charpoly.primes_for(charpoly.coefficient_bound(matrix))
    d = len(matrix)
    mod = [charpoly.polynomial_mod(np.array([[v % p for v in r] for r in matrix]).reshape(d, d), p).tolist() for p in primes]
    return charpoly.remaindered(mod, primes)


def determinant(m):
    m = [[Fraction(x) for x in r] for r in m]
    out = Fraction(1)
    for k in range(len(m)):
        pivot = next((i for i in range(k, len(m)) if m[i][k]), None)
        if pivot is None:
            return 0
        if pivot != k:
            m[k], m[pivot], out = m[pivot], m[k], -out
        out *= m[k][k]
        for i in range(k + 1, len(m)):
            f = m[i][k] / m[k][k]
            m[i] = [a - f * b for a, b in zip(m[i], m[k])]
    return out


@pytest.mark.parametrize("d", [1, 2, 3, 6, 9])
def test_polynomials_are_exact(d):
    rng = np.random.default_rng(d)
    for high in (3, 10**6, 10**15):
        m = [[int(v) for v in r] for r in rng.integers(-high, high, (d, d))]
        if d > 3:
            m[2] = [0] * d  # zero subdiagonals and pivots to look for
        poly = poly_of(m)
        assert poly[d] == 1 and len(poly) == d + 1
        for x in (-3, 0, 1, 17):
            want = determinant([[(x if i == j else 0) - m[i][j] for j in range(d)] for i in range(d)])
            assert charpoly.value(poly, x) == want


def test_primes():
    few = charpoly.primes_for(1 << 100)
    assert math.prod(few) > 2 << 100 and all(all(p % q for q in range(2, 200)) for p in few)
    assert [n for n in range(60) if charpoly.is_prime(n)] == [n for n in range(2, 60) if all(n % q for q in range(2, n))]


def from_roots(roots):
    poly = [1]
    for r in roots:
        poly = [(poly[i - 1] if i else 0) - r * (poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
    return poly


def test_roots_are_counted_and_found():
    roots = [0, 0, 1, 3, 5, 5, 7, 7, 7, 10**18, 10**18 + 1]
    poly = from_roots(roots)
    assert charpoly.zero_roots(poly) == 2
    for a in (0, 1, 2, 4, 5, 6, 7, 8, 10**18):
        assert charpoly.roots_above(poly, a) == sum(r > a for r in roots)
    want = sorted(roots, reverse=True)
    for k in range(1, 10):
        low, bits, first, count = charpoly.root(poly, k, sum(roots))
        assert Fraction(low, 2**bits) <= want[k - 1] <= Fraction(low + 1, 2**bits)
        assert low.bit_length() > 166 or want[k - 1] == Fraction(low, 2**bits)
        assert count == roots.count(want[k - 1]) and first == want.index(want[k - 1]) + 1


def test_roots_between_integers():
    # (x^2 - 2)(x - 1) has a negative root; (x - 2)^2 - 2 has none
    poly = [2, -4, 1]
    for k, want in ((1, 2 + math.sqrt(2)), (2, 2 - math.sqrt(2))):
        low, bits, _, _ = charpoly.root(poly, k, 4)
        assert low / 2**bits == pytest.approx(want, rel=1e-15)


def test_null_vectors_of_equal_roots_are_a_basis():
    m = [[2, 0, 0, 0], [0, 5, 0, 0], [0, 0, 5, 0], [0, 0, 0, 9]]
    poly = poly_of(m)
    found = [charpoly.root(poly, k, 21) for k in range(1, 5)]
    u = np.array([[float(x) for x in charpoly.null_vector(m, lo, b, k - f, c)] for k, (lo, b, f, c) in enumerate(found, 1)])
    assert np.allclose(u @ u.T, np.eye(4), atol=1e-15)
    assert np.allclose(u @ np.array(m) @ u.T, np.diag([9, 5, 5, 2]), atol=1e-14)


def plain(rows):
    """(ids, x, n, S, A) in Python integers."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    a = [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(d)] for i in range(d)]
    return [i for i, _ in kept], x, n, s, a


def check(spark, rows, components=8):
    ids, x, n, s, a = plain(rows)
    d = len(s)
    out = whitening.whiten(vectors(spark, rows), components=components).collect()
    e, u = np.linalg.eigh(np.array([[float(Fraction(v, n * n)) for v in r] for r in a]))
    e, u = e[::-1], u[:, ::-1]
    rank = sum(v > e[0] * 1e-12 for v in e)
    k = min(components, rank)
    assert len(out) == n * k
    trace = float(Fraction(sum(a[i][i] for i in range(d)), n * n))
    want_dev = {}
    for i, r in zip(ids, x):
        want_dev.setdefault(i, set()).add(sum((n * v - t) ** 2 for v, t in zip(r, s)))
    held = {}
    for r in out:
        assert r.n == n and int(r.deviation) in want_dev[r.vec_id]
        assert r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-9)
        assert r.identity_error < 1e-9
        held.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r.whitened)
    centred = np.array([[float(Fraction(n * v - t, n)) for v, t in zip(r, s)] for r in x])
    for c in range(1, k + 1):
        others = [e[j] for j in range(d) if j != c - 1]
        if min(abs(e[c - 1] - v) for v in others or [0.0]) < 1e-6 * e[0]:
            continue  # the plain solver cannot tell the vectors apart
        want = centred @ u[:, c - 1] / math.sqrt(e[c - 1])
        got, plain_values = [], []
        for i in sorted(held[c], key=str):
            got += sorted(held[c][i])
            plain_values += sorted(w * np.sign(want @ np.array([held[c][j][0] for j in ids])) for j, w in zip(ids, want) if j == i)
        assert np.allclose(got, plain_values, atol=1e-7)
    return out


def test_random_vectors_with_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=12) * np.arange(1, 13)]) for i in range(300)]
    rows += [(3, rows[3][1]), (None, rows[7][1]), (900, None), (901, [None] + rows[0][1][1:])]
    rows += [(902, [math.nan] + rows[0][1][1:]), (903, [math.inf] + rows[0][1][1:])]
    check(spark, rows)
    # other lengths, empty vectors and entries beyond every long take no part
    more = [(910, [1.0] * 5), (911, []), (912, [3e38] + rows[0][1][1:])]
    rounded = lambda df: sorted((str(r.vec_id), r.component, round(r.whitened, 9)) for r in df.collect())
    assert rounded(whitening.whiten(vectors(spark, rows + more))) == rounded(whitening.whiten(vectors(spark, rows)))


def test_entries_beyond_exact_doubles(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=3) * [1e9, 1e8, 1e7]]) for i in range(40)]
    check(spark, rows)


def test_ranks_below_the_dimension(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(50):
        a, b = (float(v) / 1024 for v in rng.integers(-4000, 4000, 2))
        rows.append((i, [a, a, b, 1.5, a + b]))
    out = check(spark, rows)
    assert {r.component for r in out} == {1, 2}
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    ]


def test_equal_eigenvalues(spark):
    rows = [(2 * i + s, [float((s * 2 - 1) * (i == j)) for j in range(6)]) for i in range(6) for s in (0, 1)]
    out = whitening.whiten(vectors(spark, rows)).collect()
    assert len(out) == 12 * 6 and max(r.identity_error for r in out) < 1e-12
    assert {round(r.explained, 12) for r in out} == {round(1 / 6, 12)}


def test_the_query(spark, sf):
    from ticklake.llm import queries

    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = {(r.vec_id, r.component): r.whitened for r in check(spark, rows)}
    got = queries.QUERIES["op13_whiten"](spark, sf)
    assert dict(got.dtypes)["deviation"] == "bigint"
    assert {(r.vec_id, r.component): r.whitened for r in got.collect()} == pytest.approx(want, abs=1e-12)
    assert got.groupBy("component").agg(F.avg("whitened").alias("m")).where("abs(m) > 1e-9").count() == 0
