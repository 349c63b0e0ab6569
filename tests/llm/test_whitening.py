"""Whitening against exact fractions and the library's eigen-solver."""

import math
from fractions import Fraction

import numpy as np
import pytest

from fabulary.llm import whitening


def matrices():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 8, 17, 64):
        a = rng.standard_normal((n, n))
        yield a + a.T
        yield np.eye(n) * 3  # all eigenvalues equal
        v = rng.standard_normal((n, max(1, n // 3)))
        yield v @ v.T  # many are zero
        yield np.diag(np.repeat(np.arange(1.0, n // 2 + 2), 2)[:n]) + 1e-9 * np.fliplr(np.eye(n))
        yield np.zeros((n, n))


def test_eigen_equals_the_library():
    for a in matrices():
        values, vectors = whitening.eigen(a)
        size = max(1.0, np.abs(a).max() * len(a))
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 * size
        assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13
        assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * size


def test_double_double_is_exact_where_doubles_are_not():
    rng = np.random.default_rng(2)
    high = rng.standard_normal((301, 3)) * 10.0 ** rng.integers(-9, 9, (301, 3))
    low = high * 2.0**-54
    got = whitening.outer_total(high, low)
    for i, j in zip(*np.triu_indices(3)):
        exact = sum((Fraction(a) + Fraction(b)) * (Fraction(c) + Fraction(d)) for a, b, c, d in zip(high[:, i], low[:, i], high[:, j], low[:, j]))
        scale = sum(abs(Fraction(a) * Fraction(c)) for a, c in zip(high[:, i], high[:, j]))
        assert abs(Fraction(got[0][i, j]) + Fraction(got[1][i, j]) - exact) <= scale * Fraction(1, 1 << 98)


def rows(seed=3, n=300, width=11):
    rng = np.random.default_rng(seed)
    out = [(i, [float(v) for v in (rng.standard_normal(width) * (1 + np.arange(width)) / 40).astype(np.float32)]) for i in range(n)]
    out += [(0, out[0][1]), (None, out[1][1]), (900, None), (901, [None] * width), (902, [float("nan")] + [0.0] * (width - 1)), (903, [float("-inf")] * width)]
    return out + [(904, [0.5, -0.25]), (905, [])]


def plain(vectors, width):
    """Covariance by exact fractions, deviations by whole numbers."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] + [100_000] * (width - len(v)) for v in vectors]
    n, sums = len(x), [sum(r[k] for r in x) for k in range(width)]
    matrix = [[float(Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n * n * n)) for j in range(width)] for i in range(width)]
    return x, n, sums, np.array(matrix), [sum((n * v - s) ** 2 for v, s in zip(r, sums)) for r in x]


def test_query_equals_exact_fractions(spark, tmp_path):
    given = rows()
    spark.createDataFrame(given, "vec_id long, embedding array<float>").repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op13(spark, str(tmp_path)).toPandas()
    kept = [(i, v) for i, v in given if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x, n, sums, matrix, deviations = plain([v for _, v in kept], 11)
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == len(kept) * 8 and set(got.n) == {n}
    assert sorted(got[got.component == 1].deviation) == sorted(deviations)
    assert np.allclose(got.groupby("component").explained.first(), values[:8] / matrix.trace(), rtol=1e-12)
    assert got.identity_error.max() < 1e-9
    want = (np.array(x) - np.array(sums) / n) @ vectors[:, :8] / np.sqrt(values[:8])
    first = {i: k for k, (i, _) in reversed(list(enumerate(kept)))}
    for (ident, component), part in got[got.vec_id.notna()].groupby(["vec_id", "component"]):
        mine = part.whitened.abs().to_numpy()
        assert np.allclose(mine, abs(want[first[int(ident)], component - 1]), atol=1e-9)
    signs = got[got.vec_id == 5].sort_values("component").whitened.to_numpy() / want[first[5]]
    other = got[got.vec_id == 6].sort_values("component").whitened.to_numpy() / want[first[6]]
    assert np.allclose(signs, other) and np.allclose(np.abs(signs), 1)


def test_covariance_does_not_lose_small_variance_beside_the_shift(spark):
    """Sums of squares around 1e10 with a variance of about 1: a plain one-pass covariance has no correct digit in float32 and few in doubles."""
    vectors = [(i, [(i % 3) / 1024, (i % 2) / 1024]) for i in range(600)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(5)
    n, sums = whitening.totals(df, "embedding")
    assert np.array_equal(whitening.covariance(df, "embedding", n, sums), plain([v for _, v in vectors], 2)[3])


@pytest.mark.parametrize("vectors,count", [([(1, [0.5, 0.5])], 2), ([(1, []), (2, [])], 0), ([(1, None)], 0), ([(1, [0.25, 0.0, 1.0]), (1, [0.25, 0.0, 1.0])], 6)])
def test_no_variance(spark, tmp_path, vectors, count):
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op13(spark, str(tmp_path)).collect()
    assert len(got) == count and all(r["whitened"] == 0 and r["deviation"] == 0 and r["explained"] == 0 and r["identity_error"] == 1 for r in got)


def test_deviation_beyond_a_long_is_null():
    own = whitening.Whitening(1 << 20, [(1 << 20) * 100_000], np.ones(1), np.ones((1, 1)), 1.0)
    assert own.deviations(np.array([[100_000], [100_001], [100_000 + (1 << 12)], [100_000 - (1 << 11)]])) == [0, 1 << 40, None, 1 << 62]
