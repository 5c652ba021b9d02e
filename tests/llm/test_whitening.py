"""Whitening against exact fractions, with offsets that plain float64 sums lose, and odd tables."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from metrika.llm import whitening as W


def exact(vectors):
    """x, n, sums and covariance as fractions."""
    x = [[math.floor(W.SCALE * float(c)) + W.OFFSET for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    cov = [[sum((Fraction(r[i]) - Fraction(s[i], n)) * (Fraction(r[j]) - Fraction(s[j], n)) for r in x) / n for j in range(d)] for i in range(d)]
    return x, n, s, cov


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v) for i, v in zip(ids or range(len(vectors)), vectors)], "vec_id long, embedding array<double>")


def some(n=300, d=6, seed=0, offset=0.0):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) @ r.normal(size=(d, d)) + offset).tolist()


@pytest.mark.parametrize("offset", [0.0, 1e9, 1e13])
def test_fit_equals_exact_covariance(spark, offset):
    vectors = some(offset=offset)
    x, n, s, cov = exact(vectors)
    made = W.fit(spark, frame(spark, vectors), "embedding", 4)
    assert (made.n, made.sums) == (n, s)
    v = np.array([[float(c) for c in row] for row in cov])
    e = np.linalg.eigvalsh(v)[::-1]
    assert np.allclose(made.eigenvalues, e[:4], rtol=1e-12) and np.isclose(made.trace, np.trace(v), rtol=1e-14)
    assert np.abs(v @ made.vectors - made.vectors * made.eigenvalues).max() < 1e-12 * e[0]


def test_query_rows(spark, tmp_path):
    vectors = some(seed=2, offset=50.0)
    odd = [None, [], [1.0] * 5, [1.0, None] + [0.0] * 4, [float("nan")] * 6, [float("inf")] + [0.0] * 5]
    frame(spark, vectors + odd, [*range(len(vectors)), *[None] * 6]).write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = W.query(spark, str(tmp_path)).collect()
    assert len(rows) == len(vectors) * 6 and all(isinstance(r.component, int) for r in rows)
    x, n, s, cov = exact(vectors)
    v = np.array([[float(c) for c in row] for row in cov])
    e, q = (a[..., ::-1] for a in np.linalg.eigh(v))
    want = np.array([[float(Fraction(c) - Fraction(t, n)) for c, t in zip(r, s)] for r in x]) @ q / np.sqrt(e)
    got = np.zeros_like(want)
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == sum((n * c - t) ** 2 for c, t in zip(x[r.vec_id], s)) and r.n == n
        assert abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-10 and r.identity_error < 1e-10
    signs = np.sign((got * want).sum(0))
    assert np.abs(got - want * signs).max() < 1e-9
    assert np.abs(np.cov(got.T, bias=True) - np.eye(6)).max() < 1e-10


@pytest.mark.parametrize("bits", [10, 24, 45, 70, 130])
def test_gram_is_exact(bits):
    r = random.Random(bits)
    y = np.array([[r.randrange(-(2**bits), 2**bits) for _ in range(3)] for _ in range(9000)], object)
    largest = max(abs(v) for v in y.ravel())
    gram = W.Gram(3, largest)
    gram.add(y.astype(np.int64) if largest < 2**62 else y)
    assert (gram.settle() == y.T.dot(y)).all()


def test_plain_sums_would_lose_the_offset(spark):
    """What float64 sums of products say of entries far from 0."""
    x = np.array(exact(some(offset=1e13))[0], np.float64)
    plain = x.T @ x / len(x) - np.outer(x.mean(0), x.mean(0))
    made = W.fit(spark, frame(spark, some(offset=1e13)), "embedding")
    assert abs(np.trace(plain) / made.trace - 1) > 1e-2


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_no_components(spark, vectors):
    assert W.fit(spark, frame(spark, vectors), "embedding") is None


def test_rank_huge_entries_and_clashing_columns(spark):
    vectors = [[float(i), 2.0 * i, 1e300 if i == 3 else -1e300] for i in range(6)]
    df = frame(spark, vectors, [1, 1, None, 4, 5, 6]).selectExpr("vec_id", "embedding", "1 as DEVIATION", "'x' as size")
    made = W.fit(spark, df, "embedding")
    assert len(made.eigenvalues) == 1 and made.n == 6  # the others vanish beside entries of 2**62
    got = W.whiten(df, "embedding", made).collect()
    assert got[0].asDict().keys() == {"vec_id", "embedding", "size", "deviation", "whitened"} and len(got) == 6
    assert all(r.deviation is None for r in got)


def test_floats_and_many_partitions(spark):
    df = frame(spark, some(500, 4)).selectExpr("vec_id", "cast(embedding as array<float>) embedding")
    a, b = W.fit(spark, df.repartition(7), "embedding"), W.fit(spark, df.coalesce(1), "embedding")
    assert a.sums == b.sums and (a.eigenvalues == b.eigenvalues).all()
