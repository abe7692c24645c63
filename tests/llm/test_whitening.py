"""Whitening against numpy and whole numbers of any size, on the table and on odd vectors."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from ledgerflow.llm import queries, whitening
from tests.llm.test_cases import SF

KIND = "vec_id long, embedding array<double>, n long, whitened double, label int"


def x_of(v):
    return [max(-2**63, min(2**63 - 1, math.floor(64 * Fraction(c)) + 1_000_000)) for c in v]


def check(rows, vectors, most=32):
    """vectors: those that stay, by vec_id."""
    x = {i: x_of(v) for i, v in vectors.items()}
    n, d = len(x), len(next(iter(x.values())))
    s = [sum(v[k] for v in x.values()) for k in range(d)]
    y = {i: [n * v[k] - s[k] for k in range(d)] for i, v in x.items()}
    cov = np.array([[float(Fraction(sum(v[i] * v[j] for v in y.values()), n**3)) for j in range(d)] for i in range(d)])
    e = np.linalg.eigvalsh(cov)[::-1]
    assert len(rows) == n * min(d, most) and {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1
    z = {}
    for r in rows:
        far = sum(c * c for c in y[r.vec_id])
        assert r.deviation == (far if far < 2**63 else None)
        assert r.explained == pytest.approx(max(e[r.component - 1], 0) / e.sum() if e.sum() > 0 else 0, rel=1e-4, abs=1e-12)
        z[r.vec_id, r.component] = r.whitened
    live = [k for k in range(min(d, most)) if z[next(iter(x)), k + 1] is not None]
    if live:
        w = np.array([[z[i, k + 1] for k in live] for i in x])
        got = w.T @ w / n
        assert rows[0].identity_error == pytest.approx(np.abs(got - np.eye(len(live))).max(), abs=1e-9) and rows[0].identity_error <= 1e-4
        # Each column is V's eigenvector, up to its sign: cov(y/n, z) = V u / sqrt(e) = u sqrt(e).
        u = (np.array([[c / n for c in y[i]] for i in x]).T @ w / n) / np.sqrt(e[live])
        assert np.abs(u.T @ u - np.eye(len(live))).max() < 1e-6
        assert np.abs(cov @ u - u * e[live]).max() < 1e-6 * max(e[0], 1)
    return live


def test_table(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert len(check(queries.op13_whitening(spark, SF).collect(), vectors)) == 32


def test_odd_vectors(spark):
    good = {k: [float(np.sin(k * 3 + j)) for j in range(5)] + [0.25] for k in range(40)}
    bad = [(90, None), (91, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (92, [float("nan")] * 6), (93, [float("inf")] + [0.0] * 5), (94, []), (95, [1.0] * 7)]
    rows = [(k, v, 5, 0.5, None) for k, v in [*good.items(), *bad]]
    got = whitening.whitened(spark.createDataFrame(rows, KIND).repartition(7)).collect()
    live = check(got, good)
    assert live == [0, 1] or len(live) >= 2  # the last dimension is one value: it has no component
    assert len(live) < 6 and all(r.whitened is None and r.explained == 0 for r in got if r.component - 1 not in live)


def test_huge_and_few(spark):
    huge = {1: [1e300, -1e300, 3e15], 2: [-1e18, 0.0, 1e16], 3: [5.5, 1e17, -2e16], 4: [0.0, 1.0, 2.0]}
    got = whitening.whitened(spark.createDataFrame([(k, v, 1, 0.0, 1) for k, v in huge.items()], KIND)).collect()
    check(got, huge)
    assert all(r.deviation is None for r in got)
    one = whitening.whitened(spark.createDataFrame([(1, [0.5, -0.5], 1, 0.0, 1)], KIND)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]


def test_repeated_and_null_ids(spark):
    rows = [(None, [0.1, 0.9], 1, 0.0, 1), (None, [0.4, 0.2], 1, 0.0, 1), (3, [0.4, 0.2], 1, 0.0, 1), (3, [0.4, 0.2], 1, 0.0, 1)]
    got = whitening.whitened(spark.createDataFrame(rows, KIND)).collect()
    assert len(got) == 8 and sum(r.vec_id is None for r in got) == 4
    same = {(r.component, r.whitened) for r in got if r.vec_id == 3}
    assert len(same) == 2


@pytest.mark.parametrize("rows", [[], [(1, None, 1, 0.0, 1), (2, [], 1, 0.0, 1)]])
def test_none_stay(spark, rows):
    assert whitening.whitened(spark.createDataFrame(rows, KIND)).count() == 0


def test_polarisation_is_exact(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-2**20, 2**20, (200, 4)) / 64
    df = spark.createDataFrame([(k, [float(c) for c in r], 1, 0.0, 1) for k, r in enumerate(v)], KIND).select("vec_id", "embedding").repartition(5)
    n, s = whitening.sums_of(df)
    x = [x_of(r) for r in v]
    assert (n, s) == (200, [sum(c) for c in zip(*x)])
    got = whitening.squares_of(df, n, s)
    y = [[n * c - t for c, t in zip(r, s)] for r in x]
    for i in range(4):
        for j in range(i, 4):
            assert got[i, j] == sum((r[i] + (r[j] if i != j else 0)) ** 2 for r in y)
