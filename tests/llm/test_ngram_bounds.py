"""The parities rule out no similar pair: near copies around the threshold, by brute force."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerflow.llm import ngram_join
from tests.llm.test_cases import DOCS


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=900), st.sets(st.integers(0, 2**64 - 1), max_size=60), st.integers(0, 900))
def test_parities_bound_the_difference(shared, other, cut):
    a = np.array(sorted(shared), np.uint64)
    b = np.array(sorted({*sorted(shared)[cut:], *other}), np.uint64)
    x, y = ngram_join.parities(a), ngram_join.parities(b)
    assert len(x) == ngram_join.BITS // 64
    bits = sum(bin(int(p) & (1 << 64) - 1 ^ int(q) & (1 << 64) - 1).count("1") for p, q in zip(x.tolist(), y.tolist()))
    assert bits <= len({*a.tolist()} ^ {*b.tolist()})


def near_copies(seed, n, words=60):
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for k in rng.choice(words, rng.integers(0, 4), replace=False):
            t[k] = f"x{rng.integers(0, 5)}"
        out.append(" ".join(t))
    return out


def brute(texts):
    sets = [{" ".join(w[k:k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = [*range(len(texts))]

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {k: top(k) for k in range(len(texts))}


def test_all_pairs_lose_no_link(spark, monkeypatch):
    texts = near_copies(1, 70) + near_copies(2, 50, 200)
    d = spark.createDataFrame([(k, t, None, None, None, None, None, None, None) for k, t in enumerate(texts)], DOCS)
    want = brute(texts)
    assert len(set(want.values())) > 3
    for rounds in ((), ngram_join.ROUNDS):
        monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
        assert {r.doc_id: r.component_id for r in ngram_join.join_documents(d).collect()} == want
