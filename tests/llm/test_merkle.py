"""The manifest against a plain tree, with blocks of every size and odd rows."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest

from ledgerflow.llm import merkle_manifest as M
from ledgerflow.llm.merkle_manifest import Witnesses, digest, height_of
from tests.llm.test_cases import empty, odd


def runs_of(nodes, fan):
    return [nodes[k:k + fan] for k in range(0, len(nodes), fan)]


def plain(nodes, fan):
    """The root, and for each node its siblings level by level."""
    beside = [[] for _ in nodes]
    at = [*range(len(nodes))]
    while len(nodes) > 1:
        for k, a in enumerate(at):
            run = nodes[a - a % fan:a - a % fan + fan]
            beside[k].append((run[:a % fan], run[a % fan + 1:]))
        at = [a // fan for a in at]
        nodes = [digest("".join(r)) for r in runs_of(nodes, fan)]
    return nodes[0], beside


@pytest.mark.parametrize("fan", [2, 8])
def test_witnesses_grow_to_those_of_the_whole_tree(fan):
    for n in [*range(1, 20), 63, 64, 65, 512, 513]:
        nodes = [digest(str(k)) for k in range(n)]
        tree = Witnesses(height_of(n, 99, fan), fan)
        for k, x in enumerate(nodes):
            tree.append(x)
            if tree.height:  # what came so far in the open run is each one's partial witness
                assert tree.left[0][k] == "".join(nodes[k - k % fan:k]) and tree.right[0][k] == ""
        root, beside = plain(nodes, fan)
        assert tree.close() == root
        for k in range(n):
            assert tree.of(k) == ["".join(a) + "|" + "".join(b) for a, b in beside[k]]


def expected(rows, fan=8):
    """The contract's rows, from whole lists."""
    def h(r, text):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))

    trees = defaultdict(list)
    for r in rows:
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        other = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text) if hit and r.text is not None else r.text
        trees[b"" if r.lang is None else b"1" + r.lang.encode()].append(((r.doc_id is not None, r.doc_id or 0, h(r, r.text)), r, h(r, other)))
    grown = {g: plain([x[0][2] for x in sorted(v, key=lambda x: x[0])], fan) for g, v in sorted(trees.items())}
    root, above = plain([x[0] for x in grown.values()], fan)
    out = []
    for t, (g, (subroot, beside)) in enumerate(grown.items()):
        for k, (key, r, other) in enumerate(sorted(trees[g], key=lambda x: x[0])):
            node, siblings = other, ""
            for a, b in beside[k] + above[t]:
                node = digest("".join(a) + node + "".join(b))
                siblings += "".join(a + b)
            out.append((r.doc_id, key[2], subroot, root, digest(siblings), node, node == root))
    return sorted(map(str, out))


@pytest.mark.parametrize("fan,levels", [(8, 3), (2, 1), (2, 2), (3, 1)])
def test_manifest(spark, fan, levels):
    d = odd(spark).cache()
    assert sorted(str(tuple(r)) for r in M.proofs(d, fan, levels).collect()) == expected(d.collect(), fan)


def test_many_languages_and_one(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    many = spark.createDataFrame([(k, f"Text {k}", f"l{k % 21}é" if k % 5 else None, "s", 6) for k in range(150)], kind).cache()
    assert sorted(str(tuple(r)) for r in M.proofs(many, 2, 1).collect()) == expected(many.collect(), 2)
    one = many.where("doc_id = 7")
    assert sorted(str(tuple(r)) for r in M.proofs(one).collect()) == expected(one.collect())
    r = M.proofs(one).first()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == hashlib.sha256(b"").hexdigest()


def test_one_language(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    d = spark.createDataFrame([(k, "T" * (k % 9), "en", None, None) for k in range(700)], kind).cache()
    got = M.proofs(d).collect()
    assert sorted(str(tuple(r)) for r in got) == expected(d.collect())
    assert {r.verified for r in got} == {True, False}


def test_empty(spark):
    assert M.proofs(empty(spark)).count() == 0
