"""The agenda against the library, on texts and ids of all kinds."""

from __future__ import annotations

import hashlib

import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as proto

from ledgerflow.llm import piece_bpe, queries
from tests.llm.test_cases import SF, empty, odd

MODEL = open(P.path(queries.PIECES), "rb").read()
OWN = piece_bpe.Pieces(MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def numbers(ids: bytes) -> list[int]:
    return [*map(int, ids.split())]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab the▁ \n\t\x00é日🙂ﬁ<s>12"), st.characters(exclude_categories=["Cs"]))))
def test_encode_is_the_library(text):
    ids = OWN.encode(text)
    assert numbers(ids) == LIBRARY.encode(text, add_eos=True)
    assert OWN.decode(ids).decode() == LIBRARY.decode(numbers(ids))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([0, 1, 2, 259, 300, 35]), st.integers(3, 258), st.integers(259, 31999))))
def test_decode_is_the_library(ids):
    assert OWN.decode(b" ".join(b"%d" % i for i in ids)).decode() == LIBRARY.decode(ids)


def test_long_runs():
    for text in ("x" * 100_000, " " * 20_000 + "the" * 9_000, "é\n" * 30_000):
        assert numbers(OWN.encode(text)) == LIBRARY.encode(text, add_eos=True)


def test_short_and_long_agendas_agree():
    for text in ("▁tokenization", "▁aaaaaaaaaaaa", "▁▁▁▁▁▁▁▁▁", "▁internationalisation"):
        short = OWN.merge(text)
        try:
            piece_bpe.SHORT, kept = 0, piece_bpe.SHORT
            assert OWN.merge(text) == short
        finally:
            piece_bpe.SHORT = kept


def small(pieces, **trainer):
    """A model of merge type of these (piece, score, type)."""
    m = proto.ModelProto()
    for p, s, t in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *pieces]:
        m.pieces.add(piece=p, score=s, type=t)
    m.trainer_spec.model_type = proto.TrainerSpec.BPE
    for k, v in trainer.items():
        setattr(m.trainer_spec, k, v)
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.remove_extra_whitespaces = False
    return m.SerializeToString()


def test_other_models():
    """Unknown ids in place of bytes, pieces for merges only, whole symbols, pieces over spaces."""
    plain = [("▁", -9, 1), ("a", -10, 1), ("b", -11, 1), ("ab", -1, 1), ("▁ab", -2, 1), ("aba", -3, 5), ("abab", -4, 1)]
    for pieces in (plain, [*plain, ("[X]", 0, 4)], [*plain, ("a▁b", -0.5, 1)], plain[1:]):
        model = small(pieces)
        own, lib = piece_bpe.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)
        for text in ("", "ab", "abab aba", "zz abz", "a b", " ab  ab ", "[X]ab[X]", "aabab[X", "ab zz", "z z"):
            ids = own.encode(text)
            assert numbers(ids) == lib.encode(text, add_eos=True), (text, pieces)
            assert own.decode(ids).decode() == lib.decode(numbers(ids))


def test_a_wrong_chunk_is_told():
    own = piece_bpe.Pieces(MODEL)
    own.cost["qz"] = -1e12
    own.encode("fine qzqz")
    own.check()
    assert own.wrong == {"▁qzqz"}


def test_aged_chunks_are_found_again(monkeypatch):
    monkeypatch.setattr(piece_bpe, "CHUNKS", 3)
    own = piece_bpe.Pieces(MODEL)
    for text in ("a b c", "d a e", "a f g h a"):
        assert numbers(own.encode(text)) == LIBRARY.encode(text, add_eos=True)
    assert len(own.chunks) <= 3 and len(own.aged) <= 3


def test_rows(spark):
    d = odd(spark)
    got = piece_bpe.encoded(d, P.path(queries.PIECES), keep_ids=True).collect()
    want = []
    for r in d.select("doc_id", "text").collect():
        ids = LIBRARY.encode(r.text or "", add_eos=True)
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest(), True))
    assert sorted(map(str, [tuple(r)[:5] for r in got])) == sorted(map(str, want))
    back = piece_bpe.decoded(spark.createDataFrame([(r.doc_id, r.ids) for r in got], "doc_id long, ids array<int>"), P.path(queries.PIECES)).collect()
    assert sorted(str(tuple(r)) for r in back) == sorted(str((r.doc_id, LIBRARY.decode(r.ids))) for r in got)
    assert piece_bpe.encoded(empty(spark), P.path(queries.PIECES)).count() == 0


def test_query_agrees_with_the_library(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op11_sentencepiece(spark, SF).collect()
    assert len(rows) == len(texts) and all(r.agrees for r in rows)
    for r in rows:
        ids = LIBRARY.encode(texts[r.doc_id] or "", add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
