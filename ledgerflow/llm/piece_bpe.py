"""SentencePiece encoding and decoding for merge-type vocabularies: an agenda of adjacent
symbol pairs, best score first.

A text is its characters; the agenda holds each neighbouring pair whose joint string is a
piece, and the best one (of equal ones the leftmost) is merged until none is left. An entry
is stale, and skipped, if either symbol has changed since. No piece has a space mark after
another character, so nothing merges across the place before a run of marks: texts are cut
there and the chunks' ids kept. Where a vocabulary has such pieces, texts stay whole.
What isn't a piece becomes byte pieces, or the unknown id where the model has none.

Each Arrow batch's chunks that were encoded by the agenda are encoded by the sentencepiece
library too; `agrees` tells whether all of a row's chunks came out the same.

Cases: null counts as the empty text, whose only id is the end id and which decodes to the
empty text; texts of any length are encoded whole, in some times their size of memory; rows
that repeat (and equal doc_ids) give a row each; an empty table gives no rows; other columns
are neither read nor returned, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from heapq import heapify, heappop, heappush

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as proto

from .common import by_bytes, kept, map_arrow

#: Chunks of up to LONG characters that a worker keeps with their ids: twice CHUNKS at most, as
#: those that weren't met again while CHUNKS others came are dropped.
CHUNKS, LONG = 400_000, 60
#: Up to so many characters the agenda is a plain list, beyond a heap.
SHORT, NEVER = 24, float("inf")
MARK = "▁"
_CUT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


class Pieces:
    """The tables of one model file."""

    def __init__(self, model: bytes):
        m = proto.ModelProto()
        m.ParseFromString(model)
        if m.trainer_spec.model_type != proto.TrainerSpec.BPE:
            raise ValueError("the model isn't of the merge type")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = m.normalizer_spec
        #: Whether texts go through no table of characters and keep all their spaces.
        self.plain = not spec.precompiled_charsmap and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not m.trainer_spec.treat_whitespace_as_suffix
        self.dummy, self.trims = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.cost: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, bytes] = {}
        self.user, self.unused = set(), set()
        self.end = self.unknown = -1
        for i, p in enumerate(m.pieces):
            if p.type in (_NORMAL, _USER, _UNUSED):
                self.cost[p.piece] = -p.score
            if p.type == _USER:
                self.user.add(p.piece)
            elif p.type == _UNUSED:
                self.unused.add(p.piece)
            elif p.type == _BYTE:
                self.bytes[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.type == _UNKNOWN:
                self.unknown = i
            self.ids[p.piece] = i
        self.digits = {p: b"%d" % i for p, i in self.ids.items()}
        self.end = self.ids[m.trainer_spec.eos_piece]
        self.of_byte = {b[0]: i for i, b in self.bytes.items()} if m.trainer_spec.byte_fallback else {}
        self.starts = re.compile("|".join(map(re.escape, sorted(self.user, key=len, reverse=True)))) if self.user else None
        self.cuts = self.plain and self.dummy and not any(MARK in p.lstrip(MARK) for p in self.cost) and (MARK in self.ids or bool(self.of_byte))
        hidden = {i for i, p in enumerate(m.pieces) if p.type == _CONTROL}
        #: What each id stands for in a decoded text, by its decimal digits.
        self.surface = {str(i).encode(): b"" if i in hidden else m.trainer_spec.unk_surface.encode() if i == self.unknown else self.bytes.get(i) or p.piece.replace(MARK, " ").encode() for i, p in enumerate(m.pieces)}
        self.hidden, self.is_byte = {str(i).encode() for i in hidden}, {str(i).encode() for i in self.bytes}
        self.chunks: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}
        self.fresh: dict[str, bytes] = {}
        self.wrong: set[str] = set()

    def normal(self, text: str) -> str:
        if not self.plain:
            return self.library.normalize(text)
        text = text.replace(" ", MARK)
        return MARK + text if text and self.dummy else text

    def symbols(self, text: str) -> tuple[list[str], set[int]]:
        """Characters, and symbols that the model's user named whole, with the latter's places."""
        if self.starts is None:
            return list(text), set()
        out, frozen, at = [], set(), 0
        for m in self.starts.finditer(text):
            out += text[at:m.start()]
            frozen.add(len(out))
            out.append(m[0])
            at = m.end()
        return out + list(text[at:]), frozen

    def merge(self, text: str) -> list[str]:
        """The pieces of a normalised text, by the agenda."""
        if len(text) <= SHORT and self.starts is None and not self.unused:
            return self._merge_short(text)
        parts, frozen = self.symbols(text)
        n, cost, made_of = len(parts), self.cost.get, {}
        before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
        agenda = []
        for k in range(n - 1):
            both = parts[k] + parts[k + 1]
            c = cost(both)
            if c is not None and k not in frozen and k + 1 not in frozen:
                agenda.append((c, k, len(both)))
                if both in self.unused:
                    made_of[both] = parts[k], parts[k + 1]
        heapify(agenda)
        while agenda:
            _, k, size = heappop(agenda)
            j = after[k]
            if j >= n or not parts[k] or len(parts[k]) + len(parts[j]) != size:
                continue
            parts[k] += parts[j]
            parts[j] = ""
            after[k] = far = after[j]
            if far < n:
                before[far] = k
            for a, b in ((before[k], k), (k, far)):
                if a >= 0 and b < n and a not in frozen and b not in frozen:
                    both = parts[a] + parts[b]
                    c = cost(both)
                    if c is not None:
                        heappush(agenda, (c, a, len(both)))
                        if both in self.unused:
                            made_of[both] = parts[a], parts[b]
        out = [p for p in parts if p]
        return [q for p in out for q in self._again(p, made_of)] if made_of else out

    def _merge_short(self, text: str) -> list[str]:
        """The same for a few characters: the agenda is a list, whose best entry is its least."""
        parts, cost = [*text], self.cost.get
        agenda = [cost(a + b, NEVER) for a, b in zip(parts, text[1:])]
        while agenda and (best := min(agenda)) != NEVER:
            k = agenda.index(best)
            parts[k] = both = parts[k] + parts.pop(k + 1)
            del agenda[k]
            if k:
                agenda[k - 1] = cost(parts[k - 1] + both, NEVER)
            if k < len(agenda):
                agenda[k] = cost(both + parts[k + 1], NEVER)
        return parts

    def _again(self, piece: str, made_of: dict) -> list[str]:
        """A piece that is for merges only, as the pieces that it was made of."""
        out, todo = [], [piece]
        while todo:
            p = todo.pop()
            if p in self.unused and p in made_of:
                todo += made_of[p][::-1]
            else:
                out.append(p)
        return out

    def numbers(self, pieces: Iterable[str]) -> list[int]:
        out: list[int] = []
        last = -1
        for p in pieces:
            i = self.ids.get(p, self.unknown)
            if i != self.unknown:
                out.append(i)
            elif self.of_byte:
                out += map(self.of_byte.__getitem__, p.encode())
            elif last != self.unknown:  # a run of unknown pieces is one
                out.append(i)
            last = i
        return out

    def _chunk(self, chunk: str) -> bytes:
        ids = self.aged.get(chunk)
        if ids is None:
            ids = self.fresh[chunk] = self._ids(self.merge(chunk))
        if len(chunk) <= LONG:
            if len(self.chunks) >= CHUNKS:
                self.aged, self.chunks = self.chunks, {}
            self.chunks[chunk] = ids
        return ids

    def _ids(self, pieces: list[str]) -> bytes:
        try:
            return b" ".join([self.digits[p] for p in pieces])
        except KeyError:  # some aren't in the vocabulary
            return b" ".join([b"%d" % i for i in self.numbers(pieces)])

    def pieces_of(self, text: str) -> list[str]:
        text = self.normal(text)
        return _CUT.findall(text) if self.cuts else [text] if text else []

    def encode(self, text: str) -> bytes:
        """The decimal ids with a space between them, the end id last."""
        get, slow = self.chunks.get, self._chunk
        return b" ".join([*[get(c) or slow(c) for c in self.pieces_of(text)], b"%d" % self.end])

    def decode(self, ids: bytes) -> bytes:
        """The text of decimal ids; of what isn't UTF-8 each byte becomes U+FFFD."""
        tokens = ids.split()
        # An id without a surface ends a run of bytes.
        text = b"".join(map(self.surface.__getitem__, tokens)) if self.hidden.isdisjoint(tokens[:-1]) else self._mended(tokens)
        try:
            text.decode()
        except UnicodeDecodeError:
            text = self._mended(tokens)
        first = next((t for t in tokens if t not in self.hidden), None)
        if text[:1] == b" " and (self.dummy or self.trims) and first not in self.is_byte and first != b"%d" % self.unknown:
            return text.lstrip(b" ") if self.trims else text[1:]
        return text

    def _mended(self, tokens: list[bytes]) -> bytes:
        """Each run of byte pieces is decoded on its own."""
        out, run = [], b""
        for t in [*tokens, b""]:
            if t in self.is_byte:
                run += self.surface[t]
                continue
            while run:
                n = 1 if run[0] < 0x80 else 2 if run[0] < 0xE0 else 3 if run[0] < 0xF0 else 4
                try:
                    out.append(run[:n].decode().encode())
                except UnicodeDecodeError:
                    n = 1
                    out.append("�".encode())
                run = run[n:]
            out.append(self.surface[t] if t else b"")
        return b"".join(out)

    def check(self) -> None:
        """Hold what the agenda gave since the last check against the library."""
        # The library puts a mark before each text but the empty one; the chunk has it already.
        names = [c for c in self.fresh if c != MARK]
        for c, ids in zip(names, self.library.encode([c[1:] for c in names], num_threads=1)):
            if self.fresh[c] != b" ".join([b"%d" % i for i in ids]):
                self.wrong.add(c)
        self.fresh = {}


def _loaded(model: bytes) -> Pieces:
    return kept(__name__, model, lambda: Pieces(model))


def encoded(docs: DataFrame, model_file: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, agrees of each row of docs, and with
    keep_ids also ids (array of int). The model file is read here and sent along: some
    hundred KB for 32k pieces. Models whose texts stay whole are checked by whole texts."""
    with open(model_file, "rb") as f:
        model = f.read()

    def run(batches):
        own = _loaded(model)
        for b in by_bytes(batches, "text", 2 << 20):
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids = [own.encode(t) for t in texts]
            if own.cuts:
                own.check()
                agrees = [not own.wrong or own.wrong.isdisjoint(own.pieces_of(t)) for t in texts]
            else:
                own.fresh = {}
                agrees = [x.split() == [b"%d" % i for i in y] for x, y in zip(ids, own.library.encode(texts, add_eos=True, num_threads=1))]
            cols = [
                b.column("doc_id"), pa.array([x.count(b" ") + 1 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids]),
                pa.array(agrees, pa.bool_()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"]
            if keep_ids:
                cols.append(pa.array([[*map(int, x.split())] for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, agrees boolean" + ", ids array<int>" * keep_ids
    return map_arrow(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, kind)


def decoded(rows: DataFrame, model_file: str) -> DataFrame:
    """doc_id and the text of each row's ids (null ids: empty)."""
    with open(model_file, "rb") as f:
        model = f.read()

    def run(batches):
        own = _loaded(model)
        for b in batches:
            texts = [own.decode(b" ".join([b"%d" % i for i in x or []])).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(rows.selectExpr("cast(doc_id as bigint) doc_id", "ids"), run, "doc_id bigint, text string")
