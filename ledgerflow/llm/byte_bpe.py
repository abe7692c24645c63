"""Byte-level BPE: exact encoding and decoding by backtracking over longest matches.

The vocabulary's bytes, mapped to Latin-1, form an Aho-Corasick automaton that finds in
one pass the longest token at each place of a piece. The encoder takes the longest one
that is compatible with the token before it, and else steps back to shorter prefixes; a
place that was left once is never entered again, so the work is linear in the piece.
Two neighbours are compatible if merging their joint bytes in rank order gives the two
back; that is decided from how each token splits into the pair that made it, and kept.

Cases: null counts as the empty text, which has no tokens; texts of any length are
encoded whole; rows that repeat give equal rows; an empty table gives no rows; other
columns are neither read nor returned.
"""

from __future__ import annotations

import base64
import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import as_bytes, by_bytes, kept, map_arrow

#: Pieces of the pattern, chunks between spaces and pairs of ids that a worker keeps
#: with what was found; each starts anew beyond that. Longer pieces aren't kept.
PIECES = 300_000
CHUNKS = 200_000
PAIRS = 300_000
LONG = 100
BETWEEN = re.compile(r"(?<=\S) (?=\S)")


class Bpe:
    """ranks: bytes of a token -> its id, in the order of the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ids = ranks
        self.words = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.words[i] = t
        self.sizes = [*map(len, self.words)]
        self.pattern = regex.compile(pattern)
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        #: Whether the pattern is one that begins a match at each single space.
        self.spaced = pattern.startswith("'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|")
        self._shorter()
        self._splits()
        self.auto = ahocorasick.Automaton()
        for t, i in ranks.items():
            if self.made[i]:
                self.auto.add_word(t.decode("latin-1"), i)
        self.auto.make_automaton()
        self.single = [ranks.get(bytes([b])) for b in range(256)]

    def _shorter(self) -> None:
        """For each token the longest other token that it begins with, or -1."""
        self.prefix = [-1] * len(self.words)
        for t, i in self.ids.items():
            for n in range(len(t) - 1, 0, -1):
                j = self.ids.get(t[:n])
                if j is not None:
                    self.prefix[i] = j
                    break

    def _splits(self) -> None:
        """The pair whose merge makes each token; made: whether any merge can make it."""
        self.left = list(range(len(self.words)))
        self.right = list(range(len(self.words)))
        self.merged: dict[tuple[int, int], int] = {}
        self.made = [False] * len(self.words)
        for t, i in sorted(self.ids.items(), key=lambda x: x[1]):
            if len(t) == 1:
                self.made[i] = True
                continue
            a = self.prefix[i]
            while a >= 0:
                b = self.ids.get(t[len(self.words[a]):])
                if b is not None and a < i and b < i and self.made[a] and self.made[b] and self._fits(a, b):
                    self.left[i], self.right[i] = a, b
                    self.merged[a, b] = i
                    self.made[i] = True
                    break
                a = self.prefix[a]
        for i, a in enumerate(self.prefix):  # the encoder steps over what no merge makes
            while a >= 0 and not self.made[a]:
                a = self.prefix[a]
            self.prefix[i] = a

    def _fits(self, a: int, b: int) -> bool:
        """Whether merges leave a|b as they are. Undo the later of the two merges again and
        again: a merge across the border that would have come earlier breaks the pair."""
        bound = 1 << 62
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < bound:
                return False
            if a > b:
                bound, a = a, self.right[a]
                if a == bound:
                    bound, b = b + 1, self.left[b]
                    if b + 1 == bound:
                        return True
            else:
                bound, b = b + 1, self.left[b]
                if b + 1 == bound:
                    bound, a = a, self.right[a]
                    if a == bound:
                        return True

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        sizes, prefix, pairs = self.sizes, self.prefix, self.pairs
        longest = [*map(self.single.__getitem__, piece)]
        ends = [*range(1, n + 1)]
        for end, i in self.auto.iter(piece.decode("latin-1")):
            # Ends ascend, so the last that is written at a start is the longest.
            start = end + 1 - sizes[i]
            longest[start] = i
            ends[start] = end + 1
        out: list[int] = []
        closed = bytearray(n + 1)
        at, last, token = 0, -1, longest[0]
        end = ends[0]
        while True:
            if not closed[end]:
                if last < 0:
                    fits = True
                else:
                    fits = pairs.get(key := last << 32 | token)
                    if fits is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        fits = pairs[key] = self._fits(last, token)
                if fits:
                    out.append(token)
                    if end == n:
                        return out
                    at, last, token = end, token, longest[end]
                    end = ends[at]
                    continue
            token = prefix[token]
            if token < 0:  # nothing fits after what stands: this place is a dead end
                closed[at] = 1
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1
            end = at + sizes[token]

    def _piece(self, piece: str) -> bytes:
        if len(self.pieces) >= PIECES:
            self.pieces.clear()
        ids = np.array(self.merge(piece.encode("utf-8")), "<u4").tobytes()
        if len(piece) < LONG:
            self.pieces[piece] = ids
        return ids

    def _pattern(self, text: str) -> bytes:
        get, slow = self.pieces.get, self._piece
        return b"".join([get(p) or slow(p) for p in self.pattern.findall(text)])

    def _chunk(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise ValueError("its ends aren't sure to be borders")
        ids = self._pattern(" " + chunk)
        if len(self.chunks) >= CHUNKS:
            self.chunks.clear()
        if len(chunk) < LONG:
            self.chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers. A single space between two
        other characters always begins a match of the pattern, so texts are cut there and
        the chunks' ids kept."""
        get, slow = self.chunks.get, self._chunk
        if not self.spaced:
            return self._pattern(text)
        first, *rest = text.split(" ")
        try:
            if rest and (not first or first[-1].isspace()):
                raise ValueError
            return self._pattern(first) + b"".join([get(c) or slow(c) for c in rest])
        except ValueError:
            first, *rest = BETWEEN.split(text)
            return self._pattern(first) + b"".join([get(c) or self._pattern(" " + c) for c in rest])

    def decode(self, ids: bytes) -> bytes:
        words = self.words
        return b"".join([words[i] for i in np.frombuffer(ids, "<u4").tolist()])


def _loaded(lines: bytes, pattern: str) -> Bpe:
    """The tables and what was found with them stay for the next tasks of this operator."""
    def make():
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}, pattern)

    return kept(__name__, (lines, pattern), make)


def encoded(docs: DataFrame, rank_file: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs, and with keep_ids
    also ids (array of int). The rank file is read here and sent along: 1 MB for 50k ids."""
    with open(rank_file, "rb") as f:
        lines = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(lines)

    def run(batches):
        bpe = _loaded(sent.value, pattern)
        for b in by_bytes(batches, "text", 2 << 20):
            ids = [bpe.encode(t or "") for t in b.column("text").to_pylist()]
            cols = [
                b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols.append(pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_arrow(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, kind)


def decoded(rows: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and the text of each row's ids (null ids: empty)."""
    with open(rank_file, "rb") as f:
        lines = f.read()
    sent = rows.sparkSession.sparkContext.broadcast(lines)

    def run(batches):
        bpe = _loaded(sent.value, pattern)
        for b in batches:
            texts = [bpe.decode(np.asarray(x if x is not None else [], "<u4").tobytes()).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(rows.selectExpr("cast(doc_id as bigint) doc_id", "ids"), run, "doc_id bigint, text string")
