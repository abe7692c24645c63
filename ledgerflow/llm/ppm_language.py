"""Language ID: prediction by partial matching under frozen statistics.

For each language a context tree of bytes, up to ORDER deep, holds how often each byte
followed. A text costs, byte by byte, -log2 of n/(n+d) in the deepest context that knows
the byte, plus -log2 of the escape d/(n+d) of every known deeper context (n followers,
d of them distinct; without exclusion); below the root all bytes cost 8 bits. The
language with the shortest code wins. The trees are kept as one table of the grams of
each length: the code of a gram's last byte, and the escape of the gram as a context,
for all languages at once, so a text is scored in a few array operations.

The trees are fitted on at most SAMPLE rows of each language (the least hashes of doc_id)
of those that may be learned from; every text is scored whole. All languages are
learned, LANGUAGES of them in a model, and a text is scored by each model in turn.

Cases: null or letterless texts are `und` with score 0; ties go to the first language by
name; with no language to learn all are `und`; a null doc_id counts as the empty text in
the fold's hash; rows that repeat give equal rows; an empty table gives no rows; texts of
any length are scored whole, in pieces of PIECE bytes that carry the context before them;
columns other than doc_id, text and lang are not read, whatever their names.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_bytes, by_bytes, crc_mod, map_arrow, partitions

ORDER = 3
SAMPLE = 300
#: Languages of one model: a byte of text needs 4 bytes for each while it is scored.
LANGUAGES = 16
#: Bytes of a text that are counted or scored at once, and parts of a language's rows of
#: which each finds its least hashes on its own.
PIECE, SALTS = 1 << 18, 32
#: Sampled rows that may be broadcast; more are joined by a shuffle.
SMALL = 500_000
FOLDS, HELD_OUT = 3, 1
LETTER = regex.compile(r"\p{L}")  # numerals such as ½ or Ⅷ are none
START = b"\n" * ORDER  # what stands before each text


def _grams(data: np.ndarray, m: int) -> np.ndarray:
    """For each place the m bytes that end there, as a number (m at most 4)."""
    x = data.astype(np.uint32)
    out = x.copy()
    for k in range(1, m):
        out[k:] |= x[:-k] << np.uint32(8 * k)
    return out


def _pieces(texts: list[bytes]):
    """Groups of (text, context, piece) of about PIECE bytes: all texts, cut where they are
    long; a piece's context is START or the ORDER bytes before it."""
    some, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t)), PIECE):
            some.append((i, (START + t[:at])[-ORDER:] if at < ORDER else t[at - ORDER:at], t[at:at + PIECE]))
            size += len(some[-1][2])
            if size >= PIECE:
                yield some
                some, size = [], 0
    if some:
        yield some


def _joined(some: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All pieces, each after its context, and the places where these begin."""
    data = np.frombuffer(b"".join([p for _, c, t in some for p in (c, t)]), np.uint8)
    sizes = np.array([len(t) + ORDER for _, _, t in some], np.int64)
    return data, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Grams and counts of parts as one."""
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)


def count(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For m of 1 to ORDER+1 the grams that end inside a text, and how often."""
    found: list[list] = [[] for _ in range(ORDER + 1)]
    for some in _pieces(texts):
        data, starts = _joined(some)
        inside = np.ones(len(data), bool)
        for k in range(ORDER):
            inside[starts + k] = False
        for m in range(1, ORDER + 2):
            found[m - 1] = [added([*found[m - 1], np.unique(_grams(data, m)[inside], return_counts=True)])]
    return [x[0] if x else (np.zeros(0, np.uint32), np.zeros(0, np.int64)) for x in found]


class Table:
    """Keys -> rows, by open addressing in arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 3 + 1))))
        size = 1 << self.bits
        self.keys, self.rows = np.zeros(size, np.uint32), np.full(size, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.rows[slot] < 0
            cand, at = left[free], slot[free]
            self.rows[at] = cand  # of several for a slot one stays
            self.keys[at] = keys[cand]
            lost = np.ones(len(left), bool)
            lost[free] = self.rows[at] != cand
            left, slot = left[lost], slot[lost] + 1 & size - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435769) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.rows[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot = slot[open_]
        while len(open_):
            slot = slot + 1 & (1 << self.bits) - 1
            row = self.rows[slot]
            out[open_] = row
            more = (row >= 0) & (self.keys[slot] != keys[open_])
            open_, slot = open_[more], slot[more]
        return out


class Model:
    """counts: a language -> what count() gives of its texts."""

    def __init__(self, counts: dict[str, list[tuple[np.ndarray, np.ndarray]]]):
        self.langs = sorted(counts)
        L = len(self.langs)
        # Contexts count as grams of their own length: those before a text's start are no others.
        self.keys = [np.unique(np.concatenate([x for k in self.langs for x in (counts[k][m][0], *(counts[k][m + 1][0] >> np.uint32(8) for _ in range(m < ORDER)))])) for m in range(ORDER + 1)]
        self.code = [np.zeros((len(k), L), np.float32) for k in self.keys]
        self.escape = [np.zeros((len(k), L), np.float32) for k in self.keys]
        self.root = np.zeros(L, np.float32)
        for j, lang in enumerate(self.langs):
            for m in range(ORDER + 1):
                grams, n = counts[lang][m]
                context = grams >> np.uint32(8)
                ctx, back = np.unique(context, return_inverse=True)
                total = np.bincount(back, n).astype(np.float64)
                kinds = np.bincount(back).astype(np.float64)
                out = -np.log2(kinds / (total + kinds))
                row = np.searchsorted(self.keys[m], grams)
                # First as if unknown here: the shorter context's code, after an escape if
                # this language knows the context; then what it does know.
                if m == 0:
                    self.code[0][:, j] = 8.0 + out[0]
                    self.root[j] = out[0]
                else:
                    shorter = np.searchsorted(self.keys[m - 1], self.keys[m] & np.uint32((1 << 8 * m) - 1))
                    own = self.keys[m] >> np.uint32(8)
                    at = np.minimum(np.searchsorted(ctx, own), len(ctx) - 1)
                    self.code[m][:, j] = self.code[m - 1][shorter, j] + np.where(ctx[at] == own, out[at], 0)
                    at = np.searchsorted(self.keys[m - 1], ctx)
                    known = (at < len(self.keys[m - 1]))
                    known[known] = self.keys[m - 1][at[known]] == ctx[known]
                    self.escape[m - 1][at[known], j] = out[known]
                self.code[m][row, j] = -np.log2(n / (total + kinds)[back])
        self.tables = [Table(k) for k in self.keys]

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """The code length of each text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        for some in _pieces(texts):
            np.add.at(out, np.array([i for i, _, _ in some]), self._bits(some))
        return out

    def _bits(self, some: list[tuple[int, bytes, bytes]]) -> np.ndarray:
        data, starts = _joined(some)
        grams = _grams(data, ORDER + 1)
        cost = np.zeros((len(data), len(self.langs)), np.float32)
        left = np.arange(len(data))
        for m in range(ORDER, -1, -1):
            key = grams[left] & np.uint32((1 << 8 * (m + 1)) - 1)
            row = self.tables[m].find(key)
            hit = row >= 0
            if len(left) == len(data):
                cost[hit] = self.code[m][row[hit]]
            else:
                cost[left[hit]] += self.code[m][row[hit]]
            left, key = left[~hit], key[~hit]
            if not len(left):
                break
            if m:
                ctx = self.tables[m - 1].find(key >> np.uint32(8))
                known = ctx >= 0
                cost[left[known]] += self.escape[m - 1][ctx[known]]
            else:
                cost[left] += 8.0 + self.root
        for k in range(ORDER):
            cost[starts + k] = 0
        return np.add.reduceat(cost, starts, axis=0, dtype=np.float64)


def train(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, sample: int = SAMPLE) -> dict:
    may = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & (crc_mod(F.col("doc_id"), folds) != held_out))
    # The least hashes of each part of a language, then of these: no task gets a whole language.
    parted = may.withColumn("_h", F.xxhash64("doc_id")).withColumn("_part", F.pmod("_h", F.lit(SALTS)))
    few = parted.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_part").orderBy("_h", "doc_id"))).where(F.col("_n") <= sample)
    ids = few.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))).where(F.col("_n") <= sample).select("doc_id", "lang").distinct()
    small = may.select("lang").distinct().count() * sample <= SMALL
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(ids) if small else ids, ["doc_id", "lang"]).where(F.col("text").isNotNull())

    def run(batches):
        for b in by_bytes(batches, "text"):
            texts: dict = {}
            for lang, t in zip(b.column("lang").to_pylist(), as_bytes(b.column("text"))):
                texts.setdefault(lang, []).append(t)
            for lang, some in texts.items():
                grams = count(some)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(range(len(grams)), pa.int32()), pa.array([g.tobytes() for g, _ in grams], pa.binary()), pa.array([n.astype(np.int64).tobytes() for _, n in grams], pa.binary())], ["lang", "m", "keys", "n"])

    # Distinct grams of a bounded sample, added up as they come.
    counts: dict = {}
    for r in map_arrow(rows.coalesce(partitions(docs.sparkSession)), run, "lang string, m int, keys binary, n binary").toLocalIterator():
        part = (np.frombuffer(r["keys"], np.uint32), np.frombuffer(r["n"], np.int64))
        known = counts.setdefault(r["lang"], [None] * (ORDER + 1))
        known[r["m"]] = part if known[r["m"]] is None else added([known[r["m"]], part])
    return counts


def identify(docs: DataFrame, counts: dict | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs."""
    counts = train(docs) if counts is None else counts
    langs = sorted(counts)
    blocks = [langs[k:k + LANGUAGES] for k in range(0, len(langs), LANGUAGES)]
    sent = docs.sparkSession.sparkContext.broadcast([Model({x: counts[x] for x in b}) for b in blocks])

    def run(batches):
        models = sent.value
        for b in by_bytes(batches, "text", 1 << 20):
            texts = b.column("text").to_pylist()
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            at = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
            if at and models:
                some = [texts[i].encode() for i in at]
                bits = np.hstack([m.bits(some) for m in models])
                best = bits.argmin(axis=1)
                odds = np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000.0))
                score[at] = 1.0 / odds.sum(axis=1)
                for i, k in zip(at, best):
                    pred[i] = langs[k]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    out = map_arrow(rows, run, "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
