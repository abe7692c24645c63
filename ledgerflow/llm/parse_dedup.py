"""Suffix-array dedup of repeated 50-byte strings, by prefix-free parsing.

A rolling hash over SEED bytes triggers phrases: the trigger of a 50-byte string is the
least hash in it (the leftmost of equals), and the starts that share a trigger are one
phrase, from its first start to 49 bytes beyond its last. What a phrase is depends on
its own bytes alone, so a text that repeats is parsed alike wherever it stands, and equal
50-byte strings stand in phrases of one trigger, at one distance from it.

1. Triggers go by 40 bits of their hash and the bucket (a chance meeting only makes more
   phrases live). Phrases whose trigger two documents have are live.
2. The dictionary: the distinct live phrases of each part of the documents, as bytes, with
   the least document of the part that has each (the parse, as far as order needs it).
3. For each trigger the suffix array of its phrases (suffixes of 50 bytes and more, by their
   bytes) gives the classes of equal 50-byte strings; with the documents of the parse these
   stand in corpus order, whose first is the string's owner. A phrase that is alone under its
   trigger needs no order: all its strings have its least document.
4. Owners go back to the parts, where a string goes if its owner is a smaller document.

Strings of different phrases are equal only if their bytes are; phrases are the same if 64
bits of the trigger and 64 of the phrase are, and where phrases of two parts meet their
bytes are compared (a difference fails the query, so no byte goes unseen).

Cases: null counts as the empty text; texts under 50 bytes lose nothing; rows with the
same doc_id never remove bytes of each other; a null doc_id is smaller than all others;
texts of any length are parsed whole, in pieces of PIECE bytes that overlap by 49; an empty
table gives no rows; columns other than doc_id and text are neither read nor returned,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, by_bytes, dealt, map_arrow, partitions, written
from .packed import mixed, pack, split, steps, unpack, unsteps

LENGTH = 50
SEED = 24
WINDOW = LENGTH - SEED + 1
#: Bytes that are parsed at once (some 60 bytes of arrays each): texts are cut, short ones put
#: together. PLACES: bits for a place among them.
PIECE, PLACES = 4 << 20, 28
#: Starts of 50-byte strings that are ordered at once, by whole triggers.
ORDERED = 200_000
NULL = -(1 << 63)
_U = np.uint64
_BYTE = np.random.default_rng(50).integers(1, 1 << 63, 256, np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_STARTS = _U(0xD6E8FEB86659FD93)


class Powers:
    """Powers of a base mod 2^64, and of its inverse."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            m = max(n, 1 << 20)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                x = np.full(m, base, np.uint64)
                x[0] = 1
                setattr(cls, name, np.cumprod(x))
        return cls.up[:n], cls.down[:n]


class Parse:
    """texts: their bytes. of, low, high: of each phrase its text and first and last start
    (places in all bytes); trigger, key: hashes of its trigger and of it all."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([*map(len, texts)], np.int64)
        ends = np.cumsum(sizes)
        self.begin, self.sizes = ends - sizes, sizes
        n = len(data)
        empty = np.zeros(0, np.int64)
        self.of = self.low = self.high = empty
        self.trigger = self.key = empty.astype(np.uint64)
        self.data, self.off = data, empty
        self.sums = self.down = None
        if n < LENGTH:
            return
        b = _BYTE[data]
        up, self.down = Powers.to(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(b * up[:n], out=self.sums[1:])
        h = mixed((self.sums[SEED:] - self.sums[:-SEED]) * self.down[:n - SEED + 1])
        v = (h >> _U(PLACES) << _U(PLACES)) | np.arange(len(h), dtype=np.uint64)
        w = 1
        while w * 2 <= WINDOW:
            v = np.minimum(v[:-w], v[w:])
            w *= 2
        if w < WINDOW:
            v = np.minimum(v[:len(v) - (WINDOW - w)], v[WINDOW - w:])
        at = (v & _U((1 << PLACES) - 1)).astype(np.int64)  # of each start its trigger's place
        inside = np.ones(len(at), bool)
        for s, e in zip(self.begin.tolist(), ends.tolist()):
            inside[max(s, e - LENGTH + 1):e] = False
        new = np.empty(len(at), bool)
        new[0] = True
        new[1:] = at[1:] != at[:-1]
        new[1:] |= ~inside[:-1]
        self.low = np.flatnonzero(new & inside)
        if not len(self.low):
            return
        last = np.ones(len(at), bool)
        last[:-1] = new[1:] | ~inside[1:]
        self.high = np.flatnonzero(last & inside)
        self.of = np.searchsorted(ends, self.low, "right")
        self.trigger = h[at[self.low]]
        self.off = at[self.low] - self.low  # how far behind its start the trigger stands
        self.key = mixed(self.strings(self.low, self.high + LENGTH) + (self.high - self.low).astype(np.uint64) * _STARTS)

    def strings(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (self.sums[high] - self.sums[low]) * self.down[low]


def _ids(b: pa.RecordBatch) -> np.ndarray:
    return np.asarray(b.column("doc_id").fill_null(NULL).to_numpy(zero_copy_only=False), np.int64)


def _parses(ids: np.ndarray, texts: list[bytes]):
    """The parse of all texts, about PIECE bytes at a time: of each piece its text's index,
    where in the text it begins, and the Parse of the pieces. Texts come by ascending id."""
    of, base, some, size = [], [], [], 0
    for i in np.argsort(ids, kind="stable").tolist():
        t = texts[i]
        for at in range(0, max(1, len(t) - LENGTH + 1), PIECE):
            part = t if len(t) <= PIECE else t[at:at + PIECE + LENGTH - 1]
            of.append(i)
            base.append(at)
            some.append(part)
            size += len(part)
            if size >= PIECE:
                yield np.array(of), base, Parse(some)
                of, base, some, size = [], [], [], 0
    if some:
        yield np.array(of), base, Parse(some)


BLOBS = "part int, kind tinyint, blob binary"


def _blobs(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int8(), pa.binary()))], ["part", "kind", "blob"])


def _home(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(ids.view(np.uint64)) % _U(parts)).astype(np.int32)


def _identity(p: Parse) -> np.ndarray:
    return mixed(p.key ^ mixed(p.trigger))


def _brief(trigger: np.ndarray, buckets: int) -> np.ndarray:
    """40 bits of a trigger and its bucket: what tells whether it is live."""
    return (trigger >> _U(24) << _U(24)) | trigger % _U(buckets)


def _triggers(buckets: int, parts: int):
    """kind 0: (trigger, document) by trigger, of a trigger the least document; kind 4: the same
    where two documents of the batch have it. kind 1: a document's live triggers, by document."""

    def run(batches):
        for b in by_bytes(batches, "text", PIECE):
            ids = _ids(b)
            for of, _, p in _parses(ids, as_bytes(b.column("text"))):
                if len(p.low):
                    rows = [*parsed(p.trigger, ids[of][p.of])]
                    for i in range(0, len(rows), 500):
                        yield _blobs(rows[i:i + 500])

    def parsed(trigger, doc):
        order = np.argsort(trigger, kind="stable")  # documents ascend
        t, d = trigger[order], doc[order]
        new = np.ones(len(t), bool)
        new[1:] = t[1:] != t[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(t)) - 1
        live = d[first] < d[last]
        for kind, at in ((0, first[~live]), (4, first[live])):
            at = at[np.argsort(d[at], kind="stable")]
            own_t, own_d = t[at], d[at]
            for part, x in split((own_t % _U(buckets)).astype(np.int32)):
                yield part, kind, pack((own_t[x] >> _U(24)).astype(np.uint32), (own_t[x] >> _U(56)).astype(np.uint8), steps(own_d[x]))
        once = new.copy()
        once[1:] |= d[1:] != d[:-1]
        some = once & np.repeat(live, last - first + 1)
        t, d = t[some], d[some]
        order = np.argsort(d, kind="stable")
        t, d = _brief(t[order], buckets), d[order]
        for part, x in split(_home(d, parts)):
            yield part, 1, pack(t[x], steps(d[x]))

    return run


def _decide(parts: int):
    """From triggers' buckets: those that two documents have, by document."""

    def run(batches):
        held = defaultdict(list)
        for b in batches:
            for part, kind, blob in zip(b.column("part").to_pylist(), b.column("kind").to_pylist(), b.column("blob").to_pylist()):
                if kind == 1:
                    yield _blobs([(part, kind, blob)])
                else:
                    low, high, d = unpack(blob, np.uint32, np.uint8, np.uint64)
                    held[part].append((high.astype(np.uint64) << _U(56) | low.astype(np.uint64) << _U(24) | _U(part), unsteps(d), np.full(len(low), kind == 4)))
        for part in list(held):
            t, d, told = (np.concatenate(x) for x in zip(*held.pop(part)))
            order = np.lexsort((d, t))
            t, d, told = t[order], d[order], told[order]
            new = np.ones(len(t), bool)
            new[1:] = t[1:] != t[:-1]
            first = np.flatnonzero(new)
            size = np.diff(first, append=len(t))
            live = (d[first] < d[first + size - 1]) | np.logical_or.reduceat(told, first)
            some = np.repeat(live, size) & ~told
            t, d = t[some], d[some]
            order = np.argsort(d, kind="stable")
            t, d = t[order], d[order]
            rows = [(q, 1, pack(t[x], steps(d[x]))) for q, x in split(_home(d, parts))]
            for i in range(0, len(rows), 200):
                yield _blobs(rows[i:i + 200])

    return run


def _texts(parts: int):
    """kind 2: documents by document, compressed."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in by_bytes(batches, "text", PIECE):
            ids, texts, rows = _ids(b), as_bytes(b.column("text")), []
            for q, x in split(_home(ids, parts)):
                sizes = np.array([len(texts[i]) for i in x], np.int64)
                rows.append((q, 2, pack(ids[x], sizes) + squeeze(b"".join([texts[i] for i in x]))))
            for i in range(0, len(rows), 500):
                yield _blobs(rows[i:i + 500])

    return run


def _unpacked(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    ids, sizes = unpack(blob, np.int64, np.int64)
    raw = zstandard.ZstdDecompressor().decompress(blob[4 + 16 * len(ids):], max_output_size=max(1, int(sizes.sum())))
    ends = np.cumsum(sizes)
    return ids, [raw[e - s:e] for s, e in zip(sizes.tolist(), ends.tolist())]


def _merged(packs, most: int = PIECE):
    """The documents of a part's packs, about `most` bytes of them at a time."""
    ids, texts, size = [], [], 0
    for _, blob in packs:
        i, t = _unpacked(blob)
        ids.append(i)
        texts += t
        size += sum(map(len, t))
        if size >= most:
            yield np.concatenate(ids), texts
            ids, texts, size = [], [], 0
    if ids:
        yield np.concatenate(ids), texts


def _groups(batches):
    """Parts of a task, one after the other: what was told of it, and its texts (compressed)."""
    held, texts = defaultdict(list), defaultdict(list)
    for b in batches:
        for part, kind, blob in zip(b.column("part").to_pylist(), b.column("kind").to_pylist(), b.column("blob").to_pylist()):
            (texts if kind == 2 else held)[part].append((kind, blob))
    for part in list(texts):
        yield part, held.pop(part, []), texts.pop(part)


def _place(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """For each of want its place in have, which is sorted, or -1."""
    if not len(have) or not len(want):
        return np.full(len(want), -1)
    at = np.minimum(np.searchsorted(have, want), len(have) - 1)
    return np.where(have[at] == want, at, -1)


def _rows_of(data: np.ndarray, at: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Rows of `width` bytes: the size bytes of data at each place, then zeros."""
    span = np.arange(width)
    rows = data[np.minimum(at[:, None] + span, max(0, len(data) - 1))]
    rows[span >= size[:, None]] = 0
    return rows


WIDTH = LENGTH + WINDOW - 1


def _dictionary(buckets: int):
    """kind 0: a part's live phrases by trigger: bytes, the least document that has each, and
    whether others of the part do. kind 5: its documents that have any."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for part, told, packs in _groups(batches):
            if not told:
                continue
            k, d = (np.concatenate(x) for x in zip(*((k, unsteps(d)) for k, d in (unpack(blob, np.uint64, np.uint64) for _, blob in told))))
            pairs = np.sort(mixed(k ^ mixed(d.view(np.uint64))))
            some = np.unique(d)
            yield _blobs([(part, 5, pack(steps(some)))])
            for ids, texts in _merged(packs):
                pick = np.flatnonzero(_place(some, ids) >= 0)
                for of, _, p in _parses(ids[pick], [texts[i] for i in pick]):
                    if not len(p.low):
                        continue
                    doc = ids[pick][of][p.of]
                    live = np.flatnonzero(_place(pairs, mixed(_brief(p.trigger, buckets) ^ mixed(doc.view(np.uint64)))) >= 0)
                    _, first, back = np.unique(_identity(p)[live], return_index=True, return_inverse=True)
                    most = np.full(len(first), np.iinfo(np.int64).min)
                    np.maximum.at(most, back, doc[live])
                    live = live[first]  # documents ascend
                    several = most > doc[live]
                    size = p.high[live] - p.low[live] + LENGTH
                    rows = []
                    for q, x in split((p.trigger[live] % _U(buckets)).astype(np.int32)):
                        x = x[np.argsort(doc[live[x]], kind="stable")]
                        y = live[x]
                        flat = _rows_of(p.data, p.low[y], size[x], WIDTH)
                        text = flat[np.arange(WIDTH) < size[x][:, None]].tobytes()
                        rows.append((q, 0, pack(np.full(len(y), part, np.int32), steps(doc[y]), (size[x] * 2 + several[x]).astype(np.uint8), p.off[y].astype(np.uint8)) + squeeze(text)))
                    for i in range(0, len(rows), 500):
                        yield _blobs(rows[i:i + 500])

    return run


def _sum(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The rolling sum over n of each row's values from its place on."""
    out, up = np.zeros(len(values), np.uint64), Powers.to(n)[0]
    line = np.arange(len(values))
    for k in range(n):
        out += values[line, np.minimum(at + k, values.shape[1] - 1)] * up[k]
    return out


def _entries(blob: bytes):
    """part, identity, trigger, document, whether there are others, offset, size and bytes of
    each phrase; its hashes are made anew from its bytes."""
    part, doc, both, off = unpack(blob, np.int32, np.uint64, np.uint8, np.uint8)
    size, several = both.astype(np.int64) >> 1, (both & 1).astype(bool)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4 + 14 * len(part):], max_output_size=max(1, int(size.sum()))), np.uint8)
    rows = _rows_of(data, np.cumsum(size) - size, size, WIDTH)
    values = _BYTE[rows]
    values[np.arange(WIDTH) >= size[:, None]] = 0
    off = off.astype(np.int64)
    trigger = mixed(_sum(values, off, SEED))
    key = mixed(_sum(values, np.zeros(len(size), np.int64), WIDTH) + (size - LENGTH).astype(np.uint64) * _STARTS)
    return part, mixed(key ^ mixed(trigger)), trigger, unsteps(doc), several, off, size, rows


def owners(trigger: np.ndarray, doc: np.ndarray, off: np.ndarray, size: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For distinct phrases by ascending trigger: the owners of all their 50-byte strings, and
    where those of each phrase begin. The suffix array of each trigger's phrases: suffixes by
    distance to the trigger and bytes; neighbours that agree in 50 bytes are one string."""
    n = size - LENGTH + 1
    begin = np.cumsum(n) - n
    out = np.repeat(doc, n)
    new = np.ones(len(trigger), bool)
    new[1:] = trigger[1:] != trigger[:-1]
    group = np.cumsum(new) - 1
    several = np.flatnonzero(np.bincount(group)[group] > 1)
    total = np.cumsum(n[several])
    low = 0
    while low < len(several):
        high = int(np.searchsorted(total, (total[low - 1] if low else 0) + ORDERED, "right"))
        high = max(high, low + 1)
        while high < len(several) and group[several[high]] == group[several[high - 1]]:
            high += 1
        some = several[low:high]
        low = high
        m = n[some]
        phrase = np.repeat(some, m)
        start = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        text = np.zeros((len(start), 56), np.uint8)
        text[:, :LENGTH] = rows[phrase[:, None], start[:, None] + np.arange(LENGTH)]
        words = text.view(">u8").astype(np.uint64)
        place = group[phrase] * 64 + off[phrase] - start
        order = np.lexsort((*words.T[::-1], place))
        words, place = words[order], place[order]
        first = np.ones(len(order), bool)
        first[1:] = (place[1:] != place[:-1]) | (words[1:] != words[:-1]).any(1)
        least = np.minimum.reduceat(doc[phrase[order]], np.flatnonzero(first))
        out[begin[phrase[order]] + start[order]] = least[np.cumsum(first) - 1]
    return out, begin


def _ordered(batches):
    """From triggers' buckets: the owners of the strings of each part's phrases: kind 3 where a
    phrase has one owner, kind 6 where its strings have several, by part; kind 5 passes."""
    held = defaultdict(list)
    for b in batches:
        for part, kind, blob in zip(b.column("part").to_pylist(), b.column("kind").to_pylist(), b.column("blob").to_pylist()):
            if kind == 5:
                yield _blobs([(part, kind, blob)])
            else:
                held[part].append(blob)
    for bucket in list(held):
        part, key, trigger, doc, several, off, size, rows = (np.concatenate(x) for x in zip(*map(_entries, held.pop(bucket))))
        order = np.lexsort((doc, key, trigger))
        part, key, trigger, doc, several, off, size, rows = (x[order] for x in (part, key, trigger, doc, several, off, size, rows))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (trigger[1:] != trigger[:-1])
        at, entry = np.flatnonzero(new), np.cumsum(new) - 1
        if (rows != rows[at][entry]).any():
            raise ValueError("two phrases have the same hashes")
        own, begin = owners(trigger[at], doc[at], off[at], size[at], rows[at])
        n = size[at] - LENGTH + 1
        low, high = np.minimum.reduceat(own, begin), np.maximum.reduceat(own, begin)
        one = low == high
        # A phrase that its owner alone has in a part loses nothing there.
        told = np.flatnonzero(several | ~one[entry] | (low[entry] != doc))
        for q, x in split(part[told]):
            x = told[x]
            x = x[np.unique(entry[x], return_index=True)[1]]  # a part's phrase once
            e = entry[x]
            a, z = e[one[e]], e[~one[e]]
            out = []
            if len(a):
                out.append((q, 3, pack(key[at[a]], steps(low[a]))))
            if len(z):
                places = np.repeat(begin[z] - (np.cumsum(n[z]) - n[z]), n[z]) + np.arange(int(n[z].sum()))
                blob = pack(key[at[z]], n[z].astype(np.uint8))
                out.append((q, 6, len(blob).to_bytes(4, "little") + blob + pack(steps(own[places]))))
            yield _blobs(out)


def _owned(told: list):
    """Phrases of one part, sorted, and of each how many owners it has (one: of all its strings)
    and where they stand among all owners."""
    keys, counts, own = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for kind, blob in told:
        if kind == 3:
            k, o = unpack(blob, np.uint64, np.uint64)
            n = np.ones(len(k), np.int64)
        elif kind == 6:
            at = 4 + int.from_bytes(blob[:4], "little")
            k, n = unpack(blob[4:at], np.uint64, np.uint8)
            (o,) = unpack(blob[at:], np.uint64)
        else:
            continue
        keys.append(k)
        counts.append(n.astype(np.int64))
        own.append(unsteps(o))
    k, n, o = (np.concatenate(x) for x in (keys, counts, own))
    order = np.argsort(k, kind="stable")
    return k[order], n[order], (np.cumsum(n) - n)[order], o


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _removed(keep_text: bool):
    def run(batches):
        for _, told, packs in _groups(batches):
            key, count, begin, own = _owned(told)
            some = np.unique(np.concatenate([np.zeros(0, np.int64), *(unsteps(unpack(blob, np.uint64)[0]) for kind, blob in told if kind == 5)]))
            for ids, texts in _merged(packs):
                pick = np.flatnonzero(_place(some, ids) >= 0)
                spans: dict[int, np.ndarray] = {}
                for of, base, p in _parses(ids[pick], [texts[i] for i in pick]) if len(pick) else ():
                    if not len(p.low):
                        continue
                    doc, at = ids[pick][of][p.of], _place(key, _identity(p))
                    hit = np.flatnonzero(at >= 0)
                    n = np.where(count[at[hit]] == 1, 1, p.high[hit] - p.low[hit] + 1)
                    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    gone = own[np.repeat(begin[at[hit]], n) + step] < np.repeat(doc[hit], n)
                    whole = np.repeat(count[at[hit]] == 1, n)
                    first = (np.repeat(p.low[hit], n) + step)[gone]
                    last = np.where(whole, np.repeat(p.high[hit], n), np.repeat(p.low[hit], n) + step)[gone] + LENGTH
                    # Covered bytes: +1 where a string begins, -1 behind its end.
                    edge = np.zeros(int(p.sizes.sum()) + 1, np.int32)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, last, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    for j, (i, low) in enumerate(zip(pick[of].tolist(), base)):
                        g = covered[p.begin[j]:p.begin[j] + p.sizes[j]]
                        if len(g) == len(texts[i]):
                            spans[i] = g
                        else:
                            spans.setdefault(i, np.zeros(len(texts[i]), bool))[low:low + len(g)] |= g
                out = []
                for i, t in enumerate(texts):
                    g = spans.get(i)
                    n = runs = 0
                    rest = t
                    if g is not None and (n := int(g.sum())):
                        runs = int((np.diff(g.astype(np.int8), prepend=np.int8(0)) == 1).sum())
                        rest = np.frombuffer(t, np.uint8)[~g].tobytes()
                    out.append((None if ids[i] == NULL else int(ids[i]), len(t), n, runs, hashlib.sha256(rest).hexdigest(), rest)[:5 + keep_text])
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()][:1 + keep_text]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:5 + keep_text])

    return run


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of each row."""
    spark = docs.sparkSession
    two = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    n = parts = buckets = partitions(spark)
    live = map_arrow(dealt(map_arrow(two, _triggers(buckets, parts), BLOBS), n), _decide(parts), BLOBS)
    texts = map_arrow(two, _texts(parts), BLOBS)
    words = map_arrow(dealt(live.unionByName(texts), n), _dictionary(buckets), BLOBS)
    order = map_arrow(dealt(words, n), _ordered, BLOBS)
    return map_arrow(dealt(order.unionByName(texts), n), _removed(keep_text), RESULT + ", kept binary" * keep_text)
