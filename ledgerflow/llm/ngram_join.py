"""N-gram Jaccard join: prefix filters under several global orders, then exact counts.

A document is the set of its distinct five-word shingles (tokens, as 64-bit hashes). Two
documents of at least SIMILAR must share a token among the first n - ceil(SIMILAR*n) + 1 of
each, under every global order of the tokens. Order A puts rare tokens first, by document
counts over the whole corpus; orders B and C are ascending and descending hashes. A token
that stands in one document only comes first in A and can't be shared, so most documents
have no prefix left to search by. The others meet by the tokens of prefix A; of the pairs
that meet, only those whose prefixes B and C overlap too are left, before any whole set
is fetched; what passes is decided by the exact size of the intersection.

Copies of a set are one node, whose key is 64 bits of a hash of the set; if other 64 bits
tell that two sets share a key, all is done again under another seed. Where many nodes share a prefix token, no pairs are written out within them: in rounds, a few pivots
of each token and band of sizes, drawn anew for each token, are compared with the other
nodes; linked nodes become one component, and tokens whose nodes are all in one component
are done. When the pairs that are left between components are few against the postings, or
after the last round, they are compared all but for those whose parities of tokens differ
in too many bits for similar sets, so no link between components is lost.

Tokens that FREQUENT of a sample's documents have stand last in A and skip the count, so
no task holds their postings; which tokens these are changes the order, never the result.

Cases: words are split at white space of ASCII and A-Z is lower-cased; null and empty
texts have no shingle and are components of their own; equal short texts are linked, and
sets of one shingle are linked only if its words are equal by 128 bits; rows that repeat a
doc_id are linked only if their sets are (then component_id is that doc_id or a smaller
one); a null doc_id gets no component_id unless linked with others; an empty table gives
no rows; texts of any length are taken whole; columns other than doc_id and text are
neither read nor returned, whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, as_bytes, by_bytes, dealt, joined_by_group, map_arrow, partitions, written
from .packed import mixed, pack, split, steps, unpack, unsteps

N = 5
SIMILAR = (3, 4)  # as a fraction
WORDS = 400_000
#: Pivots of each token and band of sizes in each round, and with how many of those that
#: it meets a node is compared; the pairs that rounds leave are compared in the end.
ROUNDS = ((8, 8), (8, 8))
SMALL = 500_000
#: Sets of sizes within 4/3 are in one band or in two that follow each other.
BAND = math.log(1.34)
#: Nodes of a token beyond which they are dealt to SALTS tasks.
HOT_TOKEN = 1_000
#: Pairs between components, for each posting, up to which all of them are compared.
FEW = 4
#: Documents of the sample and how many of them make a token a frequent one.
SAMPLE, FREQUENT = 2_000, 20
#: Bits that bound from below in how many tokens two sets differ.
BITS = 512
#: Edges (16 bytes each) that one task turns into trees.
TASK_EDGES = 1_000_000


class Hashes(dict):
    """A word -> its 64-bit hash; starts anew beyond WORDS."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = h
        return h


def shingles(texts: list[bytes], words: Hashes, n: int = N, seed: int = 0) -> tuple[list[np.ndarray], list[bytes]]:
    """The sorted distinct shingle hashes of each text, and 128 bits of that set: of the words
    themselves if the set has one shingle."""
    tokens = [t.lower().split() for t in texts]
    sizes = np.array([*map(len, tokens)], np.int64)
    flat = np.fromiter((h for t in tokens for h in map(words.__getitem__, t)), np.uint64, int(sizes.sum()))
    rolled = np.zeros(max(0, len(flat) - n + 1), np.uint64)
    for k in range(n):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + flat[k:k + len(rolled)]
    rolled = mixed(rolled)
    out, same, at = [], [], 0
    for own, m in zip(tokens, sizes.tolist()):
        if m >= n:
            out.append(np.unique(rolled[at:at + m - n + 1]))
        elif m:
            out.append(np.array([xxhash.xxh3_64_intdigest(flat[at:at + m].tobytes(), seed=m)], np.uint64))
        else:
            out.append(rolled[:0])
        same.append(xxhash.xxh3_128_digest(b" ".join(own[:n]), seed=seed) if len(out[-1]) == 1 else xxhash.xxh3_128_digest(out[-1].tobytes(), seed=seed))
        at += m
    return out, same


def prefix(n: np.ndarray | int):
    """How many first tokens a set of n must share one of with a similar set."""
    a, b = SIMILAR
    return n - -(-a * n // b) + 1


def _frequent(two: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that FREQUENT documents of a sample have, and in how many of it they stand: at
    most the sample's tokens / FREQUENT."""
    chosen = two.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).distinct()

    def run(batches):
        words = Hashes()
        for b in by_bytes(batches, "text", 2 << 20):
            sets, _ = shingles(as_bytes(b.column("text")), words)
            token, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    rows = map_arrow(two.join(F.broadcast(chosen), "doc_id").select("text"), run, "token bigint, n bigint")
    got = rows.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).toPandas()
    token = got["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], np.minimum(got["n"].to_numpy(np.int64)[order] + (1 << 31), (1 << 32) - 1).astype(np.uint32)


BLOBS = "part int, kind tinyint, blob binary"


def _blobs(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int8(), pa.binary()))], ["part", "kind", "blob"])


def _scatter(buckets: int, seed: int, sent):
    """From documents, packed: (token, set) by token bucket (kind 0), those of frequent tokens
    (2), documents (1: id, size and key of its set), and sets (3: key, size, more bits, the last
    token of prefix B and the first of prefix C). A set goes once for a batch."""

    def run(batches):
        words, (frequent, often_in) = Hashes(), sent.value
        for b in by_bytes(batches, "text", 4 << 20):
            ids = np.asarray(b.column("doc_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), np.int64)
            sets, same = shingles(as_bytes(b.column("text")), words, seed=seed)
            n = np.array([*map(len, sets)], np.int64)
            identity = np.frombuffer(b"".join(same), np.uint64).reshape(-1, 2)
            keys = np.ascontiguousarray(identity[:, 0]).view(np.int64)
            home = int(mixed(ids[:1].view(np.uint64))[0] % np.uint64(buckets))
            rows = [(home, 1, pack(ids, n, keys))]
            _, once = np.unique(keys, return_index=True)
            once = once[n[once] > 0]
            if len(once):
                some = [sets[i] for i in once.tolist()]
                low = np.array([x[prefix(len(x)) - 1] for x in some], np.uint64)
                high = np.array([x[len(x) - prefix(len(x))] for x in some], np.uint64)
                rows.append((home, 3, pack(steps(keys[once]), n[once], identity[once, 1], low, high)))
                token, key = np.concatenate(some), np.repeat(keys[once], n[once])
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)
                    hit = frequent[at] == token
                    if hit.any():
                        rows.append((home, 2, pack(steps(key[hit]), token[hit], often_in[at[hit]])))
                        token, key = token[~hit], key[~hit]
                rows += [(p, 0, pack(token[x], steps(key[x]))) for p, x in split((token % np.uint64(buckets)).astype(np.int32))]
            yield _blobs(rows)

    return run


def _counted(parts: int):
    """From token buckets: packed (set, token, count) of the tokens that stand twice or more,
    by set (kind 0), and sets (3); documents (1) pass through."""

    def run(batches):
        held = defaultdict(list)
        for b in batches:
            for part, kind, blob in zip(b.column("part").to_pylist(), b.column("kind").to_pylist(), b.column("blob").to_pylist()):
                if kind == 0:
                    held[part].append(blob)
                elif kind == 1:
                    yield _blobs([(part, kind, blob)])
                elif kind == 2:
                    k, *rest = unpack(blob, np.uint64, np.uint64, np.uint32)
                    yield from send(unsteps(k), 0, *rest)
                else:
                    k, *rest = unpack(blob, np.uint64, np.int64, np.uint64, np.uint64, np.uint64)
                    yield from send(unsteps(k), 3, *rest)
        for part in list(held):
            t, k = (np.concatenate(x) for x in zip(*(unpack(blob, np.uint64, np.uint64)[:1] + [unsteps(unpack(blob, np.uint64, np.uint64)[1])] for blob in held.pop(part))))
            order = np.argsort(t, kind="stable")
            t, k = t[order], k[order]
            first = np.flatnonzero(np.diff(t, prepend=t[0] ^ np.uint64(1)))
            count = np.diff(first, append=len(t))
            df = np.repeat(np.minimum(count, (1 << 31) - 1).astype(np.uint32), count)
            often = df > 1
            t, k, df = t[often], k[often], df[often]
            order = np.argsort(k, kind="stable")
            yield from send(k[order], 0, t[order], df[order])

    def send(keys, kind, *cols):
        rows = split((mixed(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int32))
        for i in range(0, len(rows), 200):
            yield _blobs([(p, kind, pack(steps(keys[x]), *(c[x] for c in cols))) for p, x in rows[i:i + 200]])

    return run


def parities(tokens: np.ndarray) -> np.ndarray:
    """BITS bits, as longs: whether an odd number of the tokens falls on each. The bits in
    which two sets differ are at most the tokens in which they do."""
    odd = np.bincount((tokens % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


COLUMNS = (("key", "bigint", pa.int64()), ("doc_id", "bigint", pa.int64()), ("n", "bigint", pa.int64()), ("kind", "tinyint", pa.int8()), ("tokens", "binary", pa.binary()), ("prefix", "array<bigint>", pa.list_(pa.int64())),
           ("alone", "bigint", pa.int64()), ("b", "array<int>", pa.list_(pa.int32())), ("c", "array<int>", pa.list_(pa.int32())), ("bits", "array<bigint>", pa.list_(pa.int64())))
KIND = ", ".join(f"{name} {kind}" for name, kind, _ in COLUMNS)


def _rows(*columns) -> pa.RecordBatch:
    n = len(columns[0])
    arrays = [c if isinstance(c, pa.Array) else pa.array([None] * n if c is None else c, t) for c, (_, _, t) in zip(columns, COLUMNS)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _, _ in COLUMNS])


def _sets(batches):
    """Rows of documents (kind 1), and of the sets that can have a partner (0) with the tokens
    they share with any, the shared part of prefix A, and 32 bits of those of prefixes B and C.
    A row of kind 2 says that two sets have one key."""
    sets, found = defaultdict(list), defaultdict(list)
    for b in batches:
        for part, kind, blob in zip(b.column("part").to_pylist(), b.column("kind").to_pylist(), b.column("blob").to_pylist()):
            if kind == 1:
                ids, n, keys = unpack(blob, np.int64, np.int64, np.int64)
                yield _rows(keys, pa.array(ids, mask=ids == -(1 << 63)), n, np.ones(len(n), np.int8), *[None] * 6)
            elif kind == 3:
                k, *rest = unpack(blob, np.uint64, np.int64, np.uint64, np.uint64, np.uint64)
                sets[part].append((unsteps(k), *rest))
            else:
                k, t, df = unpack(blob, np.uint64, np.uint64, np.uint32)
                found[part].append((unsteps(k), t, df))
    for part in list(sets):
        keys, n, more, low, high = (np.concatenate(x) for x in zip(*sets.pop(part)))
        order = np.lexsort((more, keys))
        keys, n, more, low, high = (x[order] for x in (keys, n, more, low, high))
        if ((keys[1:] == keys[:-1]) & (more[1:] != more[:-1])).any():
            yield _rows([0], None, None, [2], *[None] * 6)
        keys, at = np.unique(keys, return_index=True)
        n, low, high = n[at], low[at], high[at]
        lists = found.pop(part, [])
        if not lists:
            continue
        k, t, df = (np.concatenate(x) for x in zip(*lists))
        del lists
        order = np.argsort(k, kind="stable")
        k, t, df = k[order], t[order], df[order]
        lo, hi = np.searchsorted(k, keys, "left"), np.searchsorted(k, keys, "right")
        out: list = []
        for j, (key, m, x, y) in enumerate(zip(keys.tolist(), n.tolist(), lo.tolist(), hi.tolist())):
            if y == x:
                continue
            own, at = np.unique(t[x:y], return_index=True)  # sets of several batches count once
            room = prefix(m) - (m - len(own))
            if room <= 0:
                continue
            first = own[np.lexsort((own, df[x:y][at]))[:room]].view(np.int64)
            in_b, in_c = (own[z].astype(np.uint32).view(np.int32) for z in (own <= low[j], own >= high[j]))
            out.append((key, None, m, 0, pack(steps(own.view(np.int64))), first, m - len(own), in_b, in_c, parities(own)))
            if len(out) == 1000:
                yield _rows(*zip(*out))
                out = []
        if out:
            yield _rows(*zip(*out))


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def alike(x: np.ndarray, n: int, y: np.ndarray, m: int) -> bool:
    """x, y: the sorted tokens that the sets of n and m share with any document. The sets
    are of different nodes; sets of one shingle each then differ."""
    a, b = SIMILAR
    least, most = (n, m) if n < m else (m, n)
    if b * least < a * most or most == 1:
        return False
    same = _common(x, y)
    return b * same >= a * (n + m - same)


def _verify(batches):
    for b in batches:
        keep, last, x = [], None, None
        for i, (k, t, n, u, m) in enumerate(zip(*(b.column(c).to_pylist() for c in ("a", "ta", "na", "tb", "nb")))):
            if k != last:
                last, x = k, unsteps(unpack(t, np.uint64)[0]).view(np.uint64)
            if alike(x, n, unsteps(unpack(u, np.uint64)[0]).view(np.uint64), m):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(keep, pa.int64())), b.column("b").take(pa.array(keep, pa.int64()))], ["a", "b"])


def _of_both(pairs: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """pairs(a, b) with columns of both nodes, as a_... and b_...: only the nodes that pairs
    name travel, and up to SMALL pairs (16 bytes each) are broadcast to where these are."""
    near = F.broadcast if pairs.count() <= SMALL else lambda df: df
    of = lambda side: nodes.select(F.col("key").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns))
    one = of("b").join(near(pairs), "b")
    heads = of("a").join(near(pairs.select("a").distinct()), "a", "left_semi")
    return one.join(heads, "a")


def linked(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of pairs(a, b), which prefix A allows, that prefixes B and C allow too and whose
    sets are similar. The prefixes are compared first: they are a fourth of a set's size."""
    spark = nodes.sparkSession
    pairs = written(spark, pairs, "pairs")
    met = _of_both(pairs, nodes, ["b", "c"]).where(F.arrays_overlap("a_b", "b_b") & F.arrays_overlap("a_c", "b_c"))
    met = written(spark, met.select("a", "b"), "met")
    two = _of_both(met, nodes, ["n", "tokens"]).select("a", F.col("a_n").alias("na"), F.col("a_tokens").alias("ta"), "b", F.col("b_n").alias("nb"), F.col("b_tokens").alias("tb"))
    return map_arrow(two, _verify, "a bigint, b bigint")


def _forest(batches):
    """A spanning forest of a task's edges: each node with the smallest of its tree."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x in batches:
        a.append(x.column("a").to_numpy(zero_copy_only=False))
        b.append(x.column("b").to_numpy(zero_copy_only=False))
    a, b = np.concatenate(a), np.concatenate(b)
    keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    root = np.arange(len(keys))
    while len(a):
        # Hook the larger root of each edge below the smaller one, then shorten all paths.
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        a, b = root[a], root[b]
        left = a != b
        a, b = a[left], b[left]
    if len(keys):
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(keys[root])], ["a", "b"])


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """key and the smallest key (comp) it reaches over edges(a, b); only keys with edges.
    Tasks of up to about `task_edges` edges turn them into trees; if there was one task,
    these are the components, else labels spread over the trees of all tasks."""
    spark = edges.sparkSession
    tasks = -(-edges.count() // task_edges)
    trees = map_arrow(edges.select("a", "b").coalesce(max(1, tasks)), _forest, "a bigint, b bigint")
    if tasks <= 1:
        return written(spark, trees.withColumnsRenamed({"a": "key", "b": "comp"}), "labels")
    trees = written(spark, trees, "trees")
    both = written(spark, trees.union(trees.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(spark, both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("key", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        low = labels.join(near, labels["key"] == near["a"]).select("key", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = low.select(F.col("key").alias("comp"), F.col("comp").alias("far"))
        new = written(spark, low.join(jump, "comp", "left").select("key", "was", F.least("comp", "far").alias("comp")), "labels")
        if new.where("was <> comp").isEmpty():
            return new.select("key", "comp")
        labels = new.select("key", "comp")


def _labelled(postings: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return postings.withColumn("comp", F.col("key"))
    return postings.join(comp.withColumnRenamed("key", "node"), F.col("key") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "key")).drop("node")


def _band(shift: float = 0.0):
    return F.floor(F.log("n") / BAND + shift)


def _pivot_pairs(at: DataFrame, k: int, pivots: int, most: int) -> DataFrame:
    """Each node with up to `most` of the pivots it shares most tokens with. A token's
    pivots are the nodes of least hash, of those whose rest allows sets of their size."""
    # A hot token's few pivots stand under each salt, so its nodes meet them in many tasks.
    hot = F.col("c") > HOT_TOKEN
    salt = F.when(hot, F.pmod(F.xxhash64("key"), F.lit(SALTS))).otherwise(0).cast("int")
    at = at.withColumn("band", _band(k % 2 / 2)).withColumn("salt", salt)

    def drawn(i):
        h = F.xxhash64("key", "token", F.lit(1000 * k + i))
        return F.min(F.struct(h.alias("h"), F.struct("key", "n", "rest", "comp").alias("v")))

    drawn_all = F.array_distinct(F.transform(F.array(*map(drawn, range(pivots))), lambda x: x["v"]))
    heads = at.where("7 * rest >= 6 * n").groupBy("token", "band").agg(drawn_all.alias("p"), F.first("c").alias("c")).withColumn("p", F.explode("p"))
    heads = heads.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    met = at.alias("o").join(heads.alias("h"), F.expr("o.token = h.token and o.band = h.band and o.salt = h.salt and o.comp <> h.p.comp and 7 * least(o.rest, h.p.rest) >= 3 * (o.n + h.p.n)"))
    votes = met.groupBy("key", F.col("p.key").alias("a")).count()
    best = votes.groupBy("key").agg(F.slice(F.sort_array(F.collect_list(F.struct("count", "a")), False), 1, most).alias("v"))
    best = best.select("key", F.explode("v.a").alias("a"))
    return best.select(F.least("a", "key").alias("a"), F.greatest("a", "key").alias("b")).distinct()


def _all_pairs(at: DataFrame, nodes: DataFrame) -> DataFrame:
    """All pairs of nodes of two components that a token of prefix A allows, and that their
    parities don't rule out: similar sets of n and m differ in (n + m) / 7 tokens at most, and
    they differ in those that stand in one of them alone and in a token for each bit that
    differs. The larger set looks for the smaller one in its own band of sizes and in the band
    below."""
    bits = [F.get("bits", k).alias(f"x{k}") for k in range(BITS // 64)]
    at = at.join(nodes.select(F.col("key").alias("_node"), "alone", *bits), F.col("key") == F.col("_node")).drop("_node")
    differ = " + ".join(f"bit_count(l.x{k} ^ s.x{k})" for k in range(BITS // 64))
    small = at.where("7 * rest >= 6 * n").withColumn("band", _band()).alias("s")
    large = at.withColumn("band", F.explode(F.array(_band(), _band() - 1))).alias("l")
    met = large.join(small, F.expr(f"""l.token = s.token and l.band = s.band and l.comp <> s.comp
        and (s.n < l.n or s.n = l.n and s.key < l.key) and 7 * least(s.rest, l.rest) >= 3 * (s.n + l.n)
        and 7 * (l.alone + s.alone + {differ}) <= l.n + s.n"""))
    return met.select(F.least("l.key", "s.key").alias("a"), F.greatest("l.key", "s.key").alias("b")).distinct()


def join_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    spark = docs.sparkSession
    two = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parts, seed = partitions(spark), 0
    sent = spark.sparkContext.broadcast(_frequent(two))
    while True:
        by_token = dealt(map_arrow(two, _scatter(parts, seed, sent), BLOBS), parts)
        by_set = dealt(map_arrow(by_token, _counted(parts), BLOBS), parts)
        rows = written(spark, map_arrow(by_set, _sets, KIND), "sets")
        if rows.where("kind = 2").isEmpty():
            break
        seed += 1
    sent.destroy()

    nodes = rows.where("kind = 0").drop("kind", "doc_id")
    postings = written(spark, nodes.select("key", "n", "alone", F.posexplode("prefix").alias("p", "token")).select("key", "n", "token", (F.col("n") - F.col("alone") - F.col("p")).alias("rest")), "postings")
    total = max(1, postings.count())

    # `rest`: how many tokens a set has from this one on, in order A. The first token that
    # two sets share bounds their intersection by the smaller rest, which must reach
    # 3/7 of n + m; the pair is searched by tokens that leave it so much. So the smaller of
    # the two has a rest of at least 6/7 of its size there.
    edges = comp = None
    for k in range(len(ROUNDS) + 1):
        at = _labelled(postings, comp)
        # The tokens whose nodes are still in several components.
        open_ = at.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("c")).where("x <> y")
        open_ = written(spark, open_, "tokens")
        left = open_.agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2)).first()[0] or 0
        if not left:
            break
        # Components only grow, so the tokens that are done stay done.
        postings = written(spark, postings.drop("c").join(open_.select("token", "c"), "token"), "postings")
        last = left <= FEW * total or k == len(ROUNDS)
        at = _labelled(postings, comp)
        pairs = _all_pairs(at, nodes) if last else _pivot_pairs(at, k, *ROUNDS[k])
        new = written(spark, linked(pairs, nodes), "links")
        edges = new if edges is None else written(spark, edges.union(new), "links")
        comp = components(edges) if not edges.isEmpty() else None
        if last:
            break
    # Rows follow their set, sets their component. Only sets of several rows, or components
    # of several sets, need a join.
    own = rows.where("kind = 1").select("doc_id", "n", "key")
    of = own.where("n > 0").groupBy("key").agg(F.count("*").alias("rows"), F.min("doc_id").alias("least"))
    if comp is None:
        several = of.where("rows > 1")
    else:
        of = written(spark, of.join(comp.withColumnRenamed("key", "_node"), F.col("key") == F.col("_node"), "left").drop("_node"), "nodes")
        whole = of.where("comp is not null").groupBy("comp").agg(F.min("least").alias("_least"), F.count("*").alias("sets"))
        joined = joined_by_group(of.where("comp is not null"), written(spark, whole, "components"), "comp", "sets")
        several = joined.select("key", "rows", F.coalesce("_least", "least").alias("least")).unionByName(of.where("comp is null and rows > 1").drop("comp"))
    several = written(spark, several, "members")
    out = joined_by_group(own.where("n > 0"), several, "key", "rows").unionByName(own.where("n = 0").withColumn("least", F.lit(None).cast("bigint")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
