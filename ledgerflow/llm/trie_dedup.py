"""Exact dedup by Patricia-trie owners.

Texts are normalised (A-Z lower-cased, nothing else) and dealt by length and content
hash. Each task first folds the copies it holds itself, so that a text that a third of
all rows share leaves a task once. The owners' tasks insert the full byte strings into
a compressed radix trie whose terminal nodes keep the owner (the largest doc_id) and
the count. A trie that outgrows its memory spills its heaviest subtree as partial
owners; partial owners of one text meet in a last aggregation of 48-byte rows.

Cases: null counts as the empty text, and empty texts are copies of each other; rows
with a null doc_id own a group only if no other row does, and rows that repeat an
owner's doc_id and text are dropped but for one; an empty table gives no rows; other
columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_bytes, by_bytes, map_arrow, partitions

#: Bytes that a task's fold of its own copies, and a trie, may hold.
FOLD_BYTES = 48 << 20
TRIE_BYTES = 96 << 20
NODE_BYTES = 300
SALTS = 16


class Node:
    """label: the bytes from the parent; kids by first byte; here: (owner, count) or None."""

    __slots__ = ("label", "kids", "here")

    def __init__(self, label: bytes, here: tuple | None = None):
        self.label, self.kids, self.here = label, {}, here


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving: slices compare at memory speed."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _owner(a: tuple, b: tuple) -> tuple:
    x, y = a[0], b[0]
    return (x if y is None or (x is not None and x >= y) else y, a[1] + b[1])


class Trie:
    def __init__(self, budget: int = TRIE_BYTES):
        self.root, self.bytes, self.budget = Node(b""), 0, budget

    def insert(self, text: bytes, owner: int | None, count: int) -> None:
        node, at, value = self.root, 0, (owner, count)
        while True:
            if at == len(text):
                node.here = value if node.here is None else _owner(node.here, value)
                return
            kid = node.kids.get(text[at])
            if kid is None:
                node.kids[text[at]] = Node(text[at:], value)
                self.bytes += len(text) - at + NODE_BYTES
                return
            rest = text[at:at + len(kid.label)]
            n = _shared(rest, kid.label)
            if n < len(kid.label):  # the edge forks here
                fork = Node(kid.label[:n])
                kid.label = kid.label[n:]
                fork.kids[kid.label[0]] = kid
                node.kids[text[at]] = fork
                self.bytes += NODE_BYTES
                kid = fork
            node, at = kid, at + n

    def walk(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        todo = [(node, prefix)]
        while todo:
            node, prefix = todo.pop()
            text = prefix + node.label
            if node.here is not None:
                yield text, *node.here
            todo += [(k, text) for k in node.kids.values()]

    def spill(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Give up the heaviest child of the root, until the rest fits in half the budget."""
        def weight(node: Node) -> int:
            total, todo = 0, [node]
            while todo:
                x = todo.pop()
                total += len(x.label) + NODE_BYTES
                todo += x.kids.values()
            return total

        sizes = {b: weight(k) for b, k in self.root.kids.items()}
        while self.root.kids and self.bytes > self.budget // 2:
            b = max(sizes, key=lambda x: (sizes[x], x))
            yield from self.walk(self.root.kids.pop(b), b"")
            self.bytes -= sizes.pop(b)
        if not self.root.kids:
            self.bytes = 0


def _digests(batches):
    for b in by_bytes(batches, "text"):
        texts = as_bytes(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([hashlib.sha256(t.lower()).digest() for t in texts], pa.binary())], ["doc_id", "digest"])


def _fold(batches):
    """One row for each text of the task (of each FOLD_BYTES of it): its owner here and count."""
    held: dict[bytes, tuple] = {}
    size = 0

    def out():
        texts = list(held)
        for i in range(0, len(texts), 2000):
            part = texts[i:i + 2000]
            keys = [hashlib.sha256(t).digest() for t in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int.from_bytes(k[:7], "little") ^ len(t) for k, t in zip(keys, part)], pa.int64()), pa.array(part, pa.binary()), pa.array([held[t][0] for t in part], pa.int64()), pa.array([held[t][1] for t in part], pa.int64())],
                ["part", "text", "owner", "n"],
            )

    for b in by_bytes(batches, "text"):
        for i, t in zip(b.column("doc_id").to_pylist(), as_bytes(b.column("text"))):
            t = t.lower()  # of bytes: A-Z only
            was = held.get(t)
            if was is None:
                size += len(t) + NODE_BYTES
            held[t] = (i, 1) if was is None else _owner(was, (i, 1))
        if size > FOLD_BYTES:
            yield from out()
            held, size = {}, 0
    yield from out()


def _owners(batches):
    trie = Trie()

    def out(rows):
        done: list = []
        for text, owner, n in rows:
            done.append((hashlib.sha256(text).digest(), owner, n))
            if len(done) == 5000:
                yield pack(done)
                done = []
        if done:
            yield pack(done)

    def pack(done):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.binary(), pa.int64(), pa.int64()))], ["digest", "owner", "n"])

    for b in batches:
        for t, o, n in zip(b.column("text").to_pylist(), b.column("owner").to_pylist(), b.column("n").to_pylist()):
            trie.insert(t, o, n)
        if trie.bytes > trie.budget:
            yield from out(trie.spill())
    yield from out(trie.walk(trie.root, b""))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs."""
    spark = docs.sparkSession
    two = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    folded = map_arrow(two, _fold, "part bigint, text binary, owner bigint, n bigint")
    dealt = folded.repartition(partitions(spark), "part").select("text", "owner", "n")
    owners = (map_arrow(dealt, _owners, "digest binary, owner bigint, n bigint")
              .groupBy("digest").agg(F.max("owner").alias("keep_id"), F.sum("n").alias("group_size")))
    # Only groups of two and more need the join. Their one row stands under each salt, so
    # that the rows of one large group are dealt to SALTS tasks (and split further by AQE).
    copies = owners.where("group_size > 1").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = map_arrow(two, _digests, "doc_id bigint, digest binary").withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    joined = rows.join(copies, ["digest", "_salt"], "left").select(
        "doc_id", "digest", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
    )
    # Of rows that repeat the owner's doc_id one stays; only owners' rows are numbered.
    is_owner = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    first = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("group_size")) == 1
    owned = joined.where(is_owner & (F.col("group_size") > 1)).withColumn("kept", first)
    rest = joined.where(~(is_owner & (F.col("group_size") > 1))).withColumn("kept", F.col("group_size") == 1)
    return owned.unionByName(rest).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
