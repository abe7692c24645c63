"""A Merkle manifest of the documents, with a witness for each leaf that grows as its tree does.

Leaves are appended to their language's tree in order. A node that arrives in a run takes the
nodes before it as its partial witness; each node that comes after it in the run extends the
witnesses of the earlier ones, and a full run of FAN nodes, or the open one at the end, goes
on as one node of the level above (`Witnesses`). Trees are cut into aligned blocks of
FAN ** LEVELS nodes, which tasks grow apart from each other; the blocks' roots are then
appended in the same way, block by block, until each language has one root, and the
languages' roots likewise. On the way down the witness of a block's root, which is the end
of the witness of all its leaves, enters the block's task as a row before the leaves.

Only digests move: a row's text is read once. Orders come from range partitions, so a
language of any size is many tasks; no task holds more than a block.

Cases: a null column is `-`; null languages are a tree of their own, the first; null doc_ids
come first and are never tampered with; leaves of equal doc_ids are ordered by digest, and
rows that repeat are leaves each; a language of one row has its leaf as root; an empty table
gives no rows; further columns are neither read nor returned; a text of any length is hashed
where it is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SMALL, map_arrow, written

FAN, LEVELS = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Witnesses:
    """One block's tree of `height` levels while its nodes arrive. Level by level and node by
    node, `left` and `right` are what stands beside the node in its run so far."""

    def __init__(self, height: int, fan: int = FAN):
        self.height, self.fan, self.root = height, fan, None
        self.run: list[list[str]] = [[] for _ in range(height)]
        self.left: list[list[str]] = [[] for _ in range(height)]
        self.right: list[list[str]] = [[] for _ in range(height)]

    def append(self, node: str, level: int = 0) -> None:
        while level < self.height:
            run, left, right = self.run[level], self.left[level], self.right[level]
            for k in range(len(right) - len(run), len(right)):
                right[k] += node
            left.append("".join(run))
            right.append("")
            run.append(node)
            if len(run) < self.fan:
                return
            node, self.run[level] = digest("".join(run)), []
            level += 1
        self.root = node

    def close(self) -> str:
        """The root, when no more nodes come: open runs go up as they are."""
        for level, run in enumerate(self.run):
            if run:
                self.run[level] = []
                self.append(digest("".join(run)), level + 1)
        return self.root

    def of(self, k: int) -> list[str]:
        """The witness of node k: for each level the siblings, with | in the node's place."""
        out = []
        for left, right in zip(self.left, self.right):
            out.append(f"{left[k]}|{right[k]}")
            k //= self.fan
        return out


def height_of(nodes: int, levels: int, fan: int) -> int:
    """How many levels a block of a tree of so many nodes has."""
    up = 0
    while nodes > 1 and up < levels:
        nodes, up = -(-nodes // fan), up + 1
    return up


_NODE = "tree string, at bigint, nodes bigint, hash string"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of each (tree, block), which follow each other."""
    key, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if (r["tree"], r["block"]) != key:
                if rows:
                    yield key, rows
                key, rows = (r["tree"], r["block"]), []
            rows.append(r)
    if rows:
        yield key, rows


def _grown(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """The roots of all blocks of nodes(tree, at, nodes, hash), as nodes of the trees above."""
    size = fan**levels

    def run(batches):
        out = []
        for (tree, block), rows in _blocks(batches):
            grown = Witnesses(height_of(rows[0]["nodes"], levels, fan), fan)
            for r in rows:
                grown.append(r["hash"])
            out.append((tree, block, -(-rows[0]["nodes"] // size), grown.close()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["tree", "at", "nodes", "hash"])

    return map_arrow(_dealt(nodes.select("tree", "at", "nodes", "hash", _block(size))), run, _NODE)


def _block(size: int) -> Column:
    return F.expr(f"at div {size}").alias("block")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "at")


def _witnessed(nodes: DataFrame, ends: DataFrame, fan: int, levels: int, keep: str = "") -> DataFrame:
    """tree, at, subroot, witness of each of nodes, and the columns that keep declares. ends(tree,
    at, subroot, witness) are those of the blocks' roots."""
    size = fan**levels
    kept = [x.split(" ")[0] for x in keep.split(", ") if x]

    def run(batches):
        for _, rows in _blocks(batches):
            end = rows.pop(0)
            grown = Witnesses(height_of(rows[0]["nodes"], levels, fan), fan)
            for r in rows:
                grown.append(r["hash"])
            grown.close()
            ended = [end["witness"]] if end["witness"] else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["tree"] for r in rows]), pa.array([r["at"] for r in rows], pa.int64()), pa.array([end["subroot"]] * len(rows), pa.string()),
                 pa.array(["/".join(grown.of(k) + ended) for k in range(len(rows))], pa.string()), *(pa.array([r[c] for r in rows], pa.int64() if c == "doc_id" else pa.string()) for c in kept)],
                ["tree", "at", "subroot", "witness", *kept])

    # The root's row comes before its nodes.
    heads = ends.select("tree", F.lit(-1).cast("bigint").alias("at"), F.col("at").alias("block"), "subroot", "witness")
    rows = nodes.withColumn("block", F.expr(f"at div {size}")).unionByName(heads, allowMissingColumns=True)
    return map_arrow(_dealt(rows), run, "tree string, at bigint, subroot string, witness string" + (f", {keep}" if keep else ""))


def _placed(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows(tree, ...) with at and nodes: the place in the tree by these columns, from 0, and
    how many the tree has. Ranges are numbered apart; their counts give where each begins."""
    spark = rows.sparkSession
    ranged = rows.withColumn("_scan", F.monotonically_increasing_id()).repartitionByRange("tree", *by, "_scan").sortWithinPartitions("tree", *by, "_scan")
    ranged = written(spark, ranged.drop("_scan").withColumn("_row", F.monotonically_increasing_id()), "ranged").withColumn("_part", F.shiftright("_row", 33))
    counts = ranged.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    tree = Window.partitionBy("tree")
    starts = written(spark, counts.select("tree", "_part", F.sum("_n").over(tree).alias("nodes"), (F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n") - F.col("_first")).alias("_shift")), "starts")
    near = F.broadcast(starts) if starts.count() <= SMALL else starts
    return ranged.join(near, ["tree", "_part"]).withColumn("at", F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift")


def _trees(nodes: DataFrame, fan: int, levels: int) -> list[DataFrame]:
    """Tables of nodes: these, the roots of their blocks, the roots of those, and so on until
    each tree has one."""
    out = [nodes]
    while (out[-1].agg(F.max("nodes")).first()[0] or 0) > 1:
        out.append(written(nodes.sparkSession, _grown(out[-1], fan, levels), "roots"))
    return out


def leaf_hash(text: Column) -> Column:
    """The leaf of a row's FIELDS, with this text."""
    parts = []
    for c in FIELDS:
        s = (text if c == "text" else F.col(c)).cast("string")
        parts.append(F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and its witness give."""
    steps = F.filter(F.split(witness, "/"), lambda x: x != "")
    return F.aggregate(steps, leaf, lambda node, run: F.sha2(F.replace(run, F.lit("|"), node).cast("binary"), 256))


def manifest(docs: DataFrame, tampered: Column | None = None, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, witness, found: for each row of docs what proves that it is
    there. found is the leaf of the row with the text that `tampered` gives in place of its
    own (none: the leaf itself), which `folded` holds against the root."""
    spark = docs.sparkSession
    rows = docs.select(*(F.col(c).cast("bigint" if c in ("doc_id", "n_chars") else "string").alias(c) for c in FIELDS))
    text = F.col("text") if tampered is None else tampered
    leaves = written(spark, rows.select(
        F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0")).alias("tree"), "doc_id",
        leaf_hash(F.col("text")).alias("hash"), F.when(~text.eqNullSafe(F.col("text")), leaf_hash(text)).alias("other")), "leaves")
    trees = _trees(written(spark, _placed(leaves, ["doc_id", "hash"]), "placed"), fan, levels)
    # Each tree has one root now: they are the leaves of the tree over all languages.
    tops = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "hash")
    above = _trees(written(spark, _placed(tops, ["of"]), "placed"), fan, levels)
    root = above[-1].select("hash").first()
    end = above[-1].select("tree", "at", F.lit(None).cast("string").alias("subroot"), F.lit("").alias("witness"))
    for nodes in above[-2::-1]:
        lowest = nodes is above[0]
        end = written(spark, _witnessed(nodes, end, fan, levels, "of string, hash string" if lowest else ""), "witness")
    if len(above) == 1:
        end = above[0].select("tree", "at", "of", "hash", F.lit("").alias("witness"))
    end = end.select(F.col("of").alias("tree"), F.lit(0).cast("bigint").alias("at"), F.col("hash").alias("subroot"), "witness")
    for nodes in trees[-2:0:-1]:
        end = written(spark, _witnessed(nodes, end, fan, levels), "witness")
    if len(trees) == 1:
        out = trees[0].join(end.select("tree", "subroot", "witness"), "tree")
    else:
        out = _witnessed(trees[0], end, fan, levels, "doc_id bigint, hash string, other string")
    return out.select("doc_id", F.col("hash").alias("leaf"), "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), "witness", F.coalesce("other", "hash").alias("found"))


def proofs(docs: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of docs,
    where A-Z are lower-cased in the rows whose doc_id's crc32 3 divides."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % F.lit(3) == 0
    out = manifest(docs, F.when(chosen, low).otherwise(F.col("text")), fan, levels)
    siblings = F.replace(F.replace("witness", F.lit("|"), F.lit("")), F.lit("/"), F.lit(""))
    out = out.withColumn("folded_root", folded(F.col("found"), F.col("witness")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
