"""What the operators of this folder share: shared storage, task counts, row batches."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, whatever folder they run in."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerflow_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    at = tempfile.mkdtemp()
    target = os.path.join(at, f"ledgerflow_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.relpath(p, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._ledgerflow_shipped = True
    atexit.register(shutil.rmtree, at, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a temporary one, but on one
    machine only: executors of a cluster would not see it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        sc = spark.sparkContext
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = getattr(sc, "_ledgerflow_dir", None)
        if at is None:
            at = sc._ledgerflow_dir = tempfile.mkdtemp(prefix="ledgerflow-")
            atexit.register(shutil.rmtree, at, True)
    return at.rstrip("/")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: the lineage ends here, and the loss of an
    executor costs no more than the read of files that all can reach."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def dealt(df: DataFrame, n: int) -> DataFrame:
    """df in n partitions, each row in the one that its column part names."""
    return df.repartitionById(n, F.pmod("part", F.lit(n)).cast("int"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about `most` bytes of `column`, a row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.names.index(column))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield b.slice(start)


def _give_back() -> None:
    """Free memory of this worker goes back to the system: workers are used again by other
    tasks, beside which it would stay."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


_KEPT: dict = {}


def kept(owner: str, key, make: Callable):
    """What make() gives, once for the tasks of an operator that follow each other in this
    worker; the first task of another operator drops it."""
    if (owner, key) not in _KEPT:
        _KEPT[owner, key] = make()
    return _KEPT[owner, key]


def _drop_others(owner: str) -> None:
    for k in [k for k in _KEPT if k[0] != owner]:
        del _KEPT[k]


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    owner = f.__module__

    def run(batches):
        _drop_others(owner)
        try:
            yield from f(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


def keyed(df: DataFrame) -> DataFrame:
    """df with _key, a hash of doc_id and text; rows that agree in both share it."""
    return df.withColumn("_key", F.xxhash64(F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), F.coalesce("text", F.lit(""))))


def pieces(text: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """text in pieces of about `most` bytes, cut at white space only."""
    at = 0
    while len(text) - at > most:
        m = _SPACE.search(text, at + most)
        if m is None:
            break
        yield text[at:m.start()]
        at = m.end()
    yield text[at:]


_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")
#: A group of more rows than this is hot: its rows are joined by broadcast or salted.
HOT, SALTS, SMALL = 64, 32, 500_000


def joined_by_group(rows: DataFrame, groups: DataFrame, by: str, size: str = "rows") -> DataFrame:
    """rows left joined with groups(by, size, ...), which has one row for each group of more
    than one row. Hot groups are few (at most rows / HOT): they are broadcast if they are at
    most SMALL, else each stands under SALTS salts; so no task gets a whole hot group."""
    hot = groups.where(F.col(size) > HOT)
    cold = groups.where(F.col(size) <= HOT)
    others = [c for c in groups.columns if c != by]
    if hot.count() <= SMALL:
        near = F.broadcast(hot.drop(size))
        one = rows.join(near, by)
        rest = rows.join(F.broadcast(hot.select(by)), by, "left_anti")
    else:
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
        many = hot.drop(size).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("_salt", salt)
        one = salted.join(many, [by, "_salt"]).drop("_salt")
        rest = salted.join(many.select(by, "_salt"), [by, "_salt"], "left_anti").drop("_salt")
    two = rest.join(cold.drop(size), by, "left")
    names = [*rows.columns, *(c for c in others if c != size)]
    return one.select(names).unionByName(two.select(names))


def as_bytes(values: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null counts as empty."""
    return [v or b"" for v in values.cast(pa.binary()).to_pylist()]
