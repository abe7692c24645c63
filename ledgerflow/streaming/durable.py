"""A durable log before anything is seen, and a view of each key's latest row.

Each micro-batch is first written to the log, in a folder of its own number, and only what
was read back from there is worked on. A batch that is replayed after a failure overwrites
its own folder with the same rows, so it changes nothing. The view is the last snapshot and
the batches after it; every `every` batches a snapshot is made of both, so a read never
sees more than `every` batches and one row a key. A row of a key's later attempt hides those
of its earlier ones, however high their versions are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class DurableLog:
    def __init__(self, root: str, schema: StructType | str, key: str, version: str, attempt: str | None = None, every: int = 20, then: Callable[[DataFrame, int], None] | None = None):
        self.root, self.key, self.version, self.attempt, self.every, self.then = root.rstrip("/"), key, version, attempt, every, then
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _exists(self, spark: SparkSession, path: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    def latest(self, rows: DataFrame) -> DataFrame:
        """One row a key: of the last attempt the highest version; equal ones are told apart by all
        columns. An aggregate, not a window: no key's rows are sorted."""
        order = [*([self.attempt] if self.attempt else []), self.version, *sorted(set(rows.columns) - {self.attempt, self.version})]
        best = rows.groupBy(self.key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
        return best.select("_row.*")

    def write(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        spark = batch.sparkSession
        at = f"{self.root}/log/batch={number}"
        batch.select(*self.schema.names).write.mode("overwrite").parquet(at)
        if (number + 1) % self.every == 0:
            # Until it is there as a whole, with its mark, the snapshot before it is read.
            self.view(spark, number).write.mode("overwrite").parquet(f"{self.root}/view/upto={number}")
        if self.then is not None:
            self.then(spark.read.schema(self.schema).parquet(at), number)

    def log(self, spark: SparkSession, first: int = 0, last: int | None = None) -> DataFrame:
        if not self._exists(spark, f"{self.root}/log"):
            return spark.createDataFrame([], self.schema)
        schema = StructType([*self.schema.fields]).add("batch", "long")
        rows = spark.read.schema(schema).parquet(f"{self.root}/log").where(F.col("batch") >= first)
        return (rows if last is None else rows.where(F.col("batch") <= last)).drop("batch")

    def view(self, spark: SparkSession, last: int | None = None) -> DataFrame:
        """The latest row of each key, as of batch `last` (none: now). Batches of the log are
        pruned by their folders."""
        upto = self._snapshot(spark, last)
        rows = self.log(spark, upto + 1, last)
        if upto >= 0:
            rows = spark.read.schema(self.schema).parquet(f"{self.root}/view/upto={upto}").unionByName(rows)
        return self.latest(rows)

    def _snapshot(self, spark: SparkSession, last: int | None) -> int:
        """The last whole snapshot before batch `last`."""
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/view")
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return -1
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        numbers = [int(n.removeprefix("upto=")) for n in names if n.startswith("upto=")]
        numbers = [n for n in numbers if (last is None or n < last) and self._exists(spark, f"{self.root}/view/upto={n}/_SUCCESS")]
        return max(numbers, default=-1)
