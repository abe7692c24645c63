"""Which ledger rows go: by age, then oldest first until the quota's low-water mark; and how they
go: first by a list that hides them, then from the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def plan(df: DataFrame, cutoff: int, quota: int, low_percent: int = 80) -> DataFrame:
    """df(id, finished, bytes, live, protected) -> id, action in keep, prune, delete. Live rows
    count but never go. Bytes are summed by day first, so that only the running totals of
    days pass through one task and each day's rows are summed on their own."""
    day = F.floor(F.coalesce("finished", F.lit(0)) / 86_400_000).cast("bigint")
    rows = df.withColumn("_day", day).withColumn("_old", ~F.col("live") & (F.coalesce("finished", F.lit(-(1 << 62))) <= cutoff))
    left = rows.where(~F.col("_old"))
    total = left.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("t")).first()["t"]
    low = quota * low_percent // 100
    aged = rows.where("_old").select("id", F.lit(True).alias("_go"), "protected")
    if total <= quota:
        rest = left.select("id", F.lit(False).alias("_go"), "protected")
    else:
        can = left.where("not live")
        days = can.groupBy("_day").agg(F.sum("bytes").alias("b"))
        before = days.select("_day", F.coalesce(F.sum("b").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        own = Window.partitionBy("_day").orderBy(F.asc_nulls_first("finished"), "id").rowsBetween(Window.unboundedPreceding, -1)
        walked = can.join(F.broadcast(before), "_day").withColumn("_sum", F.col("_before") + F.coalesce(F.sum("bytes").over(own), F.lit(0)))
        rest = walked.select("id", (F.lit(total) - F.col("_sum") > low).alias("_go"), "protected").unionByName(left.where("live").select("id", F.lit(False).alias("_go"), "protected"))
    action = F.when(~F.col("_go"), "keep").when(F.col("protected"), "prune").otherwise("delete")
    return aged.unionByName(rest).select("id", action.alias("action"))


def reclaimed(chosen: DataFrame, ledger: DataFrame, now: int) -> DataFrame:
    """What becomes of the chosen(id), as ledger(id, terminal, deferred, expires, evidence_bytes,
    manifest_bytes) is now, not as it was when they were chosen: id, action, bytes given back. A
    run that isn't there or not at its end is left alone (skip); one with a deferred result that
    hasn't expired loses its evidence only (prune); others go as a whole (delete). An id that is
    chosen twice goes once."""
    rows = chosen.select("id").distinct().join(ledger, "id", "left")
    ends = F.coalesce("terminal", F.lit(False))
    held = F.coalesce("deferred", F.lit(False)) & ~F.coalesce(F.col("expires") <= now, F.lit(False))
    action = F.when(~ends, "skip").when(held, "prune").otherwise("delete")
    evidence, manifest = (F.coalesce(c, F.lit(0)) for c in ("evidence_bytes", "manifest_bytes"))
    back = F.when(~ends, 0).when(held, evidence).otherwise(evidence + manifest)
    return rows.select("id", action.alias("action"), back.cast("bigint").alias("bytes"))


class Reclaim:
    """Two phases over tables of Parquet that are partitioned by a column. hide() writes what
    goes under the number of its pass, which is the decision: from then on without() leaves
    those rows out, whatever the files hold. unlink() takes them from the files; it may stop
    at any place and be called again, and then touches only what is left."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def hide(self, actions: DataFrame, number: int) -> None:
        """A pass that is written again replaces itself."""
        actions.where("action <> 'skip'").select("id", "action").write.mode("overwrite").parquet(f"{self.root}/pass={number}")

    def hidden(self, evidence: bool) -> DataFrame:
        """The ids whose evidence goes, or which go as a whole."""
        rows = self.spark.read.schema("id bigint, action string, pass long").parquet(self.root)
        return (rows if evidence else rows.where("action = 'delete'")).select("id").distinct()

    def without(self, rows: DataFrame, evidence: bool) -> DataFrame:
        return rows.join(self.hidden(evidence), "id", "left_anti")

    def unlink(self, path: str, by: str, evidence: bool) -> int:
        """Partitions that held hidden rows. Each is replaced as a whole; one that has no rows left
        is removed. The others aren't read beyond their ids."""
        def touched():
            return [r[0] for r in self.spark.read.parquet(path).join(self.hidden(evidence), "id", "left_semi").select(by).distinct().collect()]

        found = touched()
        if found:
            left = self.without(self.spark.read.parquet(path).where(F.col(by).isin(found)), evidence)
            left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
            for value in touched():  # those that nothing was written to
                place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={value}")
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        return len(found)
