"""The fold of a run's events into its outcome, over tables: the twin of the stream's fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .events import test_status

#: Fixed value: the exit code of a build that is about to be retried.
RETRIED = 39
COUNTS = ("passed", "failed", "flaky", "skipped", "incomplete")


def kept_attempts(events: DataFrame, by: str, order: str = "ordinal") -> DataFrame:
    """The events of each run's last attempt that has any, with `attempt`. An attempt ends with
    the finish that says it is retried; what came before a retry is discarded."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    again = (F.col("kind") == "finished") & (F.col("code") == RETRIED)
    x = events.withColumn("attempt", F.coalesce(F.count_if(again).over(w), F.lit(0)).cast("int"))
    return x.withColumn("_last", F.max("attempt").over(Window.partitionBy(by))).where("attempt = _last").drop("_last")


def outcomes(events: DataFrame, by: str, order: str = "ordinal") -> DataFrame:
    """by, attempt, events, requested, succeeded, failed, COUNTS of tests, exit_code, complete:
    targets and tests by label, the first one of a label counts."""
    x = kept_attempts(events, by, order)
    whole = x.groupBy(by).agg(F.first("attempt").alias("attempt"), F.count(F.lit(1)).alias("events"), F.max_by("code", F.when(F.col("kind") == "finished", F.col(order))).alias("exit_code"), F.bool_or("last").alias("complete"))
    labels = x.where("kind in ('completed', 'test_summary')").groupBy(by, "kind", F.coalesce("label", F.lit("<unknown>")).alias("label")).agg(F.min_by(F.struct("success", "code"), order).alias("v"))
    target, test = F.col("kind") == "completed", F.col("kind") == "test_summary"
    status = test_status(F.col("v.code"))
    of = {"passed": ("passed",), "failed": ("failed",), "flaky": ("flaky",), "skipped": ("skipped",), "incomplete": ("timed_out", "incomplete", "remote_failure")}
    counts = labels.groupBy(by).agg(
        F.count_if(target).alias("requested"), F.count_if(target & F.col("v.success")).alias("succeeded"), F.count_if(target & ~F.col("v.success")).alias("failed_targets"),
        *(F.count_if(test & status.isin(*of[k])).alias(k) for k in COUNTS))
    counts = counts.withColumnRenamed(by, "_by")
    out = whole.join(counts, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    return out.fillna(0, ["requested", "succeeded", "failed_targets", *COUNTS])


def current_states(log: DataFrame, by: str, order: str, state: str, edges: dict[str, tuple], first: str) -> DataFrame:
    """by, the state that its log leads to, and how many of the log's steps were refused: a step is
    taken if it may follow the last one that was taken. A run's few steps meet in one row."""
    def step(s, x):
        to = x["state"]
        ok = F.lit(False)
        for a, many in edges.items():
            ok = F.when(s["state"] == a, to.isin(*many)).otherwise(ok)
        ok = F.when(s["state"].isNull(), to == first).otherwise(ok)
        ok = F.coalesce(ok, F.lit(False))
        return F.struct(F.when(ok, to).otherwise(s["state"]).alias("state"), (s["refused"] + F.when(ok, 0).otherwise(1)).alias("refused"))

    zero = F.struct(F.lit(None).cast("string").alias("state"), F.lit(0).alias("refused"))
    steps = F.sort_array(F.collect_list(F.struct(F.col(order).alias("order"), F.col(state).alias("state"))))
    return log.groupBy(by).agg(F.aggregate(steps, zero, step).alias("v")).select(by, F.col("v.state").alias("state"), F.col("v.refused").cast("bigint").alias("refused"))
