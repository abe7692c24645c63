"""What a build's events say of targets, tests and files, and which diagnostics, tests and
artifacts belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import wildcard

# Severity and head of the message for each test status that is told.
TOLD = {"flaky": ("warning", "Test was flaky: "), "failed": ("error", "Test failed: "), "timed_out": ("error", "Test timed out: "),
        "incomplete": ("error", "Test was incomplete: "), "remote_failure": ("error", "Test result was unavailable: ")}
NOT_KEPT = "test_log_not_snapshotted"


def label_of(*labels: Column) -> Column:
    """The label of the first arm of an event's id that is there; an empty one is null."""
    return F.nullif(F.coalesce(*labels), F.lit(""))


def target_result(label: Column, success: Column) -> Column:
    return F.struct(F.coalesce(label, F.lit("<unknown target>")).alias("label"), success.alias("success"))


def test_result(label: Column, status: Column, duration: Column, attempts: Column, shards: Column) -> Column:
    return F.struct(
        F.coalesce(label, F.lit("<unknown test>")).alias("label"), status.alias("status"), F.when(duration >= 0, duration).cast("bigint").alias("duration_ms"),
        F.greatest(F.coalesce(attempts, F.lit(0)), F.lit(1)).cast("bigint").alias("attempts"), F.when(shards > 0, shards).cast("bigint").alias("shard"), F.when(status != "passed", NOT_KEPT).alias("reason"))


def test_diagnostic(label: Column, status: Column) -> Column:
    """severity, message and target; null for tests that passed or were skipped."""
    severity = message = F.lit(None).cast("string")
    for name, (s, head) in TOLD.items():
        severity = F.when(status == name, s).otherwise(severity)
        message = F.when(status == name, F.concat(F.lit(head), label)).otherwise(message)
    return F.when(severity.isNotNull(), F.struct(severity.alias("severity"), F.lit("test").alias("category"), message.alias("message"), label.alias("target")))


def artifact(prefix: Column, name: Column, uri: Column, symlink: Column, inlined: Column) -> Column:
    """name, kind, uri and locally_available of a file that has one of uri, symlink target and
    inline contents (a boolean); null if it has none. Contents are never shown."""
    local = uri.startswith("file:")
    kind = (F.when(name.isin("test.log", "test.xml"), "test_log").when(F.contains(name, F.lit("coverage")) | name.endswith(".dat"), "coverage").when(local, "file").otherwise("remote"))
    parts = F.filter(F.concat(F.coalesce(prefix, F.array().cast("array<string>")), F.array(name)), lambda p: p != "")
    row = lambda k, u, here: F.struct(F.array_join(parts, "/").alias("name"), k.alias("kind"), u.alias("uri"), here.alias("locally_available"))
    yes, file = F.lit(True), F.lit("file")
    return F.when(uri.isNotNull(), row(kind, uri, local)).when(symlink.isNotNull(), row(file, symlink, yes)).when(inlined, row(file, F.lit("inline://redacted"), yes))


def finished(code: Column, signal: Column) -> Column:
    """How a process ended (null exit code: by a signal, 0 if unknown) and the run's state."""
    how = F.when(code.isNotNull(), F.concat(F.lit("exit "), code.cast("string"))).otherwise(F.concat(F.lit("signal "), F.coalesce(signal, F.lit(0)).cast("string")))
    return F.struct(how.alias("termination"), F.when(code == 0, "succeeded").otherwise("failed").alias("state"))


def recovered(df: DataFrame, alive: DataFrame, key: str, state: str, terminal: tuple) -> DataFrame:
    """Runs that had not ended and whose owner isn't alive any more become interrupted."""
    owners = alive.select(key).distinct().withColumn("_alive", F.lit(True))
    lost = ~F.col(state).isin(*terminal) & F.col("_alive").isNull()
    return df.join(owners, key, "left").withColumn("recovered", F.coalesce(lost, F.lit(False))).withColumn(state, F.when(F.col("recovered"), "interrupted").otherwise(F.col(state))).drop("_alive")


def log_key(label: Column) -> Column:
    """Where under testlogs a test's files lie: package and target of its label."""
    rest = F.substring_index(label, "//", -1)
    package = F.substring_index(rest, ":", 1)
    target = F.when(F.contains(rest, F.lit(":")), F.substring(rest, F.length(package) + 2, F.length(rest)))
    return F.when(target.isNull(), rest).when(package == "", target).otherwise(F.concat(package, F.lit("/"), target))


def with_artifacts(tests: DataFrame, artifacts: DataFrame, label: str = "label", uri: str = "uri") -> DataFrame:
    """Pairs of a test and an artifact under its testlogs folder. Each folder above an artifact
    is a key, so that this is a join on equality and not of all with all."""
    parts = F.split(F.replace(F.col(uri), F.lit("\\"), F.lit("/")), "/", -1)
    x = artifacts.withColumn("_parts", parts)
    # A key is what stands from behind a `testlogs` (not the first part) to any folder's end.
    spots = F.transform("_parts", lambda p, i: F.when((p == "testlogs") & (i > 0), i))
    spans = F.transform(F.filter(spots, lambda i: i.isNotNull()), lambda i: F.transform(F.slice("_parts", i + 2, F.greatest(F.size("_parts") - i - 2, F.lit(0))), lambda _, n: F.array_join(F.slice("_parts", i + 2, n + 1), "/")))
    dealt = x.withColumn("_key", F.explode(F.array_distinct(F.flatten(spans)))).drop("_parts")
    return tests.withColumn("_key", log_key(F.col(label))).join(dealt, "_key").drop("_key")


def matched_labels(events: DataFrame, label: str, hit: Column) -> DataFrame:
    return events.where(hit & F.col(label).isNotNull()).select(label).distinct()


def unsuppressed(diagnostics: DataFrame, labels: DataFrame, label: str, patterns: list[str], actions: list[str], target: str = "target", action: str = "action") -> DataFrame:
    """Diagnostics but those whose target is one of the labels or fits a pattern, or whose
    action is one of the actions. Null targets and actions match nothing."""
    no = F.lit(False)
    hit = F.coalesce(F.col(action).isin(*actions), no) if actions else no
    for p in patterns:
        hit = hit | F.coalesce(wildcard(F.col(target), p), no)
    left = diagnostics.where(~hit)
    gone = labels.select(F.col(label).alias("_label")).distinct()
    return left.join(gone, F.col(target) == F.col("_label"), "left_anti")


def not_retold(existing: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """Those of existing diagnostics that no new one of the run tells again, and better: with
    the same message at the same place or where the old one had none, or with a longer message
    that holds the old one at the same place. Compilation diagnostics go for any, others for
    those of their category if they have no target. Two anti joins on equality, each with the
    rest as its condition, so rows meet only by (run, message) or (run, place)."""
    n = new.select(F.col(by).alias("_by"), F.col("category").alias("_category"), F.col("message").alias("_message"), F.col("path").alias("_path"), F.col("line").alias("_line"), F.col("col_no").alias("_col")).distinct()
    run = F.col(by) == F.col("_by")
    goes = (F.col("category") == "compilation") | ((F.col("category") == F.col("_category")) & F.col("target").isNull())
    place = F.col("path").eqNullSafe(F.col("_path")) & F.col("line").eqNullSafe(F.col("_line")) & F.col("col_no").eqNullSafe(F.col("_col"))
    left = existing.join(n, run & (F.col("message") == F.col("_message")) & goes & (F.col("path").isNull() | place), "left_anti")
    return left.join(n, run & (F.col("path") == F.col("_path")) & F.col("line").eqNullSafe(F.col("_line")) & F.col("col_no").eqNullSafe(F.col("_col")) & goes & F.contains("_message", F.col("message")), "left_anti")


def merged_cases(new: DataFrame, old: DataFrame, by: str, keys: list[str], order: str, most: int = 20) -> DataFrame:
    """Of each group the new cases in order, then old ones with other keys; at most `most`."""
    rest = old.join(new.select(by, *keys).distinct(), [by, *keys], "left_anti")
    kept = new.withColumn("_from", F.lit(0)).unionByName(rest.withColumn("_from", F.lit(1)))
    w = Window.partitionBy(by).orderBy("_from", order)
    return kept.withColumn("position", F.row_number().over(w).cast("bigint") - 1).where(F.col("position") < most).drop("_from")


def last_said(lines: DataFrame, by: str, order: str, line: str = "line", most: int = 8) -> DataFrame:
    """The last `most` lines of each group that aren't blank, in order."""
    some = lines.where(F.col(line).rlike(r"\S"))
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return some.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
