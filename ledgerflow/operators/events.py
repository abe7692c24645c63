"""Events, runs and evidence lines as Column rules and DataFrame operators: what an event
means, which of a run's events counts, and how positions, attempts and budgets add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ascii_lower
from .reduce import keep_first

# Codes of test states, keywords of evidence lines, and edges of a run's life.
TEST_STATUS = {1: "passed", 2: "flaky", 3: "timed_out", 4: "failed", 6: "remote_failure", 7: "failed", 8: "failed"}
ERROR_WORDS = ("error:", "fatal:", "no such target", "no such package", "undefined reference", "missing strict dependencies")
EDGES = {"queued": ("starting", "cancelled", "interrupted"), "starting": ("running", "failed", "cancelled", "timed_out", "interrupted"),
         "running": ("succeeded", "failed", "cancelled", "timed_out", "interrupted")}


def aborted_category(reason: Column) -> Column:
    return F.when(reason == 5, "loading").when(reason == 6, "analysis").otherwise("bazel")


def action_message(mnemonic: Column, code: Column) -> Column:
    """A null or empty mnemonic reads as Bazel; a null code as none given."""
    said = F.coalesce(F.nullif(mnemonic, F.lit("")), F.lit("Bazel"))
    return F.concat(said, F.when(code.isNull(), " action failed").otherwise(F.concat(F.lit(" action failed with exit code "), code.cast("string"))))


def test_status(code: Column) -> Column:
    out = F.lit("incomplete")
    for k, name in TEST_STATUS.items():
        out = F.when(code == k, name).otherwise(out)
    return out


def run_outcome(state: Column, cut: Column, late: Column) -> Column:
    """The first that holds of: output cut, cancelled, timed out; else what the state says."""
    return F.when(cut, "output_limit").when(state == "cancelled", "cancelled").when(late, "timed_out").when(state == "succeeded", "succeeded").otherwise("program_failed")


def evidence_priority(line: Column) -> Column:
    """0 to 2 for lines that tell why a run failed, null for the rest."""
    x = ascii_lower(F.trim(line))
    has = lambda w: F.contains(x, F.lit(w))
    any_of = lambda *c: F.expr("false") if not c else c[0] if len(c) == 1 else c[0] | any_of(*c[1:])
    test = x.startswith("test ")
    noise = x.isin("failure:", "failures:") | (test & x.endswith("... ok"))
    return (F.when(noise, None).when(has("root_cause") | has("panicked at") | (has("assertion") & has(" failed")), 0)
            .when(any_of(*map(has, ERROR_WORDS)) | x.startswith("error ") | (has('.go: import of "') & x.endswith('"')), 1)
            .when(has("failed:") | has("failure") | x.startswith("test result: failed") | (test & x.endswith("... failed")), 2))


def legal_steps(df: DataFrame, by: str, order: str, state: str, edges: dict[str, tuple], first: str) -> DataFrame:
    """df with `legal`: whether each state may follow the one before it (the first must be `first`)."""
    was = F.lag(state).over(Window.partitionBy(by).orderBy(order))
    ok = F.lit(False)
    for a, many in edges.items():
        ok = F.when(was == a, F.col(state).isin(*many)).otherwise(ok)
    return df.withColumn("legal", F.when(was.isNull(), F.col(state) == first).otherwise(ok))


def last_of(df: DataFrame, by: str, order: str) -> DataFrame:
    return keep_first(df, [by], [F.desc(order)])


def target_counts(df: DataFrame, by: str, target: str, order: str, ok: Column) -> DataFrame:
    """Of each target's first event: requested, succeeded, failed."""
    first = keep_first(df.withColumn("_ok", ok), [by, target], [order])
    return first.groupBy(by).agg(F.count("*").alias("requested"), F.count_if("_ok").alias("succeeded"), F.count_if(~F.col("_ok")).alias("failed"))


def ordinals(df: DataFrame, by: str, order: str) -> DataFrame:
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(by).orderBy(order)).cast("bigint") - 1)


def charged(df: DataFrame, by: str, order: str, size: Column, name: str = "charged") -> DataFrame:
    """The sum of sizes before each row: the context that it pays for."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("bigint"))


def contiguous(df: DataFrame, by: str, order: str) -> DataFrame:
    """Whether each position is one beyond the one before; the first must be 1."""
    return df.withColumn("contiguous", F.col(order) == F.coalesce(F.lag(order).over(Window.partitionBy(by).orderBy(order)), F.lit(0)) + 1)


def attempts(df: DataFrame, by: str, order: str, ends: Column) -> DataFrame:
    """The attempt of each row: how many rows before it end one."""
    return charged(df, by, order, ends.cast("int"), "attempt")


def filled(df: DataFrame, by: str, order: str, value: Column, name: str) -> DataFrame:
    """The last value that isn't null, up to this row."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def waited(df: DataFrame, by: str, order: str, waits: Column, now: Column | None = None) -> DataFrame:
    """by, waited: time from each waiting row to the next one. A wait that is still open lasts until
    now (none that began later), or counts as 0 where now isn't given or is null."""
    last = F.col(order) if now is None else F.greatest(F.coalesce(now, F.col(order)), F.col(order))
    step = F.coalesce(F.lead(order).over(Window.partitionBy(by).orderBy(order)), last) - F.col(order)
    return df.withColumn("_wait", F.when(waits, F.coalesce(step, F.lit(0))).otherwise(0)).groupBy(by).agg(F.sum("_wait").cast("bigint").alias("waited"))


def sample_of(df: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The first `most` rows of each group."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def extended_expiry(created: Column, expires: Column, terminal: Column) -> Column:
    """A finished result lives on for its time to live, one unit at least."""
    return F.greatest(expires, terminal + F.greatest(expires - created, F.lit(1)))


def missing(required: DataFrame, present: DataFrame, on: str) -> DataFrame:
    return required.select(on).distinct().join(present.select(on).distinct(), on, "left_anti")


def repeated(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).count().where("count > 1").select(name)


def weighted_units(df: DataFrame, by: str, fresh: Column, cached: Column, weights: list[int]) -> DataFrame:
    """by, w, units: 100 * fresh + w * cached for each weight of a short list."""
    return df.withColumn("w", F.explode(F.array(*map(F.lit, weights)))).groupBy(by, "w").agg(F.sum(100 * fresh + F.col("w") * cached).cast("bigint").alias("units"))


def hydrated(headers: DataFrame, details: DataFrame, key: str, absent: dict[str, Column]) -> DataFrame:
    """Each header with its details; of absent ones the columns in `absent` get its values."""
    out = headers.join(details, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), v) for c, v in absent.items()})


def merged_max(a: DataFrame, b: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """Of keys in both, each counter's greatest value. Either side may hold a key often."""
    sides = [x.groupBy(key).agg(*[F.max(c).alias(c) for c in counters]).withColumn("_side", F.lit(k)) for k, x in enumerate((a, b))]
    both = sides[0].unionByName(sides[1]).groupBy(key).agg(F.count("*").alias("_n"), *[F.max(c).alias(c) for c in counters])
    return both.where("_n = 2").drop("_n")


def gates(df: DataFrame, by: str, rules: list[Column]) -> DataFrame:
    """by, pass: whether every row keeps every rule; a null keeps none."""
    ok = F.lit(True)
    for r in rules:
        ok = ok & F.coalesce(r, F.lit(False))
    return df.groupBy(by).agg(F.bool_and(ok).alias("pass"))


def in_turn(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts, each with the rank of the part it came from."""
    out = [p.select(F.lit(k).alias("source_rank"), *p.columns) for k, p in enumerate(parts)]
    first, *rest = out
    for p in rest:
        first = first.unionByName(p)
    return first


def solve_summary(df: DataFrame, by: str, solved: Column, cost: Column) -> DataFrame:
    """by, attempts, solves, solve_percent, and the cost of a solve (null if there is none)."""
    x = df.groupBy(by).agg(F.count("*").alias("attempts"), F.sum(solved).cast("bigint").alias("solves"), F.sum(cost).cast("double").alias("_cost"))
    return x.select(by, "attempts", "solves", F.round(100.0 * F.col("solves") / F.col("attempts"), 6).alias("solve_percent"), F.round(F.col("_cost") / F.nullif(F.col("solves"), F.lit(0)), 6).alias("per_solve"))


def legal_runs(df: DataFrame, by: str, order: str, state: str, edges: dict[str, tuple] = EDGES, first: str = "queued") -> DataFrame:
    """by, steps, legal: whether all of a run's states follow the edges of a run's life."""
    return legal_steps(df, by, order, state, edges, first).groupBy(by).agg(F.count("*").alias("steps"), F.bool_and(F.coalesce("legal", F.lit(False))).alias("legal"))


def routed(streams: DataFrame, known: DataFrame, key: str, header: Column, own: Column, order: str) -> DataFrame:
    """streams with key (the header's, else its own) and verdict: not_found if no run has the
    key, already_exists if an earlier stream of the key is there, else ok."""
    x = streams.withColumn(key, F.coalesce(header, own)).join(known.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return x.withColumn("verdict", F.when(F.col("_known").isNull(), "not_found").when(nth > 1, "already_exists").otherwise("ok")).drop("_known")


def first_there(parts: list[DataFrame], by: str) -> DataFrame:
    """Of each group the rows of the first part that has any; `part` is its number."""
    rows = in_turn(parts).withColumnRenamed("source_rank", "part")
    best = rows.groupBy(by).agg(F.min("part").alias("_best"))
    return rows.join(best, by).where("part = _best").drop("_best")


def measured(df: DataFrame, by: str, kind: str, kinds: list[str], size: Column) -> DataFrame:
    """by, events and bytes of all, and of each named kind."""
    each = [c for k in kinds for c in (F.count_if(F.col(kind) == k).alias(f"{k}_events"), F.coalesce(F.sum(F.when(F.col(kind) == k, size)), F.lit(0)).cast("bigint").alias(f"{k}_bytes"))]
    return df.groupBy(by).agg(F.count("*").alias("events"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"), *each)
