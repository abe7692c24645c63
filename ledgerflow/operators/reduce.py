"""Deduplicate, rank and bound diagnostics; each an operation on DataFrames of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ascii_lower

MOST_REPEATS = (1 << 32) - 1
#: The rank of each severity and category.
SEVERITY = {"error": 0, "warning": 1, "note": 2}
TIER = {"loading": 0, "visibility": 0, "analysis": 0, "compilation": 0, "test": 1, "workspace": 2, "bazel": 3, "unknown": 4, "action": 5}


def ranked_by(c: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(max(ranks.values()) + 1)
    for name, rank in ranks.items():
        out = F.when(c == name, F.lit(rank)).otherwise(out)
    return out


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(w)).where("_row = 1").drop("_row")


def deduplicate(df: DataFrame, order: str = "ordinal") -> DataFrame:
    """Equal (inv, severity, category, message, path, line, col_no, target, action) become one row with
    the sum of repetitions and the first position. Of actions the target isn't part of the
    key, and is null where the group has several."""
    is_action = F.col("category") == "action"
    key = df.withColumn("_target", F.when(is_action, F.lit(None)).otherwise(F.col("target")))
    out = key.groupBy("inv", "severity", "category", "message", "path", "line", *[c for c in ("col_no",) if c in df.columns], "_target", "action").agg(
        F.least(F.sum("repetition_count"), F.lit(MOST_REPEATS)).alias("repetition_count"),
        F.min(order).alias(order),
        F.min("target").alias("_low"),
        F.count_distinct(F.coalesce("target", F.lit("\0"))).alias("_kinds"),
    )
    target = F.when(is_action, F.when(F.col("_kinds") == 1, F.col("_low"))).otherwise(F.col("_target"))
    return out.withColumn("target", target).drop("_target", "_low", "_kinds")


def quality(message: Column, located: Column, category: Column) -> Column:
    """How much a message tells, 0 most. Keywords are found in ASCII letters of either case."""
    x = ascii_lower(message)
    has = lambda w: F.contains(x, F.lit(w))
    executing = has("error executing")
    panic = has("panicked at") | (has("assertion") & has(" failed"))
    only_state = x.startswith("test failed:") | x.startswith("test timed out:") | x.startswith("test was incomplete:") | x.startswith("test result was unavailable:")
    return F.when(located | (has("root_cause") & ~executing), 0).when((category == "test") & panic, 1).when(only_state, 3).when(executing, 2).otherwise(1)


def rank(df: DataFrame, order: str = "ordinal") -> DataFrame:
    w = Window.partitionBy("inv").orderBy(ranked_by(F.col("severity"), SEVERITY), ranked_by(F.col("category"), TIER), quality(F.col("message"), F.col("path").isNotNull(), F.col("category")), order)
    return df.withColumn("rank", F.row_number().over(w).cast("bigint") - 1)


def within_bytes(df: DataFrame, size: Column, most: int, items: int, by: str = "inv", order: str = "rank") -> DataFrame:
    """The first rows of each group, at most `items`, that fit in `most` bytes together; a row
    that doesn't fit is left out and later ones are still tried. `truncated`: whether rows of
    the group were left out. Only those `items` rows are gathered, and df is planned once."""
    others = [c for c in df.columns if c != by]
    row = F.struct(F.col(order).alias("_order"), size.cast("bigint").alias("_size"), F.struct(*others).alias("_row"))
    groups = df.groupBy(by).agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(F.when(F.col(order) < items, row)), lambda a, b: F.when(a["_order"] < b["_order"], -1).otherwise(1)).alias("_rows"))
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.filter("_rows", lambda _: F.lit(False)).alias("kept"))

    def step(s: Column, x: Column) -> Column:
        used = s["used"] + x["_size"]
        return F.when(used <= most, F.struct(used.alias("used"), F.array_append(s["kept"], x).alias("kept"))).otherwise(s)

    kept = groups.select(by, "_n", F.aggregate("_rows", zero, step, lambda s: s["kept"]).alias("_kept"))
    return kept.select(by, F.explode("_kept").alias("_one"), (F.col("_n") > F.size("_kept")).alias("truncated")).select(by, "_one._row.*", "truncated")


def up_to_bytes(df: DataFrame, size: Column, most: int, by: str, order: list) -> DataFrame:
    """The first rows of each group until one would go beyond `most` bytes."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_used", F.sum(size).over(w)).where(F.col("_used") <= most).drop("_used")


def root_causes(df: DataFrame, items: int = 20, most: int = 4096) -> DataFrame:
    return within_bytes(rank(deduplicate(df)), F.octet_length("message"), most, items)


def finalized(df: DataFrame, items: int = 20, most: int = 4096) -> DataFrame:
    """root_causes with the run's headline, which is its first diagnostic, and a hint where
    some were left out. At most `items` rows of each run are sorted a second time."""
    first = Window.partitionBy("inv").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = root_causes(df, items, most)
    return out.withColumn("headline", F.concat(F.lit("Bazel failed: "), F.first("message").over(first))).withColumn("inspect_hint", F.when(F.col("truncated"), "diagnostics"))


def context_matches(df: DataFrame, hit: Column, order: str = "ordinal", label: str = "label") -> DataFrame:
    """Rows that hit, and neighbours (by position) with the same label."""
    w = Window.partitionBy("inv").orderBy(order)
    x = df.withColumn("_hit", hit)

    def near(f):
        return F.coalesce(f("_hit").over(w) & f(label).over(w).eqNullSafe(F.col(label)), F.lit(False))

    return x.withColumn("_near", F.col("_hit") | near(F.lag) | near(F.lead)).where("_near").drop("_hit", "_near")


def test_counts(df: DataFrame) -> DataFrame:
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    return df.groupBy("inv").agg(of("passed").alias("passed"), of("failed").alias("failed"), of("flaky").alias("flaky"), of("skipped").alias("skipped"), of("timed_out", "incomplete", "remote_failure").alias("incomplete"))
