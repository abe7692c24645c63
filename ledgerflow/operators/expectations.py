"""What cases are expected to show, held against what they showed, and live runs against replays.

Findings meet the expectations of their case by the case alone, so that each is shuffled once and
never copied for an expectation. They are streamed past the case's expectations (the side that
a join holds), and all conditions are checked there; what goes on from the join is one row for
each expectation and task, so a case with very many findings is as good as any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import padded_names

#: Of a diagnostic: the columns that an expectation may name, the strongest first.
EQUAL = ("message", "path", "target", "action", "line", "col_no", "repetition_count", "severity", "category")
#: Where what is forbidden may stand.
PLACES = ("message", "path", "target", "artifact_uri", "raw")


def _met(expected: DataFrame, found: DataFrame, fits: Column) -> DataFrame:
    """case, n of the expectations that some finding of their case fits. Each finding goes to its
    case once, and is held against the case's expectations as it streams by."""
    e, f = expected.alias("e"), found.alias("f")
    return f.join(e, (F.col("e.case") == F.col("f.case")) & fits).select("e.case", "e.n").distinct()


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _asked(expected: str, found: Column) -> Column:
    """No wish, or fulfilled."""
    return F.col(expected).isNull() | F.coalesce(found, F.lit(False))


def unmet_diagnostics(expected: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """case, n, rule: expectations without a diagnostic. expected(case, n, rank, message_equals,
    message_prefix, message_contains and a column for each other of EQUAL); diagnostics(case,
    rank and EQUAL). With a rank only the diagnostic there counts; a null asks nothing."""
    wish = {c: "message_equals" if c == "message" else c for c in EQUAL}
    fits = _all([_asked("e.rank", F.col("e.rank") == F.col("f.rank")), *(_asked(f"e.{wish[c]}", F.col(f"e.{wish[c]}") == F.col(f"f.{c}")) for c in EQUAL),
                 _asked("e.message_prefix", F.col("f.message").startswith(F.col("e.message_prefix"))), _asked("e.message_contains", F.col("f.message").contains(F.col("e.message_contains")))])
    met = _met(expected, diagnostics.select("case", "rank", *EQUAL), fits)
    counts = diagnostics.groupBy("case").agg(F.count(F.lit(1)).alias("_there"))
    rule = F.when(F.col("rank").isNull(), "no diagnostic").when(F.col("rank") >= F.coalesce("_there", F.lit(0)), "no such rank").otherwise("diagnostic at rank")
    return expected.join(met, ["case", "n"], "left_anti").join(counts, "case", "left").select("case", "n", rule.alias("rule"))


def unmet_artifacts(expected: DataFrame, artifacts: DataFrame) -> DataFrame:
    """case, n, rule. expected(case, n, name_equals, name_contains, kind, uri_contains,
    locally_available); artifacts(case, name, kind, uri, locally_available)."""
    fits = _all([_asked("e.name_equals", F.col("e.name_equals") == F.col("f.name")), _asked("e.name_contains", F.col("f.name").contains(F.col("e.name_contains"))),
                 _asked("e.kind", F.col("e.kind") == F.col("f.kind")), _asked("e.uri_contains", F.col("f.uri").contains(F.col("e.uri_contains"))),
                 _asked("e.locally_available", F.col("e.locally_available") == F.col("f.locally_available"))])
    met = _met(expected, artifacts, fits)
    return expected.join(met, ["case", "n"], "left_anti").select("case", "n", F.lit("no artifact").alias("rule"))


def present(forbidden: DataFrame, observed: DataFrame, diagnostics: DataFrame, artifacts: DataFrame) -> DataFrame:
    """case, n, rule: what stands where it must not. forbidden(case, n, place, fragment), place one
    of PLACES."""
    def those(found: DataFrame, places: dict[str, str]) -> DataFrame:
        # A finding goes to its case once, with all its texts, whatever is forbidden there.
        e, f = forbidden.where(F.col("place").isin(*places)).alias("e"), found.select("case", *places.values()).alias("f")
        text = F
        for place, column in places.items():
            text = text.when(F.col("e.place") == place, F.col(f"f.{column}"))
        held = (F.col("e.case") == F.col("f.case")) & F.contains(text, F.col("e.fragment"))
        return f.join(e, held).select("e.case", "e.n", F.concat(F.lit("forbidden "), "e.place").alias("rule")).distinct()

    parts = (those(diagnostics, {p: p for p in PLACES[:3]}), those(artifacts, {"artifact_uri": "uri"}), those(observed, {"raw": "raw_text"}))
    return reduce(DataFrame.unionByName, parts)


def failures(expected: DataFrame, observed: DataFrame, diagnostics: DataFrame, artifacts: DataFrame,
             expected_diagnostics: DataFrame, expected_artifacts: DataFrame, forbidden: DataFrame) -> DataFrame:
    """case, rule, n of all that isn't as expected (n null for rules of the case itself).
    expected(case, state, exit_code, headline_equals, headline_contains, inspect_hint,
    max_visible_bytes, max_diagnostics); observed(case, state, exit_code, headline,
    inspect_hint, visible_bytes, raw_text). A case that was not observed fails by the one rule
    `not observed`."""
    e, o = expected.alias("e"), observed.withColumn("_seen", F.lit(True)).alias("o")
    counts = diagnostics.groupBy("case").agg(F.count(F.lit(1)).alias("_there")).alias("c")
    both = e.join(o, F.col("e.case") == F.col("o.case"), "left").join(counts, F.col("e.case") == F.col("c.case"), "left")
    wrong = {
        "state": ~F.col("e.state").eqNullSafe(F.col("o.state")),
        "exit code": ~_asked("e.exit_code", F.col("e.exit_code") == F.col("o.exit_code")),
        "headline": ~_asked("e.headline_equals", F.col("e.headline_equals") == F.col("o.headline")),
        "headline lacks": ~_asked("e.headline_contains", F.col("o.headline").contains(F.col("e.headline_contains"))),
        "inspect hint": ~_asked("e.inspect_hint", F.col("e.inspect_hint") == F.col("o.inspect_hint")),
        "visible bytes": F.col("o.visible_bytes") > F.col("e.max_visible_bytes"),
        "too many diagnostics": F.coalesce("c._there", F.lit(0)) > F.col("e.max_diagnostics"),
    }
    seen = F.col("o._seen").isNotNull()
    rules = F.array_compact(F.array(F.when(~seen, F.lit("not observed")), *(F.when(seen & w, F.lit(r)) for r, w in wrong.items())))
    own = both.select(F.col("e.case").alias("case"), F.explode(rules).alias("rule"), F.lit(None).cast("bigint").alias("n"))
    parts = (unmet_diagnostics(expected_diagnostics, diagnostics), unmet_artifacts(expected_artifacts, artifacts), present(forbidden, observed, diagnostics, artifacts))
    told = reduce(DataFrame.unionByName, parts).join(observed.select("case").distinct(), "case", "left_semi")
    return own.unionByName(told.select("case", "rule", F.col("n").cast("bigint").alias("n")))


def parity(live: DataFrame, replay: DataFrame, live_first: DataFrame, replay_first: DataFrame, live_artifacts: DataFrame, replay_artifacts: DataFrame) -> DataFrame:
    """case, rule: where a live run and its replay differ for a user. live, replay(case, state,
    exit_code, headline, inspect_hint); *_first(case and EQUAL): the diagnostic of the first
    rank; *_artifacts(case, position, name, kind). Names of the workspace count as equal, a hint
    at the log may be gone, and compilation may have become test where a target is unknown.
    Lists are compared place by place, so none is ever gathered."""
    def both(a, b, on=("case",)):
        a, b = a.withColumn("_there", F.lit(True)).alias("a"), b.withColumn("_there", F.lit(True)).alias("b")
        keys = _all(F.col(f"a.{k}") == F.col(f"b.{k}") for k in on)
        return a.join(b, keys, "full").withColumn("_case", F.coalesce("a.case", "b.case"))

    def same(c, over=lambda x: x):
        return over(F.col(f"a.{c}")).eqNullSafe(over(F.col(f"b.{c}")))

    there = F.col("a._there").isNotNull() & F.col("b._there").isNotNull()
    hints = same("inspect_hint") | F.col("a.inspect_hint").eqNullSafe(F.lit("log")) & F.col("b.inspect_hint").isNull()
    heads = F.array_compact(F.array(F.when(~there, F.lit("not in both")), *(F.when(there & ~w, F.lit(r)) for r, w in {"state": same("state"), "exit code": same("exit_code"), "headline": same("headline", padded_names), "inspect hint": hints}.items())))
    promoted = F.array_sort(F.array("a.category", "b.category")).eqNullSafe(F.array(F.lit("compilation"), F.lit("test"))) & (F.col("a.target").isNull() | F.col("b.target").isNull())
    kind = same("category") & same("target") | promoted
    alike = _all([same("severity"), kind, same("message", padded_names), *(same(c) for c in ("path", "line", "col_no", "action", "repetition_count"))])
    first = F.when(~there, "primary diagnostic in one").when(~alike, "primary diagnostic")
    lists = F.when(~(there & same("name") & same("kind")), "artifacts")
    out = [both(live, replay).select(F.col("_case").alias("case"), F.explode(heads).alias("rule")),
           both(live_first, replay_first).select(F.col("_case").alias("case"), first.alias("rule")).where("rule IS NOT NULL"),
           both(live_artifacts, replay_artifacts, ("case", "position")).select(F.col("_case").alias("case"), lists.alias("rule")).where("rule IS NOT NULL").distinct()]
    return reduce(DataFrame.unionByName, out)
