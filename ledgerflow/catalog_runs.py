"""Queries of runs' events, outcomes and results: name -> (query, SQL that says the same)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from .operators import fit, folds, outcomes, plugins
from .sources import build_events as B
from .sources.tables import table
from .sources.test_xml import test_cases

# --- Events of the public format: each row of `events` is encoded and read again ------


def _encoded(batches):
    """A frame for each event: what its type stands for, with numbers out of its id."""
    for b in batches:
        frames = []
        for i, kind, value in zip(b.column("event_id").to_pylist(), b.column("event_type").to_pylist(), b.column("value").to_pylist()):
            label = f"//t:{i % 7}"
            if kind == "click":
                x = B.encode_event("completed", B.encode_event_id("target_completed", label), success=value > 50)
            elif kind == "error":
                x = B.encode_event("aborted", B.encode_event_id("configured_label", label), code=i % 9, description=f"gone {i % 5}")
            elif kind == "purchase":
                x = B.encode_event("action", B.encode_event_id("action_completed", label), success=False, code=-(i % 3), description="Javac")
            elif kind == "signup":
                x = B.encode_event("finished", B.encode_event_id("build_finished"), last=i % 4 == 1, success=i % 3 == 0, code=39 if i % 4 == 0 else i % 3)
            else:
                x = B.encode_event("test_summary", B.encode_event_id("test_summary", label), code=i % 9, attempts=i % 3, shards=i % 4, duration_ms=i * 1_000_003)
            frames.append(x[:-1] if i % 101 == 0 else x)  # now and then the last byte is lost
        yield pa.RecordBatch.from_arrays([b.column("user_id"), b.column("event_id"), pa.array(frames, pa.binary())], ["inv", "ordinal", "frame"])


def _events(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return B.events(raw.mapInArrow(_encoded, "inv bigint, ordinal bigint, frame binary")).drop("frame")


def a06_events(spark, sf_dir):
    return _events(spark, sf_dir).where("ordinal % 101 <> 0")


_A06 = """SELECT user_id AS inv, event_id AS ordinal, CASE event_type WHEN 'click' THEN 'target_completed' WHEN 'error' THEN 'configured_label' WHEN 'purchase' THEN 'action_completed' WHEN 'signup' THEN 'build_finished' ELSE 'test_summary' END AS id_kind,
  CASE WHEN event_type <> 'signup' THEN concat('//t:', event_id % 7) END AS label, CAST(NULL AS VARCHAR) AS set_id, CASE event_type WHEN 'click' THEN 'completed' WHEN 'error' THEN 'aborted' WHEN 'purchase' THEN 'action' WHEN 'signup' THEN 'finished' ELSE 'test_summary' END AS kind,
  event_type = 'signup' AND event_id % 4 = 1 AS last, CASE event_type WHEN 'click' THEN value > 50 WHEN 'purchase' THEN false WHEN 'signup' THEN event_id % 3 = 0 END AS success,
  CASE event_type WHEN 'error' THEN event_id % 9 WHEN 'purchase' THEN -(event_id % 3) WHEN 'signup' THEN CASE WHEN event_id % 4 = 0 THEN 39 ELSE event_id % 3 END WHEN 'view' THEN event_id % 9 END AS code,
  CASE event_type WHEN 'error' THEN concat('gone ', event_id % 5) WHEN 'purchase' THEN 'Javac' END AS description, CASE WHEN event_type = 'view' THEN event_id % 3 END AS attempts, CASE WHEN event_type = 'view' THEN event_id % 4 END AS shards,
  CASE WHEN event_type = 'view' THEN event_id * 1000003 END AS duration_ms, CAST(NULL AS VARCHAR) AS event_error FROM events WHERE event_id % 101 <> 0"""


def s02_outcomes(spark, sf_dir):
    return folds.outcomes(a06_events(spark, sf_dir), "inv")


_S02 = f"""WITH e AS ({_A06}), a AS (SELECT *, coalesce(sum(CASE WHEN kind = 'finished' AND code = 39 THEN 1 ELSE 0 END) OVER (PARTITION BY inv ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS attempt FROM e),
x AS (SELECT * FROM a QUALIFY attempt = max(attempt) OVER (PARTITION BY inv)),
f AS (SELECT inv, kind, label, arg_min(success, ordinal) AS ok, arg_min(code, ordinal) AS code FROM x WHERE kind IN ('completed', 'test_summary') GROUP BY inv, kind, label),
c AS (SELECT inv, count(*) FILTER (kind = 'completed') AS requested, count(*) FILTER (kind = 'completed' AND ok) AS succeeded, count(*) FILTER (kind = 'completed' AND NOT ok) AS failed_targets,
  count(*) FILTER (kind = 'test_summary' AND code = 1) AS passed, count(*) FILTER (kind = 'test_summary' AND code IN (4, 7, 8)) AS failed, count(*) FILTER (kind = 'test_summary' AND code = 2) AS flaky, CAST(0 AS BIGINT) AS skipped, count(*) FILTER (kind = 'test_summary' AND code NOT IN (1, 2, 4, 7, 8)) AS incomplete FROM f GROUP BY inv)
SELECT inv, CAST(any_value(attempt) AS INTEGER) AS attempt, count(*) AS events, arg_max(code, ordinal) FILTER (kind = 'finished') AS exit_code, bool_or(last) AS complete, any_value(coalesce(requested, 0)) AS requested, any_value(coalesce(succeeded, 0)) AS succeeded, any_value(coalesce(failed_targets, 0)) AS failed_targets,
  any_value(coalesce(passed, 0)) AS passed, any_value(coalesce(failed, 0)) AS failed, any_value(coalesce(flaky, 0)) AS flaky, any_value(coalesce(skipped, 0)) AS skipped, any_value(coalesce(incomplete, 0)) AS incomplete FROM x LEFT JOIN c USING (inv) GROUP BY inv"""


def b05_states(spark, sf_dir):
    edges = {"view": ("click", "error"), "click": ("purchase", "view", "error"), "error": ("view",)}
    return folds.current_states(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", edges, "view")


_B05 = """WITH RECURSIVE e AS (SELECT user_id, event_type AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT user_id, 0::BIGINT AS n, CAST(NULL AS VARCHAR) AS state, 0::BIGINT AS refused FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT user_id, m, CASE WHEN ok THEN s ELSE state END, refused + CASE WHEN ok THEN 0 ELSE 1 END FROM (SELECT r.*, e.s, e.n AS m,
    coalesce(CASE WHEN state IS NULL THEN s = 'view' WHEN state = 'view' THEN s IN ('click', 'error') WHEN state = 'click' THEN s IN ('purchase', 'view', 'error') WHEN state = 'error' THEN s = 'view' ELSE false END, false) AS ok FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id, state, refused FROM r QUALIFY n = max(n) OVER (PARTITION BY user_id)"""

# --- Test results in XML: each user's events are a file of suites ------------------------

_CASE = """concat('<testcase name="n', CAST(event_id % 50 AS STRING), '" time="', CASE WHEN event_id % 7 = 0 THEN '-1' WHEN event_id % 11 = 0 THEN 'soon' ELSE concat(CAST(event_id % 90 AS STRING), '.25') END, '">',
  CASE event_type WHEN 'click' THEN '<failure message="f &amp; g"/><skipped/>' WHEN 'error' THEN '<error>gone</error><skipped message="s"/>' WHEN 'signup' THEN '<skipped message="later">text</skipped>' ELSE '' END, '</testcase>')"""


def a20_test_xml(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.struct((F.col("event_id") % 2).alias("suite"), "event_id", F.expr(_CASE).alias("xml")).alias("c"))
    files = e.groupBy("user_id").agg(F.sort_array(F.collect_list("c")).alias("cases"))
    suite = lambda k: F.concat(F.lit("<testsuite>"), F.array_join(F.transform(F.filter("cases", lambda c: c["suite"] == k), lambda c: c["xml"]), ""), F.lit("</testsuite>"))
    end = F.when(F.col("user_id") % 13 == 0, "</testsuite>").otherwise("</testsuites>")  # some files are broken
    return test_cases(files.select("user_id", F.concat(F.lit("<testsuites>"), suite(0), suite(1), end).alias("xml")), "xml")


_A20 = """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2, event_id) - 1 AS position, concat('n', event_id % 50) AS name, CASE WHEN event_type IN ('click', 'error') THEN 'failed' WHEN event_type = 'signup' THEN 'skipped' ELSE 'passed' END AS status,
  CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE event_id % 90 * 1000 + 250 END AS duration_ms, CASE event_type WHEN 'click' THEN 'f & g' WHEN 'error' THEN 'gone' WHEN 'signup' THEN 'later' END AS message, CAST(NULL AS VARCHAR) AS error FROM events WHERE user_id % 13 <> 0
UNION ALL SELECT DISTINCT user_id, CAST(NULL AS BIGINT), NULL, NULL, CAST(NULL AS BIGINT), NULL, 'the text is not well-formed' FROM events WHERE user_id % 13 = 0"""

# --- Results within a number of bytes ------------------------------------------------------


def h11_fitting_pages(spark, sf_dir):
    """Each conversation as a page of 2,000 bytes; the cursor is the turn's number."""
    c = table(spark, sf_dir, "conversations")
    size = fit.json_object_bytes({"turn": fit.json_number_bytes(F.col("turn")), "role": fit.json_text_bytes(F.col("role")), "text": fit.json_text_bytes(F.col("text"))})
    out = fit.fitting_pages(c, "conv_id", "turn", size, 2_000, 40, fit.json_number_bytes(F.col("turn")), 4)
    return out.select("conv_id", "turn", "kept", "truncated", F.col("next_order").alias("next_turn"))


_H11 = r"""WITH j AS (SELECT conv_id, turn, strlen(concat('{"turn":', turn, ',"role":', CAST(to_json(role) AS VARCHAR), ',"text":', CAST(to_json(text) AS VARCHAR), '}')) AS size FROM conversations),
s AS (SELECT *, row_number() OVER w AS n, sum(size) OVER w AS total FROM j WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT conv_id, coalesce(max(n) FILTER (total + n - 1 + 40 + strlen(CAST(turn AS VARCHAR)) <= 2000), 0) AS best, count(*) AS c FROM s GROUP BY conv_id)
SELECT conv_id, turn, n <= best AS kept, best < c AS truncated, max(CASE WHEN n <= best THEN turn END) OVER (PARTITION BY conv_id) AS next_turn FROM s JOIN b USING (conv_id)"""


def h12_fitted_results(spark, sf_dir):
    """Each customer as a result of 250 bytes: orders in turn as diagnostics, sample and excerpt."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("headline"), F.col("c_mktsegment").alias("command"), F.lit(90).cast("bigint").alias("base"))
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderkey") % 3 == 0, "diagnostics").when(F.col("o_orderkey") % 3 == 1, "query_sample").otherwise("output_excerpt")
    items = o.select(F.col("o_custkey").alias("id"), kind.alias("list"), F.col("o_orderkey").alias("position"), fit.json_text_bytes(F.col("o_orderpriority")).alias("size"))
    heads, left = fit.fitted_results(c, items, "id", F.lit(250))
    n = left.groupBy(F.col("id").alias("_id")).agg(*(F.count_if(F.col("list") == k).alias(k) for k in fit.GIVEN_UP))
    return heads.join(n, F.col("id") == F.col("_id"), "left").drop("_id", "base").fillna(0, [*fit.GIVEN_UP])


_H12 = """WITH h AS (SELECT c_custkey AS id, c_name AS headline, c_mktsegment AS command, 90 + strlen(c_name) + 2 + strlen(c_mktsegment) + 2 AS fixed FROM customer),
i AS (SELECT o_custkey AS id, 3 - CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS rank, o_orderkey AS position, strlen(o_orderpriority) + 2 AS size FROM orders),
s AS (SELECT *, sum(size + c) OVER (PARTITION BY id ORDER BY rank, position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used, sum(size + c) OVER (PARTITION BY id) AS total FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY id, rank ORDER BY position) > 1 THEN 1 ELSE 0 END AS c FROM i)),
k AS (SELECT s.*, total <= 250 - fixed OR (used <= 251 - fixed AND used < total) AS kept FROM s JOIN h USING (id)),
g AS (SELECT id, count(*) FILTER (kept AND rank = 1) AS diagnostics, count(*) FILTER (kept AND rank = 2) AS query_sample, count(*) FILTER (kept AND rank = 3) AS output_excerpt, bool_or(NOT kept) AS cut, coalesce(max(used) FILTER (kept), 0) AS used FROM k GROUP BY id)
SELECT h.id, headline, command, coalesce(cut, false) AS truncated, CAST(fixed + coalesce(used, 0) - CASE WHEN cut THEN 1 ELSE 0 END AS BIGINT) AS bytes, coalesce(diagnostics, 0) AS diagnostics, coalesce(query_sample, 0) AS query_sample, coalesce(output_excerpt, 0) AS output_excerpt FROM h LEFT JOIN g USING (id)"""

# --- Diagnostics told again, and plug-ins ----------------------------------------------------

_TOLD = """user_id AS inv, event_id, CASE event_id % 3 WHEN 0 THEN 'compilation' WHEN 1 THEN 'test' ELSE 'loading' END AS category, concat('no ', event_type, CASE WHEN event_id % 2 = 0 THEN ' at all' ELSE '' END) AS message,
  CASE WHEN event_id % 4 <> 3 THEN concat('f', CAST(event_id % 2 AS STRING)) END AS path, CASE WHEN event_id % 4 < 2 THEN event_id % 3 END AS line, CAST(NULL AS BIGINT) AS col_no, CASE WHEN event_id % 5 = 0 THEN '//t' END AS target"""


def e03_retold(spark, sf_dir):
    """Events of low value as a run's diagnostics, the others as those of its test logs."""
    e = table(spark, sf_dir, "events").selectExpr("value", *(x.strip() for x in _split(_TOLD)))
    out = outcomes.not_retold(e.where("value < 70").drop("value"), e.where("value >= 70").drop("value"), "inv")
    return out.select("inv", "event_id", "category", "message")


def _split(columns: str) -> list[str]:
    """Columns of a SELECT, cut at commas outside of brackets."""
    out, depth = [""], 0
    for c in columns:
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


_E03 = f"""WITH e AS (SELECT value, {_TOLD.replace('AS STRING', 'AS VARCHAR')} FROM events)
SELECT inv, event_id, category, message FROM e x WHERE value < 70 AND NOT EXISTS (SELECT 1 FROM e n WHERE n.value >= 70 AND n.inv = x.inv AND (x.category = 'compilation' OR (x.category = n.category AND x.target IS NULL))
  AND ((x.message = n.message AND (x.path IS NULL OR (x.path IS NOT DISTINCT FROM n.path AND x.line IS NOT DISTINCT FROM n.line))) OR (x.path = n.path AND x.line IS NOT DISTINCT FROM n.line AND contains(n.message, x.message))))"""


def _counts(context):
    found = plugins.regex_matches("\n".join(e["message"] or "" for e in context["events"]), r"no (?P<what>\w+)", 1_000)
    kinds = sorted({m["what"] for m in found})
    return plugins.patch([plugins.diagnostic(f"{len(found)} of {','.join(kinds)}", category="workspace")], headline=f"{len(kinds)} kinds")


def _takes(context):
    return plugins.patch([plugins.diagnostic("taken over", category="test")], headline="never", suppress_builtin_diagnostics=True)


def _fails(context):
    raise ValueError(f"{len(context['events'])} events")


PLUGINS = plugins.Plugins([
    plugins.Plugin("counts", _counts, priority=2), plugins.Plugin("takes", _takes, priority=1, override=True, labels=("//t:*",)),
    plugins.Plugin("late", _takes, override=True, actions=("view",)), plugins.Plugin("fails", _fails, commands=("test",)), plugins.Plugin("over", lambda c: plugins.patch([plugins.diagnostic("x")] * 101), kinds=("none",))])


def u02_plugins(spark, sf_dir):
    """Each user's events as a run: what its plug-ins did, and how many diagnostics it has then."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("inv"), F.col("event_id").alias("ordinal"), F.when(F.col("event_id") % 40 == 0, F.concat(F.lit("//t:"), (F.col("event_id") % 3).cast("string"))).alias("label"),
        F.lit(None).cast("string").alias("target_kind"), F.col("event_type").alias("action_type"), F.concat(F.lit("no "), "event_type").alias("message"))
    runs = e.groupBy("inv").agg(F.max("ordinal").alias("n")).select("inv", F.when(F.col("n") % 2 == 0, "test").otherwise("build").alias("command"))
    told = plugins.reports(runs, e, "inv", PLUGINS)
    null = F.lit(None)
    d = e.select("inv", "ordinal", F.lit("error").alias("severity"), F.lit("test").alias("category"), "message", null.cast("string").alias("path"), null.cast("bigint").alias("line"), null.cast("bigint").alias("col_no"),
                 F.concat(F.lit("//t:"), (F.col("ordinal") % 6).cast("string")).alias("target"), F.when(F.col("ordinal") % 10 == 0, "Javac").alias("action"), F.lit(1).cast("bigint").alias("repetition_count"))
    n = plugins.applied(d, told, "inv").groupBy(F.col("inv").alias("_inv")).agg(F.count(F.lit(1)).alias("diagnostics"))
    return told.join(n, F.col("inv") == F.col("_inv"), "left").select(
        "inv", "headline", F.array_join("applied", ",").alias("applied"), F.size("collisions").cast("bigint").alias("collisions"), F.array_join(F.transform("failures", lambda f: F.concat(f["name"], F.lit(": "), f["error"])), ";").alias("failures"),
        F.array_join("labels", ",").alias("labels"), F.coalesce("diagnostics", F.lit(0)).alias("diagnostics"), "input_truncated")


_U02 = """WITH e AS (SELECT user_id AS inv, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
g AS (SELECT inv, max(event_id) AS n, count(*) AS c, least(count(*), 1000) AS seen, count(DISTINCT event_type) FILTER (k <= 1000) AS kinds, string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (k <= 1000) AS names,
  string_agg(DISTINCT concat('//t:', event_id % 3), ',' ORDER BY concat('//t:', event_id % 3)) FILTER (k <= 1000 AND event_id % 40 = 0) AS labels, bool_or(event_type = 'view' AND k <= 1000) AS views FROM e GROUP BY inv)
SELECT inv, concat(kinds, ' kinds') AS headline, CASE WHEN labels IS NOT NULL THEN 'counts,takes' WHEN views THEN 'counts,late' ELSE 'counts' END AS applied, CASE WHEN labels IS NOT NULL AND views THEN 1 ELSE 0 END AS collisions,
  CASE WHEN n % 2 = 0 THEN concat('fails: ', seen, ' events') ELSE '' END AS failures,
  CASE WHEN labels IS NOT NULL THEN labels WHEN views THEN '' ELSE '' END AS labels,
  CASE WHEN labels IS NOT NULL THEN 2 WHEN views THEN c + 2 ELSE c + 1 END AS diagnostics, c > 1000 AS input_truncated FROM g"""

QUERIES = {
    "a06_events": (a06_events, _A06),
    "s02_outcomes": (s02_outcomes, _S02),
    "b05_states": (b05_states, _B05),
    "a20_test_xml": (a20_test_xml, _A20),
    "h11_fitting_pages": (h11_fitting_pages, _H11),
    "h12_fitted_results": (h12_fitted_results, _H12),
    "e03_retold": (e03_retold, _E03),
    "u02_plugins": (u02_plugins, _U02),
}
