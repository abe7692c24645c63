"""All queries of the engine's own operators on the driver's tables, with SQL that says
the same. SHARED is the SQL of the queries in OPERATORS."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import catalog_builds, catalog_cases, catalog_logs, catalog_runs
from .functions import text as T
from .operators import events as E
from .operators import graph, outcomes, pages, parsers, reduce, retention, stats
from .sources.tables import table

UP = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


# --- Diagnostics out of events -------------------------------------------------------

#: One message for each rule of quality.
MESSAGES = ["failure", "Test failed: //a:b", "TEST TIMED OUT: //a:b", "ROOT_CAUSE is x", "Error executing root_cause", "thread panicked at a.rs", "Assertion x failed", "test was incomplete: y", "test result was unavailable: z"]


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error and purchase events as diagnostics of their user: a stand-in for an event stream."""
    e = table(spark, sf_dir, "events").where("event_type in ('error', 'purchase', 'signup')")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        F.col("user_id").alias("inv"), F.col("event_id").alias("ordinal"),
        F.when(F.col("event_type") == "signup", "warning").otherwise("error").alias("severity"),
        F.when(F.col("event_type") == "error", "compilation").when(F.col("event_type") == "purchase", "action").otherwise("test").alias("category"),
        F.element_at(F.array(*map(F.lit, MESSAGES)), (k % len(MESSAGES) + 1).cast("int")).alias("message"),
        F.when(k % 2 == 0, F.concat(F.lit("src/f"), (k % 4).cast("string"))).alias("path"),
        F.when(k % 2 == 0, k % 5).alias("line"), F.when(k % 2 == 0, k % 3).alias("col_no"),
        F.concat(F.lit("//app:t"), (k % 2).cast("string")).alias("target"), F.col("event_type").alias("action"),
        F.lit(1).cast("bigint").alias("repetition_count"))


_DIAG = f"""
k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IN ('error', 'purchase', 'signup')),
d AS (SELECT user_id AS inv, event_id AS ordinal,
  CASE event_type WHEN 'signup' THEN 'warning' ELSE 'error' END AS severity,
  CASE event_type WHEN 'error' THEN 'compilation' WHEN 'purchase' THEN 'action' ELSE 'test' END AS category,
  ([{', '.join(repr(m) for m in MESSAGES)}])[k % {len(MESSAGES)} + 1] AS message,
  CASE WHEN k % 2 = 0 THEN 'src/f' || CAST(k % 4 AS VARCHAR) END AS path, CASE WHEN k % 2 = 0 THEN k % 5 END AS line, CASE WHEN k % 2 = 0 THEN k % 3 END AS col_no,
  '//app:t' || CAST(k % 2 AS VARCHAR) AS target, event_type AS action FROM k),
g AS (SELECT inv, severity, category, message, path, line, col_no, CASE WHEN category = 'action' THEN NULL ELSE target END AS t, action,
  CAST(least(count(*), 4294967295) AS BIGINT) AS repetition_count, min(ordinal) AS ordinal, min(target) AS low, count(DISTINCT target) AS kinds
  FROM d GROUP BY ALL),
f AS (SELECT inv, severity, category, message, path, line, col_no, action, repetition_count, ordinal,
  CASE WHEN category = 'action' THEN CASE WHEN kinds = 1 THEN low END ELSE t END AS target FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY inv ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END,
  CASE category WHEN 'compilation' THEN 0 WHEN 'test' THEN 1 ELSE 5 END, CASE WHEN path IS NOT NULL OR (contains(lower(message), 'root_cause') AND NOT contains(lower(message), 'error executing')) THEN 0
    WHEN category = 'test' AND (contains(lower(message), 'panicked at') OR (contains(lower(message), 'assertion') AND contains(lower(message), ' failed'))) THEN 1
    WHEN regexp_matches(lower(message), '^(test failed:|test timed out:|test was incomplete:|test result was unavailable:)') THEN 3
    WHEN contains(lower(message), 'error executing') THEN 2 ELSE 1 END, ordinal) - 1 AS rank FROM f)
"""


def f03_deduplicate(spark, sf_dir):
    return reduce.deduplicate(diagnostics(spark, sf_dir))


def h01_rank(spark, sf_dir):
    return reduce.rank(reduce.deduplicate(diagnostics(spark, sf_dir))).select("inv", "rank", "ordinal", "message")


def root_causes(spark, sf_dir):
    """F03, H01, H02 and G04a: the flagship. 200 bytes, so that the budget is felt."""
    out = reduce.root_causes(diagnostics(spark, sf_dir), items=20, most=200)
    return out.select("inv", "rank", "severity", "category", "message", "path", "line", "col_no", "target", "action", "repetition_count", "truncated")


_BUDGET = """
, s AS (SELECT *, CAST(strlen(message) AS BIGINT) AS size FROM r WHERE rank < 20),
w AS (SELECT inv, rank, CASE WHEN size <= 200 THEN size ELSE 0 END AS used, size <= 200 AS kept FROM s WHERE rank = 0
  UNION ALL SELECT s.inv, s.rank, CASE WHEN w.used + s.size <= 200 THEN w.used + s.size ELSE w.used END, w.used + s.size <= 200
  FROM w JOIN s ON s.inv = w.inv AND s.rank = w.rank + 1),
n AS (SELECT inv, count(*) AS n FROM r GROUP BY inv), m AS (SELECT inv, count(*) AS m FROM w WHERE kept GROUP BY inv)
SELECT s.inv, s.rank, severity, category, message, path, line, col_no, target, action, repetition_count, n > m AS truncated
FROM s JOIN w ON s.inv = w.inv AND s.rank = w.rank JOIN n ON n.inv = s.inv JOIN m ON m.inv = s.inv WHERE kept
"""


def g04b_stop_budget(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.ceil("o_totalprice").cast("bigint").alias("bytes"))
    return reduce.up_to_bytes(o, F.col("bytes"), 400_000, "o_custkey", ["o_orderkey"])


def g05_keep_first(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return reduce.keep_first(e, ["user_id", "event_type"], ["event_id"])


def _lines(spark, sf_dir):
    return _split(table(spark, sf_dir, "documents"))


def _split(docs):
    d = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    return d.select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.regexp_replace("line", "\r$", "").alias("line"))


_LINES = "l AS (SELECT doc_id, CAST(unnest(generate_series(0, len(s) - 1)) AS BIGINT) AS ordinal, regexp_replace(unnest(s), '\\r$', '') AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"


def a12_lines(spark, sf_dir):
    return _lines(spark, sf_dir)


def f04_line_counts(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("line").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "ordinal")).alias("first")).select("line", "n", F.col("first.doc_id").alias("first_doc"), F.col("first.ordinal").alias("first_ordinal"))


def d01_filter(spark, sf_dir):
    # A text without the words has no line with them: texts go before they are split.
    some = table(spark, sf_dir, "documents").where(T.contains_ignore_case(F.col("text"), "THE OF"))
    return _split(some).where(T.contains_ignore_case(F.col("line"), "THE OF")).select("doc_id", "ordinal")


def g03_context(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("inv"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("label"), "value")
    return reduce.context_matches(e, F.col("value") > 90).select("inv", "ordinal", "label")


def j06_redaction(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.redact(F.col("text"), [r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++@[A-Za-z0-9.-]+", r"[0-9a-f]{32,}", r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"])).alias("redacted_md5"))


def j02_bounded(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(T.bounded(F.col("text"), 100)).cast("bigint").alias("bytes"), (F.octet_length("text") > 100).alias("cut"))


def h04_ledger_page(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ms"), "o_orderstatus")
    return pages.newest_first(o, "ms", "o_orderkey", 50, (883612800000, 0), F.col("o_orderstatus") == "F", 1000)


def h05_ordinal_page(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), "event_type", "value")
    return pages.by_ordinal(e, 20, 99, F.col("event_type") == "error", 400)


def g06_retention(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("finished"), F.ceil("o_totalprice").cast("bigint").alias("bytes"),
        (F.col("o_orderstatus") == "O").alias("live"), (F.col("o_orderkey") % 7 == 0).alias("protected"))
    return retention.plan(o, 757382400000, 1_000_000_000)


_RETENTION = """
WITH o AS (SELECT o_orderkey AS id, epoch_ms(o_orderdate) AS finished, CAST(ceil(o_totalprice) AS BIGINT) AS bytes, o_orderstatus = 'O' AS live, o_orderkey % 7 = 0 AS protected FROM orders),
x AS (SELECT *, NOT live AND finished <= 757382400000 AS old FROM o),
t AS (SELECT sum(bytes) AS total FROM x WHERE NOT old),
w AS (SELECT id, protected, coalesce(sum(bytes) OVER (ORDER BY finished, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x WHERE NOT old AND NOT live),
g AS (SELECT id, protected, true AS go FROM x WHERE old
  UNION ALL SELECT id, protected, total > 1000000000 AND total - before > 800000000 FROM w, t
  UNION ALL SELECT id, protected, false FROM x WHERE NOT old AND live)
SELECT id, CASE WHEN NOT go THEN 'keep' WHEN protected THEN 'prune' ELSE 'delete' END AS action FROM g
"""


def e01_closure(spark, sf_dir):
    """What part 1 reaches over two edges of every part, by keys mod the number of parts."""
    p = table(spark, sf_dir, "part")
    n = p.count()
    edges = p.select(F.lit(0).alias("inv"), F.col("p_partkey").alias("parent"), F.explode(F.array((F.col("p_partkey") * 7 + 1) % n, (F.col("p_partkey") * 3) % n)).alias("child"))
    return graph.closure(spark.createDataFrame([(0, 1)], "inv int, node bigint"), edges).select("node").distinct()


_CLOSURE = """
WITH RECURSIVE n AS (SELECT count(*) AS n FROM part), e AS (SELECT p_partkey AS parent, unnest([(p_partkey * 7 + 1) % n, (p_partkey * 3) % n]) AS child FROM part, n),
r AS (SELECT CAST(1 AS BIGINT) AS node UNION SELECT child FROM e JOIN r ON e.parent = r.node)
SELECT node FROM r
"""


def _sides(spark, sf_dir):
    """All orders of two priorities, numbered within their status: n-th goes with n-th."""
    x = table(spark, sf_dir, "orders").where("o_orderpriority in ('1-URGENT', '5-LOW')")
    x = x.withColumn("sample", F.row_number().over(Window.partitionBy("o_orderstatus", "o_orderpriority").orderBy("o_orderkey")).cast("bigint"))
    pick = lambda p: x.where(F.col("o_orderpriority") == p).select("o_orderstatus", "sample", F.ceil("o_totalprice").cast("bigint").alias("bytes"))
    return pick("1-URGENT"), pick("5-LOW")


def _pairs(spark, sf_dir):
    """The samples that both sides have. e05 tells of the rest, which is no error here."""
    return stats.paired_or_alone(*_sides(spark, sf_dir), ["o_orderstatus", "sample"], "bytes")


_SIDES = """
s AS (SELECT o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS sample, CAST(ceil(o_totalprice) AS BIGINT) AS bytes FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')),
x AS (SELECT coalesce(a.o_orderstatus, b.o_orderstatus) AS o_orderstatus, coalesce(a.sample, b.sample) AS sample, a.bytes AS base, b.bytes AS new FROM (SELECT * FROM s WHERE o_orderpriority = '1-URGENT') a FULL JOIN (SELECT * FROM s WHERE o_orderpriority = '5-LOW') b ON a.o_orderstatus = b.o_orderstatus AND a.sample = b.sample),
p AS (SELECT * FROM x WHERE base IS NOT NULL AND new IS NOT NULL)
"""


def e05_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


def f10_comparison(spark, sf_dir):
    return stats.compare(_pairs(spark, sf_dir).where("base is not null and new is not null"), "o_orderstatus")


def f11_bootstrap(spark, sf_dir):
    """Over all orders, n-th with n-th; the rest of the longer side has no pair and is counted."""
    both = _pairs(spark, sf_dir)
    found = stats.bootstrap_by(both.where("base is not null and new is not null"), "o_orderstatus", ["sample"])
    count = both.groupBy("o_orderstatus").agg(F.count_if(F.expr("base is not null and new is not null")).alias("pairs"), F.count_if(F.expr("base is null or new is null")).alias("unpaired"))
    return count.join(found, "o_orderstatus", "left").select("o_orderstatus", "pairs", "unpaired", "value", "low", "high")


def f06_percentiles(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.ceil("o_totalprice").cast("bigint").alias("ms"))
    return stats.nearest_rank(o, ["o_orderpriority"], "ms")


def f05_coverage(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    out = li.groupingSets([[], [F.col("l_partkey")]], F.col("l_partkey")).agg(F.count("*").alias("found"), F.count_if(F.col("l_quantity") > 25).alias("hit"))
    return out.withColumn("percent", F.round(T.ratio_percent(F.col("hit").cast("double"), F.col("found").cast("double")), 6))


def e03_anti(spark, sf_dir):
    d, b = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return b.join(d, "doc_id", "left_anti").select("doc_id")


def h14_head_and_tail(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    head = Window.partitionBy("user_id").orderBy("event_id")
    tail = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    first = e.where("event_type = 'error'").withColumn("n", F.row_number().over(head)).where("n <= 2")
    last = e.where("event_type <> 'error'").withColumn("n", F.row_number().over(tail)).where("n <= 3")
    return first.unionByName(last).select("user_id", "event_id", "event_type")


def d06_wildcard(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.where(T.wildcard(F.col("p_type"), "*E*N*") | T.wildcard(F.col("p_name"), "p...")).select("p_partkey")


def _compiler_lines(spark, sf_dir):
    """Events as lines of compilers' output, one shape for each event_id mod 8."""
    k, i = F.col("event_id") % 8, F.col("event_id")
    n = lambda c: c.cast("string")
    said = F.concat(F.lit("no "), F.col("event_type"))
    shapes = [F.concat(F.lit("src/a"), n(i % 7), F.lit(".cc:"), n(i % 90), F.lit(":"), n(i % 11), F.lit(": error: "), said),
              F.concat(F.lit("src/b"), n(i % 7), F.lit(".cpp("), n(i % 90), F.lit("): warning C4"), n(i % 9), F.lit(": "), said),
              F.concat(F.lit("ui/c.ts("), n(i % 90), F.lit(","), n(i % 11), F.lit("): error TS2"), n(i % 9), F.lit(": "), said),
              F.concat(F.lit("D.java:"), n(i % 90), F.lit(": warning: "), said), F.concat(F.lit("e.go:"), n(i % 90), F.lit(":"), n(i % 11), F.lit(": "), said),
              F.concat(F.lit("f.proto:"), n(i % 90), F.lit(":1: "), said), F.concat(F.lit("error[E"), n(i % 9), F.lit("]: "), said), F.concat(F.lit("all is well with "), said)]
    line = shapes[-1]
    for j, shape in enumerate(shapes[:-1]):
        line = F.when(k == j, shape).otherwise(line)
    return table(spark, sf_dir, "events").select("event_id", line.alias("line"))


def k20_compilers(spark, sf_dir):
    """K20, K22 (head), K23, K24 (head), K25 and K28 over lines of all shapes."""
    return parsers.parsed(_compiler_lines(spark, sf_dir)).drop("line")


_PARSED = """SELECT event_id, CASE s WHEN 0 THEN 'clang' WHEN 1 THEN 'msvc' WHEN 2 THEN 'typescript' WHEN 3 THEN 'java' WHEN 4 THEN 'go' WHEN 5 THEN 'protobuf' ELSE 'rust' END AS parser,
  CASE s WHEN 0 THEN concat('src/a', event_id % 7, '.cc') WHEN 1 THEN concat('src/b', event_id % 7, '.cpp') WHEN 2 THEN 'ui/c.ts' WHEN 3 THEN 'D.java' WHEN 4 THEN 'e.go' WHEN 5 THEN 'f.proto' END AS path,
  CASE WHEN s < 6 THEN event_id % 90 END AS line_no, CASE WHEN s IN (0, 2, 4) THEN event_id % 11 WHEN s = 5 THEN 1 END AS col_no, CASE WHEN s IN (1, 3) THEN 'warning' ELSE 'error' END AS severity,
  concat(CASE s WHEN 1 THEN concat('C4', event_id % 9, ': ') WHEN 2 THEN concat('TS2', event_id % 9, ': ') ELSE '' END, 'no ', event_type) AS message FROM (SELECT *, event_id % 8 AS s FROM events) WHERE s < 7"""


def k07_fallback(spark, sf_dir):
    x = F.col("line")
    d = diagnostics(spark, sf_dir).select(F.col("ordinal").alias("event_id"), F.concat(F.col("message"), F.lit(" "), F.element_at(F.array(*map(F.lit, HINTS)), (F.col("ordinal") % len(HINTS) + 1).cast("int"))).alias("line"))
    return d.select("event_id", parsers.fallback_category(x).alias("category"), parsers.fallback_severity(x).alias("severity")).where("category is not null")


HINTS = ["", "no such package", "visibility ERROR", "analysis failed", "missing strict dependencies", "warning: no such target", "error[E1]"]


def k09_regex(spark, sf_dir):
    return parsers.regex_diagnostics(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "[0-9]+", 3)


def d01_prefix(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(T.starts_with_ignore_case(F.col("o_orderpriority"), "1-URG")).select("o_orderkey")


def _of_events(f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, "events"))


#: The queries whose SQL is below, as operators.
OPERATORS = {
    "c01_aborted": _of_events(lambda e: e.where("event_type = 'error'").select(F.col("event_id").alias("ordinal"), F.lit("error").alias("severity"), E.aborted_category(F.col("event_id") % 9).alias("category"))),
    "c02_failed_action": _of_events(lambda e: e.where("value < 20").select(F.col("event_id").alias("ordinal"), E.action_message(F.col("event_type"), F.col("user_id") % 40).alias("message"), F.nullif("event_type", F.lit("view")).alias("action"))),
    "c04_test_result": _of_events(lambda e: e.select("event_id", outcomes.test_result(F.lit("//a"), F.when(F.col("event_type") == "view", "passed").otherwise("failed"), F.when(F.col("value") < 10, -1).otherwise(F.col("event_id") % 1000), F.col("user_id") % 3, F.col("event_id") % 4).alias("t")).select("event_id", "t.attempts", "t.shard", "t.duration_ms", "t.reason")),
    "c13_vertical_split": lambda spark, sf_dir: table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"),
    "d03_ledger_filters": lambda spark, sf_dir: table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey"),
    "i01_distinct_first": lambda spark, sf_dir: reduce.keep_first(table(spark, sf_dir, "pages").select("url", "page_id"), ["url"], ["page_id"]),
    "e06_hydrate": lambda spark, sf_dir: E.hydrated(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name", F.col("c_mktsegment").alias("segment")), "key", {"segment": F.lit("")}).drop("key"),
    "e08_merge_max": lambda spark, sf_dir: E.merged_max(*[table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == s).select(F.col("l_orderkey").alias("id"), F.col("l_quantity").cast("bigint").alias("merged")) for s in "OF"], "id", ["merged"]),
    "d11_age": lambda spark, sf_dir: table(spark, sf_dir, "orders").where(F.col("o_orderdate") <= F.lit("1995-01-01").cast("timestamp")).select("o_orderkey"),
    "f21_gates": lambda spark, sf_dir: E.gates(table(spark, sf_dir, "orders"), "o_orderpriority", [F.col("o_totalprice") > 0, F.col("o_totalprice") < 1_000_000]),
    "i02_ordered_union": lambda spark, sf_dir: E.in_turn([table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")), table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"))]),
    "f07_summary": lambda spark, sf_dir: E.solve_summary(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id"), "lang", F.col("quality"), F.col("n_chars")).withColumnRenamed("per_solve", "chars_per_solve"),
    "c06_test_status": _of_events(lambda e: e.select("event_id", E.test_status(F.col("event_id") % 9).alias("status"))),
    "c09_first_options": _of_events(lambda e: reduce.keep_first(e.where("event_type = 'signup'"), ["user_id"], ["event_id"]).select("user_id", F.col("event_id").alias("first_id"))),
    "c10_last_finished": _of_events(lambda e: E.last_of(e.where("event_type = 'purchase'"), "user_id", "event_id").select("user_id", "event_id", "event_type")),
    "c17_run_outcome": lambda spark, sf_dir: table(spark, sf_dir, "orders").select("o_orderkey", E.run_outcome(F.when(F.col("o_orderstatus") == "P", "cancelled").when(F.col("o_orderstatus") == "F", "succeeded"), F.col("o_totalprice") > 300000, F.col("o_orderkey") % 11 == 0).alias("outcome")),
    "d19_transitions": _of_events(lambda e: E.legal_steps(e, "user_id", "event_id", "event_type", {"view": ("click", "error", "signup"), "click": ("purchase", "view")}, "view").select("user_id", "event_id", "legal")),
    "e11_weights": lambda spark, sf_dir: E.weighted_units(table(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_orderkey") % 100, F.col("o_custkey") % 100, [0, 25, 100]),
    "f01_target_counts": _of_events(lambda e: E.target_counts(e, "user_id", "event_type", "event_id", F.col("value") > 50)),
    "f02_test_counts": _of_events(lambda e: reduce.test_counts(e.select(F.col("user_id").alias("inv"), F.when(F.col("event_type") == "view", "passed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "flaky").otherwise("incomplete").alias("status"))).select(F.col("inv").alias("user_id"), "passed", "failed", "flaky", "incomplete")),
    "f23_waits": _of_events(lambda e: E.waited(e, "user_id", "event_id", F.col("event_type") == "signup")),
    "g01_ordinals": _of_events(lambda e: E.ordinals(e, "user_id", "event_id").select("event_id", "ordinal")),
    "g02_context_tokens": lambda spark, sf_dir: E.charged(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text")).select("conv_id", "turn", "charged"),
    "g07_contiguity": lambda spark, sf_dir: E.contiguous(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "contiguous"),
    "g09_attempts": _of_events(lambda e: E.attempts(e, "user_id", "event_id", F.col("event_type") == "purchase").select("user_id", "event_id", "attempt")),
    "g10_forward_fill": _of_events(lambda e: E.filled(e, "user_id", "event_id", F.when(F.col("event_type") == "signup", F.col("event_id")), "current_file").select("user_id", "event_id", "current_file")),
    "h13_samples": _of_events(lambda e: E.sample_of(e, "user_id", "event_id", 3).select("user_id", "event_id")),
    "i04_missing": lambda spark, sf_dir: E.missing(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key")), "key"),
    "i05_repeated_names": _of_events(lambda e: E.repeated(e.select(F.concat("event_type", F.lit(" "), (F.col("user_id") % 50).cast("string")).alias("name")), "name")),
    "j24_ttl": lambda spark, sf_dir: table(spark, sf_dir, "orders").select("o_orderkey", E.extended_expiry(F.col("o_orderkey"), F.col("o_orderkey") + 10000, F.col("o_orderkey") + F.col("o_custkey")).alias("expires")),
    "d09_evidence_priority": lambda spark, sf_dir: _lines(spark, sf_dir).select("doc_id", "ordinal", E.evidence_priority(F.col("line")).alias("priority")),
}


#: SQL of the queries above, in which STRING stands for the engine's type of texts.
SHARED = {
    "c01_aborted": "SELECT event_id AS ordinal, 'error' AS severity, CASE WHEN event_id % 9 = 5 THEN 'loading' WHEN event_id % 9 = 6 THEN 'analysis' ELSE 'bazel' END AS category FROM events WHERE event_type = 'error'",
    "c02_failed_action": "SELECT event_id AS ordinal, concat(coalesce(nullif(event_type, ''), 'Bazel'), ' action failed with exit code ', CAST(user_id % 40 AS STRING)) AS message, nullif(event_type, 'view') AS action FROM events WHERE value < 20",
    "c04_test_result": "SELECT event_id, greatest(user_id % 3, 1) AS attempts, nullif(event_id % 4, 0) AS shard, CASE WHEN value < 10 THEN NULL ELSE event_id % 1000 END AS duration_ms, CASE WHEN event_type <> 'view' THEN 'test_log_not_snapshotted' END AS reason FROM events",
    "c06_test_status": "SELECT event_id, CASE event_id % 9 WHEN 1 THEN 'passed' WHEN 2 THEN 'flaky' WHEN 3 THEN 'timed_out' WHEN 4 THEN 'failed' WHEN 7 THEN 'failed' WHEN 8 THEN 'failed' WHEN 6 THEN 'remote_failure' ELSE 'incomplete' END AS status FROM events",
    "c09_first_options": "SELECT user_id, min(event_id) AS first_id FROM events WHERE event_type = 'signup' GROUP BY user_id",
    "c10_last_finished": "SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type = 'purchase') t WHERE n = 1",
    "c13_vertical_split": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
    "c17_run_outcome": "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'output_limit' WHEN o_orderstatus = 'P' THEN 'cancelled' WHEN o_orderkey % 11 = 0 THEN 'timed_out' WHEN o_orderstatus = 'F' THEN 'succeeded' ELSE 'program_failed' END AS outcome FROM orders",
    "d03_ledger_filters": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
    "d11_age": "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1995-01-01 00:00:00'",
    "d19_transitions": "SELECT user_id, event_id, CASE WHEN was IS NULL THEN event_type = 'view' WHEN was = 'view' THEN event_type IN ('click', 'error', 'signup') WHEN was = 'click' THEN event_type IN ('purchase', 'view') ELSE false END AS legal FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) t",
    "e06_hydrate": "SELECT o.o_orderkey, c.c_name, coalesce(c.c_mktsegment, '') AS segment FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey",
    "e08_merge_max": "SELECT a.l_orderkey AS id, greatest(a.q, b.q) AS merged FROM (SELECT l_orderkey, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey) a JOIN (SELECT l_orderkey, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey) b ON a.l_orderkey = b.l_orderkey",
    "e11_weights": "SELECT p.o_orderpriority, w.w, CAST(sum(100 * (p.o_orderkey % 100) + w.w * (p.o_custkey % 100)) AS BIGINT) AS units FROM orders p CROSS JOIN (SELECT 0 AS w UNION ALL SELECT 25 UNION ALL SELECT 100) w GROUP BY p.o_orderpriority, w.w",
    "f01_target_counts": "SELECT user_id, count(*) AS requested, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS succeeded, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS failed FROM (SELECT user_id, event_type, value > 50 AS ok, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) t WHERE n = 1 GROUP BY user_id",
    "f02_test_counts": "SELECT user_id, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS passed, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS flaky, CAST(sum(CASE WHEN event_type IN ('signup', 'purchase') THEN 1 ELSE 0 END) AS BIGINT) AS incomplete FROM events GROUP BY user_id",
    "f07_summary": "SELECT d.lang, count(*) AS attempts, CAST(sum(l.quality) AS BIGINT) AS solves, round(CAST(100 * sum(l.quality) AS DOUBLE) / count(*), 6) AS solve_percent, round(CAST(sum(d.n_chars) AS DOUBLE) / nullif(sum(l.quality), 0), 6) AS chars_per_solve FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang",
    "f21_gates": "SELECT o_orderpriority, min(o_totalprice) > 0 AND max(o_totalprice) < 1000000 AS pass FROM orders GROUP BY o_orderpriority",
    "f23_waits": "SELECT user_id, CAST(sum(CASE WHEN event_type = 'signup' THEN nxt - event_id ELSE 0 END) AS BIGINT) AS waited FROM (SELECT user_id, event_id, event_type, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events) t GROUP BY user_id",
    "g01_ordinals": "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ordinal FROM events",
    "g02_context_tokens": "SELECT conv_id, turn, coalesce(CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS charged FROM conversations",
    "g07_contiguity": "SELECT l_orderkey, l_linenumber, l_linenumber = coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 0) + 1 AS contiguous FROM lineitem",
    "g09_attempts": "SELECT user_id, event_id, coalesce(CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS attempt FROM events",
    "g10_forward_fill": "SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current_file FROM events",
    "h13_samples": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) t WHERE n <= 3",
    "i01_distinct_first": "SELECT url, min(page_id) AS page_id FROM pages GROUP BY url",
    "i02_ordered_union": "SELECT 0 AS source_rank, n_nationkey AS id FROM nation UNION ALL SELECT 1, r_regionkey FROM region",
    "i04_missing": "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "i05_repeated_names": "SELECT concat(event_type, ' ', CAST(user_id % 50 AS STRING)) AS name FROM events GROUP BY ALL HAVING count(*) > 1",
    "j24_ttl": "SELECT o_orderkey, greatest(o_orderkey + 10000, o_orderkey + o_custkey + greatest(10000, 1)) AS expires FROM orders",
}

_OWN = {
    "root_causes": (root_causes, "WITH RECURSIVE " + _DIAG + _BUDGET),
    "f03_deduplicate": (f03_deduplicate, "WITH " + _DIAG + "SELECT * FROM f"),
    "h01_rank": (h01_rank, "WITH " + _DIAG + "SELECT inv, rank, ordinal, message FROM r"),
    "g04b_stop_budget": (g04b_stop_budget, "SELECT o_custkey, o_orderkey, bytes FROM (SELECT o_custkey, o_orderkey, CAST(ceil(o_totalprice) AS BIGINT) AS bytes, sum(CAST(ceil(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS u FROM orders) WHERE u <= 400000"),
    "g05_keep_first": (g05_keep_first, "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1"),
    "a12_lines": (a12_lines, "WITH " + _LINES + " SELECT * FROM l"),
    "f04_line_counts": (f04_line_counts, "WITH " + _LINES + " SELECT line, count(*) AS n, arg_min(doc_id, (doc_id, ordinal)) AS first_doc, arg_min(ordinal, (doc_id, ordinal)) AS first_ordinal FROM l GROUP BY line"),
    "d01_filter": (d01_filter, "WITH " + _LINES + f" SELECT doc_id, ordinal FROM l WHERE contains(translate(line, {UP}), 'the of')"),
    "g03_context": (g03_context, "WITH x AS (SELECT user_id AS inv, event_id AS ordinal, event_type AS label, value > 90 AS hit, lag(value > 90) OVER w AS ph, lead(value > 90) OVER w AS nh, lag(event_type) OVER w AS pl, lead(event_type) OVER w AS nl FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT inv, ordinal, label FROM x WHERE hit OR (ph AND pl = label) OR (nh AND nl = label)"),
    "j06_redaction": (j06_redaction, "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+', '[REDACTED]', 'g'), '[0-9a-f]{32,}', '[REDACTED]', 'g'), '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}', '[REDACTED]', 'g')) AS redacted_md5 FROM documents"),
    "j02_bounded": (j02_bounded, """SELECT doc_id, CAST(CASE WHEN strlen(text) <= 100 THEN strlen(text) ELSE list_max(list_filter(list_transform(range(0, 101), lambda k: strlen(left(text, k))), lambda b: b <= 100)) + 3 END AS BIGINT) AS bytes,
  strlen(text) > 100 AS cut FROM documents"""),
    "h04_ledger_page": (h04_ledger_page, "SELECT * FROM (SELECT o_orderkey, epoch_ms(o_orderdate) AS ms, o_orderstatus FROM orders WHERE (epoch_ms(o_orderdate), o_orderkey) < (883612800000, 0) ORDER BY ms DESC, o_orderkey DESC LIMIT 1000) WHERE o_orderstatus = 'F' ORDER BY ms DESC, o_orderkey DESC LIMIT 50"),
    "h05_ordinal_page": (h05_ordinal_page, "SELECT * FROM (SELECT event_id AS ordinal, event_type, value FROM events WHERE event_id > 99 ORDER BY event_id LIMIT 400) WHERE event_type = 'error' ORDER BY ordinal LIMIT 20"),
    "g06_retention": (g06_retention, _RETENTION),
    "e01_closure": (e01_closure, _CLOSURE),
    "e05_pairs": (e05_pairs, "WITH " + _SIDES + "SELECT * FROM x"),
    "f10_comparison": (f10_comparison, "WITH " + _SIDES + "SELECT o_orderstatus, count(*) AS pairs, CAST(sum(base) AS BIGINT) AS base, CAST(sum(new) AS BIGINT) AS new, round(100.0 * (CAST(sum(base) AS DOUBLE) - sum(new)) / sum(base), 6) AS reduction FROM p GROUP BY GROUPING SETS ((), (o_orderstatus))"),
    "f11_bootstrap": (f11_bootstrap, None),
    "f06_percentiles": (f06_percentiles, "SELECT o_orderpriority, count(*) AS n, quantile_disc(CAST(ceil(o_totalprice) AS BIGINT), 0.5) AS median, quantile_disc(CAST(ceil(o_totalprice) AS BIGINT), 0.95) AS p95 FROM orders GROUP BY o_orderpriority"),
    "f05_coverage": (f05_coverage, "SELECT l_partkey, count(*) AS found, count(*) FILTER (l_quantity > 25) AS hit, round(100.0 * count(*) FILTER (l_quantity > 25) / CAST(count(*) AS DOUBLE), 6) AS percent FROM lineitem GROUP BY GROUPING SETS ((), (l_partkey))"),
    "e03_anti": (e03_anti, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "h14_head_and_tail": (h14_head_and_tail, "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'error') WHERE n <= 2 UNION ALL SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type <> 'error') WHERE n <= 3"),
    "d09_evidence_priority": (OPERATORS["d09_evidence_priority"], "WITH " + _LINES + f""", x AS (SELECT doc_id, ordinal, translate(trim(line, ' '), {UP}) AS x FROM l)
SELECT doc_id, ordinal, CASE WHEN x IN ('failure:', 'failures:') OR (starts_with(x, 'test ') AND ends_with(x, '... ok')) THEN NULL
  WHEN contains(x, 'root_cause') OR contains(x, 'panicked at') OR (contains(x, 'assertion') AND contains(x, ' failed')) THEN 0
  WHEN contains(x, 'error:') OR contains(x, 'fatal:') OR contains(x, 'no such target') OR contains(x, 'no such package') OR contains(x, 'undefined reference') OR contains(x, 'missing strict dependencies') OR starts_with(x, 'error ')
    OR (contains(x, '.go: import of "') AND ends_with(x, '"')) THEN 1
  WHEN contains(x, 'failed:') OR contains(x, 'failure') OR starts_with(x, 'test result: failed') OR (starts_with(x, 'test ') AND ends_with(x, '... failed')) THEN 2 END AS priority FROM x"""),
    "k20_compilers": (k20_compilers, _PARSED),
    "k07_fallback": (k07_fallback, "WITH " + _DIAG.split("g AS (")[0].rstrip().rstrip(",") + f""", x AS (SELECT ordinal AS event_id, lower(message || ' ' || ([{', '.join(repr(h) for h in HINTS)}])[ordinal % {len(HINTS)} + 1]) AS x FROM d),
y AS (SELECT event_id, CASE WHEN contains(x, 'root_cause') AND NOT contains(x, 'error:') AND NOT contains(x, 'error[') THEN 'test' WHEN contains(x, 'no such package') OR contains(x, 'no such target') THEN 'loading'
  WHEN contains(x, 'visibility') AND contains(x, 'error') THEN 'visibility' WHEN contains(x, 'analysis') AND (contains(x, 'error') OR contains(x, 'fail')) THEN 'analysis' WHEN contains(x, 'missing strict dependencies') THEN 'compilation' END AS category,
  CASE WHEN contains(x, 'warning:') THEN 'warning' ELSE 'error' END AS severity FROM x) SELECT * FROM y WHERE category IS NOT NULL"""),
    "k09_regex": (k09_regex, "SELECT doc_id, CAST(unnest(generate_series(0, len(m) - 1)) AS INTEGER) AS n, unnest(m) AS match FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+')[1:3] AS m FROM documents) WHERE len(m) > 0"),
    "d01_prefix": (d01_prefix, "SELECT o_orderkey FROM orders WHERE starts_with(lower(o_orderpriority), '1-urg')"),
    "d06_wildcard": (d06_wildcard, "SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^.*E.*N.*$') OR starts_with(p_name, 'p')"),
}


def queries() -> dict:
    return {k: OPERATORS[k] for k in SHARED} | {k: f for k, (f, _) in (_OWN | catalog_builds.QUERIES | catalog_logs.QUERIES | catalog_runs.QUERIES | catalog_cases.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    return {k: v.replace(" AS STRING)", " AS VARCHAR)").replace(") IGNORE NULLS", " IGNORE NULLS)") for k, v in SHARED.items()} | {k: s for k, (_, s) in (_OWN | catalog_builds.QUERIES | catalog_logs.QUERIES | catalog_runs.QUERIES | catalog_cases.QUERIES).items() if s}
