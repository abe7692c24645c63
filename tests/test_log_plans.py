"""Plans of logs: what is read of lines is read once, and nothing is missed by what is looked for before."""

from pyspark.sql import functions as F

from ledgerflow.catalog_logs import LOGS
from ledgerflow.operators import blocks, build_lines, logs, parsers

TOLD = [x.replace("{w}", w).replace("{n}", "12") for b in LOGS for x in b for w in ("Rate", "visibility")] + ["NO SUCH TARGET x", "A ROOT_CAUSE", "ERROR: Analysis of x", "visibility error", "⚠ a.ts:3 · x — y", "ERROR: Traceback (most recent call last):", "Error: x"]


def _lines(spark):
    many = F.array(*map(F.lit, TOLD))
    return spark.range(2).select(F.col("id").alias("log"), F.posexplode(many).alias("ordinal", "line"))


def test_tool_lines_are_read_once(spark):
    found = logs.tool_diagnostics(_lines(spark), "log")
    assert len(found.collect()) > 20
    assert found._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 2


def test_forms_share_their_groups(spark):
    found = blocks.test_failures(_lines(spark), "log")
    assert found.count() > 5
    found.collect()
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_no_parser_knows_a_line_without_its_marks(spark):
    c = F.col("line")
    known = F.lit(False)
    for f in (build_lines.is_header, build_lines.inline, build_lines.traceback_location, build_lines.error_message, build_lines.lint, build_lines.strict_dependency, build_lines.wrapper, lambda x: build_lines.source_context(x, "loading"), parsers.fallback_category):
        known = known | (f(c) if f is build_lines.is_header else f(c).isNotNull())
    x = _lines(spark).select("line", known.alias("known"), build_lines.may_say(c).alias("may"))
    assert x.where("known").count() > 20
    assert x.where("known and not may").collect() == []


def test_lines_are_made_and_shuffled_once(spark):
    found = logs.text_diagnostics(_lines(spark), "log")
    assert len(found.collect()) > 20
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Range (0, 2") == 1  # three times before: for the tool, single lines and blocks


def test_no_form_knows_a_line_without_its_mark(spark):
    c = F.col("line")
    missed = F.lit(False)
    for form in blocks.FORMS.values():
        for x in form.lines:
            missed = missed | (c.rlike(x.pattern) & ~x.fits(c))
    for k, (pattern, _, _) in logs.SINGLE.items():
        missed = missed | (c.rlike(pattern) & parsers.first_of(c, {k: (pattern, (), "")}).isNull())
    status = F.lower(F.trim(c)).startswith("debug:") | F.lower(F.trim(c)).startswith("info:") | (F.lower(F.trim(c)) == build_lines.FAILED)
    x = _lines(spark).select("line", missed.alias("missed"), (status != build_lines.is_status(c)).alias("other"))
    assert x.where("missed or other").collect() == []
