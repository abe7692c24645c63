"""Test cases out of result files in XML: suites of cases, or a wrapper of such suites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import seconds_to_ms

_SAID = "array<struct<_message string, _VALUE string>>"
_CASES = f"array<struct<_name string, _time string, failure {_SAID}, error {_SAID}, skipped {_SAID}>>"
#: The most milliseconds that are told.
MOST_MS = (1 << 63) - 1


def _schema(depth: int) -> str:
    """Cases of a suite and of the suites in it, `depth` levels down."""
    inner = f", testsuite array<struct<{_schema(depth - 1)}>>" if depth else ""
    return f"testcase {_CASES}{inner}"


def _cases(suite: Column, depth: int) -> Column:
    """A suite's own cases, then those of its suites in their order."""
    none = F.array().cast(_CASES)
    own = F.coalesce(suite["testcase"], none)
    if not depth:
        return own
    deeper = F.flatten(F.transform(F.coalesce(suite["testsuite"], F.array().cast(f"array<struct<{_schema(depth - 1)}>>")), lambda s: _cases(s, depth - 1)))
    return F.concat(own, deeper)


def test_cases(texts: DataFrame, text: str, depth: int = 1) -> DataFrame:
    """The other columns of texts with position, name, status, duration_ms and message of each
    case, and error (position null) for a text that isn't well-formed. A failure goes before an
    error, and both before a skip; what an element says is its attribute, else its content.
    Suites deeper than `depth` below the root are not read. A null text is malformed, one
    without cases has no rows; a name that is missing is empty."""
    others = [c for c in texts.columns if c != text]
    parsed = F.from_xml(F.coalesce(F.col(text), F.lit("")), f"{_schema(depth)}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    x = texts.withColumn("_doc", parsed)
    bad = F.col("_doc").isNull() | F.col("_doc._bad").isNotNull()
    x = x.select(*others, bad.alias("_bad"), F.when(~bad, _cases(F.col("_doc"), depth)).alias("_cases"))
    told = F.posexplode(F.when(F.col("_bad"), F.array(F.lit(None).cast(_CASES[6:-1]))).otherwise(F.col("_cases"))).alias("_at", "_case")
    x = x.select(*others, "_bad", told)
    said = lambda c: F.get(F.col(f"_case.{c}"), 0)
    there = lambda c: F.coalesce(F.size(f"_case.{c}"), F.lit(0)) > 0
    text_of = lambda c: F.coalesce(said(c)["_message"], said(c)["_VALUE"])
    failed = there("failure") | there("error")
    seconds = F.col("_case._time").try_cast("double")
    ms = F.when(seconds * 1000 >= float(MOST_MS), F.lit(MOST_MS)).otherwise(seconds_to_ms(F.when(seconds * 1000 < float(MOST_MS), seconds)))
    return x.select(
        *others, F.when(~F.col("_bad"), F.col("_at").cast("bigint")).alias("position"), F.when(~F.col("_bad"), F.coalesce("_case._name", F.lit(""))).alias("name"),
        F.when(F.col("_bad"), None).when(failed, "failed").when(there("skipped"), "skipped").otherwise("passed").alias("status"), ms.alias("duration_ms"),
        F.when(there("failure"), text_of("failure")).when(there("error"), text_of("error")).when(there("skipped"), text_of("skipped")).alias("message"),
        F.when(F.col("_bad"), "the text is not well-formed").alias("error"))
