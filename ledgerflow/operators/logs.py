"""From the lines of a log to its ranked diagnostics: the build tool's own lines, then what
compilers, tools and tests wrote in between.

Lines are rows (by, ordinal, line). The build tool's part takes two passes: a first one over
the log tells whether rule files speak in it, which decides what a line that names a cause is
taken for; equal lines are then one, with their count, and the first parser that fits wins.
Lines that the tool owns are withheld from all other parsers. Nothing but aggregates and the
windows of blocks and tracebacks is shuffled, and of those only lines that tell something."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, compact_path, once, strip_terminal
from . import blocks, build_lines, parsers, reduce

#: Parsers of single lines whose forms have no further lines, then any line that says it is an
#: error, a failed test or a warning; a group 1 around the line is its message.
ANY_LINE = {
    "test_line": (r"^\s*(test \S.* \.\.\. FAILED|thread '.* panicked at .*|.*assertion .* failed.*?)\s*$", (0, 0, 0, 0, 1), "error"),
    "error_line": (r"(?i)^\s*((?:.*\W)?(?:fatal|error(?:\[\w+\])?):.*?)\s*$", (0, 0, 0, 0, 1), "error"),
    "warning_line": (r"(?i)^\s*((?:.*\W)?warning:.*?)\s*$", (0, 0, 0, 0, 1), "warning"),
}
SINGLE = {k: parsers.PARSERS[k] for k in ("typescript", "typescript_pretty", "msvc", "clang", "protobuf", "go")} | ANY_LINE
#: Forms whose opening line isn't a diagnostic of its own beside the block's.
OPENED = ("rust", "java", "java_test", "reference", "external", "gtest")
#: Fields of a diagnostic, and its place among those of its log: by phase, then by line, then
#: by the parser that read it.
FIELDS = ("severity", "category", "message", "path", "line", "col_no", "repetition_count")
PHASE, TURNS = 1 << 50, 32


#: Of a line of a log: it may tell something of the build tool; the tool wrote it.
SAYS, OWNED = 1, 2


def tool_diagnostics(lines: DataFrame, by: str) -> DataFrame:
    """by, phase (0: causes of rule files, 1: other lines), ordinal and FIELDS of what the build
    tool itself wrote."""
    return _told(lines.where(build_lines.may_say(F.col("line"))).select(by, "ordinal", "line"), by)


def _told(some: DataFrame, by: str) -> DataFrame:
    """`tool_diagnostics` of lines that may tell something."""
    # They are shuffled once, for all three uses below; by line, so that a long log is many
    # tasks. What is read of them is generated, so that no use filters the lines before.
    c = F.col("line")
    some = some.repartition(by, "ordinal")

    def read(make):
        return some.select(by, "ordinal", "line", F.explode(F.array(once(c, make))).alias("_r")).select(by, "ordinal", "line", "_r.*")

    marks = read(lambda x: F.struct(build_lines.is_header(x).alias("head"), build_lines.inline(x)["category"].alias("inline"), build_lines.traceback_location(x).isNotNull().alias("place"))).where("head or place or inline is not null")
    context = marks.groupBy(F.col(by).alias("_log")).agg(F.when(F.bool_or(F.coalesce(F.col("inline") == "analysis", F.lit(False))), "analysis").otherwise("loading").alias("context"))
    causes = build_lines.tracebacks(some.select(F.explode(F.array(F.struct(by, "ordinal", "line"))).alias("_l")).select("_l.*"), by).select(by, F.lit(0).alias("phase"), "ordinal", *FIELDS[:6], F.lit(1).cast("bigint").alias("repetition_count"))

    def says(x):
        said = F.coalesce(build_lines.lint(x), build_lines.strict_dependency(x), build_lines.wrapper(x))
        fallback = once(parsers.fallback_category(x), lambda k: F.when(k.isNotNull(), build_lines._row(None, None, None, parsers.fallback_severity(x), k, build_lines.strip(x))))
        other = ~build_lines.is_header(x) & build_lines.traceback_location(x).isNull() & build_lines.error_message(x).isNull()
        return F.when(other, F.struct(said.alias("said"), build_lines.source_context(x, "loading").alias("source"), fallback.alias("fallback")))

    x = read(says).where("said is not null or source is not null or fallback is not null")
    x = x.groupBy(by, "line").agg(F.count(F.lit(1)).alias("repetition_count"), F.min("ordinal").alias("ordinal"), *(F.first(k).alias(k) for k in ("said", "source", "fallback")))
    x = x.join(context, F.col(by).eqNullSafe(F.col("_log")), "left")
    source = F.when(F.col("context").isNotNull() & F.col("source").isNotNull(), F.col("source").withField("category", F.col("context")))
    one = F.coalesce("said", source, "fallback")
    found = x.withColumn("one", one).where("one is not null").select(by, F.lit(1).alias("phase"), "ordinal", *(F.col(f"one.{k}").alias(k) for k in FIELDS[:6]), "repetition_count")
    return causes.unionByName(found)


def _opens(line: Column) -> Column:
    out = F.lit(False)
    for k in OPENED:
        for x in blocks.FORMS[k].lines:
            if x.role == "open":
                out = out | x.fits(line)
    return out


def text_diagnostics(lines: DataFrame, by: str) -> DataFrame:
    """by, ordinal (in the order in which they are told) and FIELDS of all diagnostics of each
    log; by may be null. Where a source frame tells what a compiler's plug-in met, the tool's
    lines that only say which command failed go."""
    def marked(c: Column) -> Column:
        says = F.coalesce(build_lines.may_say(c), F.lit(False))
        flags = once(says, lambda k: F.when(k, SAYS).otherwise(0) + F.when(build_lines.is_owned(c, k), OWNED).otherwise(0))
        return F.struct(c.alias("line"), flags.cast("tinyint").alias("flags"))

    # Generated, so that the optimizer doesn't put the expression in each place of the line. All
    # lines are made, marked and shuffled once, for the three uses below.
    plain = lines.select(by, "ordinal", F.explode(F.array(once(strip_terminal(F.col("line")), marked))).alias("_m")).select(by, "ordinal", "_m.line", "_m.flags")
    chunks = blocks.chunked(plain, by, flags="flags")

    def those(make):
        return blocks.read_once(chunks, by, make)

    tool = _told(those(lambda c, k: F.when(k.bitwiseAND(F.lit(SAYS).cast("tinyint")) != 0, True)).select(by, "ordinal", "line"), by)
    one = those(lambda c, k: F.when(k.bitwiseAND(F.lit(OWNED).cast("tinyint")) == 0, parsers.first_of(c, SINGLE, _opens)))
    one = parsers.fields_of(one.withColumnRenamed("_x", "parser"), parsers=SINGLE)
    category = F.when(F.col("parser") == "test_line", "test").otherwise("compilation")
    one = one.select(by, F.lit(2).alias("phase"), (F.col("ordinal") * TURNS).alias("ordinal"), "severity", category.alias("category"), "message", compact_path(F.col("path")).alias("path"), F.col("line_no").alias("line"), "col_no", F.lit(1).cast("bigint").alias("repetition_count"))
    many = blocks.diagnostics_of(chunks, by, hidden=OWNED)
    framed = many.where("form = 'frame'").select(F.col(by).alias("_log")).distinct()
    turn = F.lit(0)
    for k, form in enumerate(blocks.FORMS, 1):
        turn = F.when(F.col("form") == form, k).otherwise(turn)
    many = many.select(by, F.lit(2).alias("phase"), (F.col("ordinal") * TURNS + turn).alias("ordinal"), *FIELDS[:6], F.lit(1).cast("bigint").alias("repetition_count"))
    low = ascii_lower(F.col("message"))
    command = F.contains(low, F.lit("error executing ")) & F.contains(low, F.lit(" command"))
    tool = tool.withColumn("ordinal", F.col("ordinal") * TURNS)
    tool = tool.where(~command).unionByName(tool.where(command).join(framed, F.col(by).eqNullSafe(F.col("_log")), "left_anti"))
    out = tool.unionByName(one).unionByName(many)
    return out.withColumn("ordinal", F.col("phase") * F.lit(PHASE) + F.col("ordinal")).drop("phase")


def summary(lines: DataFrame, by: str, items: int = 20, most: int = 4096) -> DataFrame:
    """The ranked, deduplicated diagnostics of each log within the budget, with its headline."""
    null = F.lit(None).cast("string")
    found = text_diagnostics(lines, by).withColumnRenamed(by, "inv").withColumns({"target": null, "action": null})
    return reduce.finalized(found, items, most).drop("target", "action", "ordinal").withColumnRenamed("inv", by)
