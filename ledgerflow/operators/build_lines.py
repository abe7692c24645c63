"""Lines that a build tool itself writes: rule-file errors, tracebacks, lint reports and strict
dependencies, as Column expressions that give a struct or null, and the traceback's state over
ordered lines. Messages are never longer than their line, which its reader bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ascii_lower, compact_path, once
from .parsers import fallback_category

MOST_U32 = (1 << 32) - 1
# Ends of rule files' paths, heads of lines, and marks of lint reports.
RULE_FILE = r"(?:\.bzl|\.bazel|[/\\]BUILD|[/\\]WORKSPACE)"
HEADER = "Traceback (most recent call last):"
FAILED = "error: build did not complete successfully"
LINT = {"🚨": "error", "⚠️": "warning", "⚠": "warning", "ℹ️": "note", "ℹ": "note"}
#: What stands in lines that a parser below may know, and in their lower-cased form.
RULE_MARKS = (".bzl:", ".bazel:", "BUILD:", "WORKSPACE:")
SAYS = (*RULE_MARKS, HEADER, 'File "', "Error in ", "Error: ", ': import of "', " — ")
WORDS = ("root_cause", "no such package", "no such target", "visibility", "analysis", "missing strict dependencies")
FIELDS = "path string, line bigint, col_no bigint, severity string, category string, message string"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _u32(c: Column) -> Column:
    n = c.try_cast("bigint")
    return F.when(n.between(0, MOST_U32), n)


def _row(path, line, col, severity, category, message) -> Column:
    null = F.lit(None)
    parts = [null if x is None else F.lit(x) if isinstance(x, str) else x for x in (path, line, col, severity, category, message)]
    names = [f.split() for f in FIELDS.split(", ")]
    return F.struct(*[p.cast(kind).alias(name) for p, (name, kind) in zip(parts, names)])


def _any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def may_say(line: Column) -> Column:
    """Whether what all lines have that the parsers of this module (but for `is_status`) and
    `fallback_category` know stands in the line: looked for before any of them is tried."""
    return _any(line, SAYS) | once(F.lower(line), lambda low: _any(low, WORDS))


def inline(line: Column) -> Column:
    """`path:line[:column]: message` of a rule file, by the last path end in the line."""
    split = rf"^((?s:.*){RULE_FILE}):((?s:.*))$"
    number = lambda c: _u32(F.regexp_extract(c, r"^(\d+):", 1))
    rest_of = lambda c: F.regexp_replace(c, r"^\d+:", "")

    def row(x, rest, after):
        def made(col, message):
            low = ascii_lower(message)
            has = lambda w: F.contains(low, F.lit(w))
            category = F.when((low.startswith("in ") & has(" rule //")) | has("analysis of target") | has("aspect on target"), "analysis").otherwise("loading")
            found = _row(compact_path(F.regexp_extract(x, split, 1)), number(rest), col, F.when(has("warning:"), "warning").otherwise("error"), category, message)
            return F.when(number(rest).isNotNull() & (message != ""), found)

        return once(number(after), lambda col: once(strip(F.when(col.isNull(), after).otherwise(rest_of(after))), lambda message: made(col, message)))

    def read(x):
        return F.when(x.rlike(split), once(F.regexp_extract(x, split, 2), lambda rest: once(rest_of(rest), lambda after: row(x, rest, after))))

    told = strip(line).startswith("DEBUG: ") | strip(line).startswith("INFO: ")
    # Looked for before any pattern is tried; most lines have none.
    return F.when(_any(line, RULE_MARKS) & ~told, once(F.regexp_replace(strip(line), "^ERROR: ", ""), read))


def is_root_cause(message: Column) -> Column:
    low = ascii_lower(message)
    has = lambda w: F.contains(low, F.lit(w))
    return has("syntax error") | has("contains syntax errors") | (has("name '") & has(" is not defined"))


def wrapper(line: Column) -> Column:
    """A rule file's line that only passes a cause on: no place, and a category by its words."""
    def row(found: Column) -> Column:
        low = ascii_lower(line)
        category = F.when(F.contains(low, F.lit("visibility")), "visibility").when(F.contains(low, F.lit("analysis")), "analysis").otherwise("compilation")
        return F.when(found.isNotNull() & ~is_root_cause(found["message"]), _row(None, None, None, found["severity"], category, strip(line)))

    return once(inline(line), row)


def source_context(line: Column, category: str) -> Column:
    def row(low: Column) -> Column:
        has = lambda w: F.contains(low, F.lit(w))
        ok = low.startswith("test ") & low.endswith(" ... ok")
        return F.when(has("root_cause") & ~has("error:") & ~has("error[") & ~ok, _row(None, None, None, "error", category, strip(line)))

    return once(ascii_lower(strip(line)), row)


def traceback_location(line: Column) -> Column:
    """`File "p", line N[, column M]` where p is a rule file."""
    p = r'File "((?s:.*?))", line (\d+)(?:, column (\d+))?'
    path, at = F.regexp_extract(line, p, 1), _u32(F.regexp_extract(line, p, 2))
    fits = path.rlike(r"(\.bzl|\.bazel|(^|[/\\])(BUILD|WORKSPACE))$") & at.isNotNull()
    return F.when(F.contains(line, F.lit('File "')) & F.contains(line, F.lit('", line ')) & fits, F.struct(compact_path(path).alias("path"), at.alias("line"), _u32(F.regexp_extract(line, p, 3)).alias("col_no")))


def is_header(line: Column) -> Column:
    return F.regexp_replace(strip(line), "^ERROR: ", "") == HEADER


def error_message(line: Column) -> Column:
    x = strip(line)
    return F.when(x.startswith("Error in ") | x.startswith("Error: "), x)


def lint(line: Column) -> Column:
    """`mark path:line[:column] · tool · rule — message`."""
    x = strip(line)
    p = r"^(" + "|".join(LINT) + r") ((?s:.*?)) — ((?s:.*))$"
    mark, message = F.regexp_extract(x, p, 1), strip(F.regexp_extract(x, p, 3))
    fields = F.transform(F.split(F.regexp_extract(x, p, 2), " · ", -1), strip)
    place, tool, rule = F.get(fields, 0), _or_null(F.get(fields, 1)), _or_null(F.get(fields, 2))
    two, one = r"^((?s:.+)):(\d+):(\d+)$", r"^((?s:.+)):(\d+)$"
    both = place.rlike(two)
    path = F.when(both, F.regexp_extract(place, two, 1)).otherwise(F.regexp_extract(place, one, 1))
    at = _u32(F.when(both, F.regexp_extract(place, two, 2)).otherwise(F.regexp_extract(place, one, 2)))
    severity = F.lit(None).cast("string")
    for m, s in LINT.items():
        severity = F.when(mark == m, s).otherwise(severity)
    said = F.when(tool.isNull() & rule.isNull(), message).otherwise(F.concat(F.coalesce(tool, F.lit("")), F.when(tool.isNotNull() & rule.isNotNull(), " ").otherwise(""), F.coalesce(F.concat(F.lit("["), rule, F.lit("]")), F.lit("")), F.lit(": "), message))
    row = _row(compact_path(path), at, F.when(both, _u32(F.regexp_extract(place, two, 3))), severity, "compilation", said)
    return F.when(F.contains(line, F.lit(" — ")) & severity.isNotNull() & at.isNotNull() & (message != ""), row)


def strict_dependency(line: Column) -> Column:
    """`x.go: import of "y"`: the first such mark of a line counts."""
    p = r'^((?s:.*?)): import of "([^"]*)'
    path, name = strip(F.regexp_extract(line, p, 1)), strip(F.regexp_extract(line, p, 2))
    short = compact_path(path)
    said = F.concat(F.lit("missing strict dependency: "), short, F.lit(' imports "'), name, F.lit('"; add its target to deps'))
    return F.when(F.contains(line, F.lit(': import of "')) & path.endswith(".go") & (name != ""), _row(short, None, None, "error", "compilation", said))


def is_status(line: Column) -> Column:
    return line.rlike(rf"^\s*(?i:debug:|info:|{FAILED}\s*\z)")


def is_owned(line: Column, says: Column | None = None) -> Column:
    """Whether the build tool wrote the line, so that no compiler's parser is to see it. says:
    `may_say` of the line, where it is known."""
    def any_of(c: Column) -> Column:
        out = F.coalesce(is_header(c), F.lit(False))
        for f in (inline, traceback_location, error_message, fallback_category, strict_dependency, lint):
            out = out | f(c).isNotNull()
        return F.coalesce(is_status(c), F.lit(False)) | (F.coalesce(may_say(c) if says is None else says, F.lit(False)) & out)

    return once(line, any_of)


def tracebacks(lines: DataFrame, by: str, order: str = "ordinal", line: str = "line") -> DataFrame:
    """by, order and the fields of each cause: an error line with the last place since its
    header, and rule-file lines that are causes themselves. An error uses its place up."""
    c = F.col(line)
    read = once(c, lambda x: F.struct(is_header(x).alias("_head"), inline(x).alias("_inline"), traceback_location(x).alias("_at"), error_message(x).alias("_said")))
    x = lines.where(may_say(c)).select(by, order, c, F.explode(F.array(read)).alias("_r")).select(by, order, c, "_r.*")
    # The first that holds decides what a line is.
    x = x.withColumn("_kind", F.when(F.col("_head"), "head").when(F.col("_inline").isNotNull(), "inline").when(F.col("_at").isNotNull(), "at").when(F.col("_said").isNotNull(), "said")).where("_kind is not null")
    kind = F.col("_kind")
    at = F.when(kind == "inline", F.struct(F.col("_inline.path"), F.col("_inline.line"), F.col("_inline.col_no"))).when(kind == "at", F.col("_at"))
    category = F.when(kind == "inline", F.col("_inline.category")).when((kind == "head") & strip(c).startswith("ERROR:"), "loading")
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # Each of these lines sets the place, to none if need be: the one before tells it.
    y = x.withColumn("_place", F.lag(at).over(Window.partitionBy(by).orderBy(order))).withColumn("_category", F.coalesce(F.last(category, ignorenulls=True).over(before), F.lit("loading")))
    said = _row(F.col("_place.path"), F.col("_place.line"), F.col("_place.col_no"), "error", F.col("_category"), F.col("_said"))
    out = F.when(kind == "said", said).when((kind == "inline") & is_root_cause(F.col("_inline.message")), F.col("_inline"))
    return y.select(by, order, out.alias("_out")).where("_out is not null").select(by, order, "_out.*")
