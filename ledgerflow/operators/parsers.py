"""Diagnostics out of single lines of compilers' output, as Column expressions. Each parser
is a pattern with the groups path, line, column, severity and message (0: not there)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, once

#: name -> pattern, groups of (path, line, column, severity, message), severity if none is named.
#: The patterns mean the same to Java and RE2. More specific ones come first.
PARSERS = {
    "typescript": (r"^([^\s(]+\.tsx?)\((\d+),(\d+)\): (error|warning) (TS\d+: .+)$", (1, 2, 3, 4, 5), "error"),
    "typescript_pretty": (r"^([^\s:]+\.tsx?):(\d+):(\d+) - (error|warning) (TS\d+: .+)$", (1, 2, 3, 4, 5), "error"),
    "msvc": (r"^([^\s(]+)\((\d+)(?:,(\d+))?\): (error|warning) (C\d+: .+)$", (1, 2, 3, 4, 5), "error"),
    "clang": (r"^([^\s:]+\.(?:cc|cpp|cxx|c|hh|hpp|h|m|mm)):(\d+):(\d+): (error|warning|fatal error): (.+)$", (1, 2, 3, 4, 5), "error"),
    "java": (r"^([^\s:]+\.java):(\d+): (error|warning): (.+)$", (1, 2, 0, 3, 4), "error"),
    "protobuf": (r"^([^\s:]+\.proto):(\d+):(\d+): (.+)$", (1, 2, 3, 0, 4), "error"),
    "go": (r"^([^\s:]+\.go):(\d+):(\d+): (.+)$", (1, 2, 3, 0, 4), "error"),
    "python": (r"^\s*File \"([^\"]+)\", line (\d+)", (1, 2, 0, 0, 0), "error"),
    "rust": (r"^(error|warning)(?:\[E\d+\])?: (.+)$", (0, 0, 0, 1, 2), "error"),
    "linker": (r"^(?:.*: )?(undefined reference to .+|unresolved external symbol .+)$", (0, 0, 0, 0, 1), "error"),
}


#: What stands in each line that a pattern below fits, in lower case if the pattern takes either:
#: looked for before the pattern is tried.
MARKS = {"typescript": "TS", "typescript_pretty": "TS", "msvc": "): ", "clang": ": ", "java": ".java:", "protobuf": ".proto:", "go": ".go:", "python": "File \"", "rust": ": "}


def first_of(c: Column, parsers: dict = PARSERS, unless: Callable[[Column], Column] | None = None) -> Column:
    """The name of the first parser that fits, null if none does or `unless` holds."""
    out = F
    for k, (pattern, _, _) in parsers.items():
        out = out.when((F.contains(c, F.lit(MARKS[k])) & c.rlike(pattern)) if k in MARKS and PARSERS.get(k, ("",))[0] == pattern else c.rlike(pattern), k)
    return out if unless is None else once(out, lambda k: F.when(k.isNotNull() & ~unless(c), k))


def fields_of(rows: DataFrame, line: str = "line", parsers: dict = PARSERS) -> DataFrame:
    """rows with path, line_no, col_no, severity and message, as the column parser reads the line."""
    def fields(c: Column, parser: Column) -> Column:
        out = F
        for k, (pattern, groups, severity) in parsers.items():
            got = [F.nullif(F.regexp_extract(c, pattern, g), F.lit("")) if g else F.lit(None) for g in groups]
            said = got[3] if groups[3] else F.lit(severity)
            level = F.when(F.contains(said, F.lit("warning")), "warning").otherwise("error")
            parts = (got[0].cast("string"), got[1].cast("bigint"), got[2].cast("bigint"), level, got[4].cast("string"))
            out = out.when(parser == k, F.struct(*[p.alias(n) for p, n in zip(parts, ("path", "line_no", "col_no", "severity", "message"))]))
        return out

    both = once(F.struct(F.col(line).alias("line"), "parser"), lambda r: fields(r["line"], r["parser"]))
    return rows.select(*rows.columns, F.explode(F.array(both)).alias("_f")).select(*rows.columns, "_f.*")


def parsed(lines: DataFrame, line: str = "line", parsers: dict = PARSERS, unless: Callable[[Column], Column] | None = None) -> DataFrame:
    """lines with parser, path, line_no, col_no, severity and message of the first parser that
    fits; lines that none fits go, as do those for which `unless` holds."""
    # Generated, so that no expression is evaluated more than once a line.
    rows = lines.select("*", F.explode(F.array(once(F.col(line), lambda c: first_of(c, parsers, unless)))).alias("parser")).where("parser is not null")
    return fields_of(rows, line, parsers)


def fallback_category(line: Column) -> Column:
    """The category of a line that no parser knows, by keywords; null if none stands in it."""
    def told(x: Column) -> Column:
        has = lambda w: F.contains(x, F.lit(w))
        passed = x.startswith("test ") & x.endswith(" ... ok")
        return (F.when(passed, None).when(has("root_cause") & ~has("error:") & ~has("error["), "test").when(has("no such package") | has("no such target"), "loading")
                .when(has("visibility") & has("error"), "visibility").when(has("analysis") & (has("error") | has("fail")), "analysis").when(has("missing strict dependencies"), "compilation"))

    return once(ascii_lower(F.regexp_replace(line, r"^\s+|\s+$", "")), told)


def fallback_severity(line: Column) -> Column:
    return F.when(F.contains(ascii_lower(line), F.lit("warning:")), "warning").otherwise("error")


def regex_diagnostics(texts: DataFrame, text: str, pattern: str, most: int = 50) -> DataFrame:
    """texts with n and match: the first `most` (1,000 at most) matches of a pattern in each text."""
    if not 0 < most <= 1_000:
        raise ValueError("most must be from 1 to 1000")
    found = F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), 1, most)
    return texts.select(*[c for c in texts.columns if c != text], F.posexplode(found).alias("n", "match"))
