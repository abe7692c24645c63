"""Diagnostics that stand in several lines of a log: compilers' details, linkers' symbols,
source frames, exceptions with their stack, failures of test frameworks.

Each form says which role a line may play in it. `open` begins a block at its line; `close`
ends it; `at`, `note` and the like are details inside; `carry` is remembered for the blocks
that open later (the last place of a traceback), as is `name`, which ends a block too, until
`drop`, which does so as well, and where the form consumes it, until the next block opened. Forms don't see each other's blocks, so blocks
of different forms may interleave, and a block that never ends is cut by its reach.

Lines have numbers without gaps in their log. One window over (log, chunk) tells each line
its blocks and what is carried; a chunk takes the last REACH lines before it along, so a log
of any length is many tasks and the result doesn't depend on where chunks begin. Details are
then gathered by (log, form, block), never more than the form's reach of lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bounded, compact_path, once

#: A line reaches no block that opened, and sees nothing carried, more lines ago than this.
REACH, CHUNK = 2_000, 500_000
#: Bytes of a message with source frames, and of each of its lines.
FRAME, FRAME_LINE = 597, 240


@dataclass(frozen=True)
class Line:
    """A role, the lines that play it, and the groups of the pattern that hold the fields.
    texts: groups joined by a colon; none: the whole line without outer white space. has: what
    stands in each such line, which is looked for before the pattern is tried."""

    role: str
    pattern: str
    path: int = 0
    line: int = 0
    col: int = 0
    severity: int = 0
    texts: tuple[int, ...] = ()
    has: str = ""

    def fits(self, line: Column) -> Column:
        if self.pattern == "^":
            return line.isNotNull()
        return F.contains(line, F.lit(self.has)) & line.rlike(self.pattern) if self.has else line.rlike(self.pattern)


@dataclass(frozen=True)
class Form:
    lines: tuple[Line, ...]
    reach: int = 60
    #: How many lines back a carried line counts; whether a block that opens uses it up.
    back: int = REACH
    consumes: bool = False
    #: Whether every line of a block that plays no role is a note.
    free: bool = False
    category: str = "compilation"
    #: Roles of which a block has one, if it is to count.
    needs: tuple[str, ...] = ()


CARRIED, ENDS = ("carry", "name"), ("close", "drop", "name")
_ERROR = r"(?:Error|Exception|Exit|Interrupt)"
_BLANK = r"^\s*$"
FORMS = {
    "rust": Form((
        Line("open", r"^(error|warning)(?:\[(E\d+)\])?: (.+?)\s*$", severity=1, texts=(2, 3), has=": "),
        Line("at", r"^\s*--> (.+):(\d+):(\d+)\s*$", 1, 2, 3, has="--> "),
        Line("note", r"^\s*\d*\s*\|.*\^+ ([^|^]+?)\s*$", texts=(1,), has="^ "),
        Line("close", _BLANK))),
    "java": Form((
        Line("open", r"^(\S+\.java):(\d+): (error|warning): (.+?)\s*$", 1, 2, severity=3, texts=(4,), has=".java:"),
        Line("note", r"^\s+symbol:\s+(.+?)\s*$", texts=(1,), has="symbol:")), reach=6),
    "java_test": Form((
        Line("open", r'^(?:Exception in thread "[^"]*" )?((?:[a-z][\w$]*\.)+[A-Z][\w$]*' + _ERROR + r"(?:: .*?)?)\s*$", texts=(1,)),
        Line("at", r"^\s+at (?!javax?\.|jdk\.|sun\.|junit\.|org\.junit\.)((?:[a-z][\w$]*\.)*)[A-Z][\w$]*(?:[.$][\w$<>]+)*\(([\w$]+\.java):(\d+)\)\s*$", 2, 3, texts=(1,), has=".java:"),
        Line("frame", r"^\s+at [^()\s]+\(.*\)\s*$", has="at "),
        Line("close", _BLANK)), category="test", needs=("at", "frame")),
    "frame": Form((
        Line("open", r"^\s+[x×] (.+?)\s*$", texts=(1,)),
        Line("at", r"^\s*(?:,-|╭─)\[(.+):(\d+):(\d+)\]\s*$", 1, 2, 3, has="["),
        Line("source", r"^\s*(\d+) [|│].*$", line=1),
        Line("caret", r"^\s*[:·] .*\^.*$", has="^"),
        Line("why", r"^\s+\d+: (failed .+?)\s*$", texts=(1,), has=": failed "),
        Line("carry", r"^(failed to .+?)\s*$", texts=(1,), has="failed to ")), back=1, needs=("at",)),
    "node": Form((
        Line("open", r"^(?:Uncaught )?([A-Z][A-Za-z]*" + _ERROR + r"(?: \[\w+\])?: .+?)\s*$", texts=(1,), has=": "),
        Line("at", r"^\s+at (?:.* \()?(?!node:)([^()\s][^()]*):(\d+):(\d+)\)?\s*$", 1, 2, 3, has="at "),
        Line("carry", r"^(\S.*\.[cm]?[jt]sx?):(\d+)\s*$", 1, 2, has=":"),
        Line("close", _BLANK)), reach=40, back=8, consumes=True, category="test"),
    "python": Form((
        Line("carry", r'File "(?!<frozen|<string|[^"]*/lib/python\d|[^"]*site-packages|[^"]*_bootstrap\.py")([^"]+)", line (\d+)', 1, 2, has='File "'),
        Line("open", r"^(?:E\s+)?((?:[A-Za-z_][\w.]*\.)?[A-Z]\w*" + _ERROR + r"(?:: .*?)?)\s*$", texts=(1,))), reach=0, consumes=True, category="test", needs=("carry",)),
    "symbols": Form((
        Line("carry", r"^Undefined symbols for architecture .+:\s*$", has="Undefined symbols "),
        Line("drop", r"^ld: ", has="ld: "),
        Line("open", r'^\s+"(.+)", referenced from:\s*$', texts=(1,), has="referenced from:")), reach=0, needs=("carry",)),
    "reference": Form((Line("open", r"(?:^|\s)(\S+):(\d+): undefined reference to [`'\"]?(.+?)['\"]?\s*$", 1, 2, texts=(3,), has="undefined reference to "), Line("open", r"undefined reference to [`'\"](.+?)['\"]\s*$", texts=(1,), has="undefined reference to ")), reach=0),
    "external": Form((Line("open", r': (?:fatal )?error LNK\d+: (unresolved external symbol (?:"[^"]+"|\S+))', texts=(1,), has="error LNK"),), reach=0),
    "rust_test": Form((
        Line("open", r"^thread '([^']+)'.* panicked at (.+):(\d+):(\d+):\s*$", 2, 3, 4, texts=(1,), has="panicked at "),
        Line("close", r"^(?:\s*$|note: |stack backtrace:)")), reach=30, free=True, category="test"),
    "gtest": Form((
        Line("name", r"^\[ RUN      \] (\S+)\s*$", texts=(1,), has="[ RUN      ] "),
        Line("open", r"^unknown file: Failure\s*$", has="Failure"),
        Line("open", r"^(\S.*?):(\d+): Failure\s*$", 1, 2, has="Failure"),
        Line("drop", r"^\[(?:  FAILED  |       OK )\]", has="]"),
        Line("close", r"^(?:\s*$|\[)")), reach=30, free=True, category="test", needs=("carry",)),
    "go": Form((
        Line("name", r"^\s*=== (?:RUN|CONT|NAME)\s+(\S+)\s*$", texts=(1,), has="=== "),
        Line("name", r"^\s*--- (?:FAIL|PASS|SKIP): (\S+) \(", texts=(1,), has="--- "),
        Line("open", r"^\s+([^\s:/]+\.go):(\d+):(?: (.*?))?\s*$", 1, 2, texts=(3,), has=".go:"),
        Line("note", r"^\s{8,}(\S.*?)\s*$", texts=(1,)),
        Line("close", r"^")), reach=30, category="test", needs=("carry",)),
    "go_fail": Form((Line("open", r"^\s*--- FAIL: (\S+) \(", texts=(1,), has="--- FAIL: "),), reach=0, category="test"),
    "go_panic": Form((
        Line("carry", r"^\s*=== (?:RUN|CONT|NAME)\s+(\S+)\s*$", texts=(1,), has="=== "),
        Line("carry", r"^\s*--- (?:FAIL|PASS|SKIP): (\S+) \(", texts=(1,), has="--- "),
        Line("open", r"^panic: (.+?)(?: \[recovered[^\]]*\])?\s*$", texts=(1,), has="panic: "),
        Line("at", r"^\s+(?!/usr/local/go/src/)(/\S+\.go):(\d+)(?: \+0x[0-9a-f]+)?\s*$", 1, 2, has=".go:")), reach=200, category="test", needs=("carry",)),
}
TEST_FORMS = ("java_test", "node", "python", "rust_test", "gtest", "go", "go_fail", "go_panic")
FIELDS = "role string, ordinal bigint, path string, line bigint, col_no bigint, severity string, text string, said string"


def _plays(forms: dict[str, Form], line: Column) -> Column:
    """For each form the number (from 1) of its first line that the line fits; 0 if none."""
    def first(form: Form) -> Column:
        out = F
        for n, x in enumerate(form.lines, 1):
            out = out.when(x.fits(line), F.lit(n))
        return F.coalesce(out, F.lit(0)).cast("tinyint")

    return F.array(*map(first, forms.values()))


def _fields(forms: dict[str, Form], form: Column, plays: Column, line: Column, order: Column) -> Column:
    """The line as a row of FIELDS, by the form and the number of the line that it plays (0: a note)."""
    def row(x: Line) -> Column:
        def got(g: int) -> Column:
            return F.nullif(F.regexp_extract(line, x.pattern, g), F.lit("")) if g else F.lit(None)

        text = F.concat_ws(": ", *map(got, x.texts)) if x.texts else F.trim(line)
        parts = (F.lit(x.role), order, got(x.path), got(x.line), got(x.col), got(x.severity), text, F.trim(line))
        return F.struct(*[p.try_cast(kind).alias(name) for p, (name, kind) in zip(parts, (f.split() for f in FIELDS.split(", ")))])

    out = F
    for k, x in forms.items():
        of = F
        for n, one in enumerate(x.lines, 1):
            of = of.when(plays == n, row(one))
        out = out.when(form == k, of.otherwise(row(Line("note", ""))) if x.free else of)
    return out


def chunked(lines: DataFrame, by: str, order: str = "ordinal", line: str = "line", flags: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """by, _n, _line, _flags and _chunk of all lines, shuffled by log and chunk: once for all who
    read it, if they filter only by what is generated of its rows. A line that the next chunk
    takes along stands there too."""
    chunk = max(chunk, REACH)
    n = F.col(order).cast("bigint")
    own = F.floor(n / chunk)
    of = F.explode(F.when(n % chunk >= chunk - REACH, F.array(own, own + 1)).otherwise(F.array(own))).alias("_chunk")
    # Spread before any pattern is tried, for an input of few partitions; the windows need it so.
    return lines.select(F.col(by), n.alias("_n"), F.col(line).alias("_line"), (F.col(flags) if flags else F.lit(0).cast("tinyint")).alias("_flags"), of).repartition(by, "_chunk")


def read_once(chunks: DataFrame, by: str, make, chunk: int = CHUNK) -> DataFrame:
    """by, ordinal, line and _x for the lines of which make(line, flags) isn't null, each once."""
    mine = F.floor(F.col("_n") / max(chunk, REACH)).eqNullSafe(F.col("_chunk"))
    one = F.struct(mine.alias("mine"), F.col("_line").alias("line"), F.col("_flags").alias("flags"))
    x = once(one, lambda r: F.when(r["mine"], make(r["line"], r["flags"])))
    return chunks.select(by, F.col("_n").alias("ordinal"), F.col("_line").alias("line"), F.explode(F.array(x)).alias("_x")).where("_x is not null")


def gathered(lines: DataFrame, by: str, forms: dict[str, Form], order: str = "ordinal", line: str = "line", chunk: int = CHUNK) -> DataFrame:
    """The blocks of all lines, see `gathered_of`."""
    return gathered_of(chunked(lines, by, order, line, chunk=chunk), by, forms, chunk)


def gathered_of(chunks: DataFrame, by: str, forms: dict[str, Form], chunk: int = CHUNK, hidden: int = 0) -> DataFrame:
    """by, form, ordinal (where the block opens), rows (the block's lines with their roles, in
    order, the opening one first) and carried, for each block that has what its form needs.
    Lines with one of the flags `hidden` are passed over.

    What goes through the window of all lines is a number for each form; fields are read of
    lines that are gathered only."""
    chunk = max(chunk, REACH)
    one = F.struct(F.col("_n").alias("n"), F.coalesce("_line", F.lit("")).alias("line"), F.col("_flags").alias("flags"))
    # Generated, so that no filter goes below the shuffle, which others may share.
    plays = once(one, lambda r: F.when(r["n"].isNotNull() & (r["flags"].bitwiseAND(F.lit(hidden).cast("tinyint")) == 0), _plays(forms, r["line"])))
    x = chunks.select(by, "_n", F.coalesce("_line", F.lit("")).alias("_line"), "_chunk", F.explode(F.array(plays)).alias("_plays")).where("_plays is not null")
    upto = Window.partitionBy(by, "_chunk").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(by, "_chunk").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)

    def those(form: Form, roles) -> list[int]:
        return [i for i, one in enumerate(form.lines, 1) if one.role in roles]

    def is_in(c: Column, some: list[int]) -> Column:
        return c.isin(some) if some else F.lit(False)

    place = F.col("_n")
    cols = {}
    for i, (k, form) in enumerate(forms.items()):
        r = F.get("_plays", F.lit(i))
        # Twice the place, and one more where a block opens.
        bounds = F.when(is_in(r, those(form, ("open",))), place * 2 + 1).when(is_in(r, those(form, ENDS)), place * 2)
        cols[f"_b_{k}"] = F.last(bounds, ignorenulls=True).over(upto) if form.reach else bounds
        if carries := those(form, CARRIED):
            kept = F.when(is_in(r, carries), F.struct(place.alias("n"), r.alias("plays"), F.col("_line").alias("line")))
            # What drops it, or uses it up, is kept in its place, without a line.
            kept = kept.when(is_in(r, those(form, ("drop", *(["open"] if form.consumes else [])))), F.struct(place.alias("n"), F.lit(0).cast("tinyint").alias("plays"), F.lit(None).cast("string").alias("line")))
            cols[f"_c_{k}"] = F.last(kept, ignorenulls=True).over(before)
    # Null-safe: of plain equality a filter on the chunk would go below the shuffle.
    x = x.withColumns(cols).where(F.floor(F.col("_n") / chunk).eqNullSafe(F.col("_chunk")))
    parts = []
    for i, (k, form) in enumerate(forms.items()):
        r, b = F.get("_plays", F.lit(i)), F.col(f"_b_{k}")
        block = F.floor(b / 2)
        live = (b % 2 == 1) & (place - block <= form.reach) & ~is_in(r, those(form, (*CARRIED, *ENDS)))
        if not form.free:
            live = live & (r > 0)
        c = F.col(f"_c_{k}") if f"_c_{k}" in cols else F.lit(None).cast("struct<n:bigint,plays:tinyint,line:string>")
        c = F.when(is_in(r, those(form, ("open",))) & (c["plays"] > 0) & (place - c["n"] <= form.back), c)
        parts.append(F.when(live, F.struct(F.lit(k).alias("form"), block.alias("block"), r.alias("plays"), c.alias("carried"))))
    x = x.select(by, "_n", "_line", F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("p"))
    x = x.groupBy(by, F.col("p.form").alias("form"), F.col("p.block").alias("ordinal")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_n").alias("n"), F.col("p.plays").alias("plays"), F.col("_line").alias("line")))).alias("rows"), F.max("p.carried").alias("carried"))
    form = F.col("form")
    x = x.select(by, "form", "ordinal", F.transform("rows", lambda r: _fields(forms, form, r["plays"], r["line"], r["n"])).alias("rows"),
                 once(F.col("carried"), lambda c: F.when(c.isNotNull(), _fields(forms, form, c["plays"], c["line"], c["n"]))).alias("carried"))
    need = F.lit(True)
    for k, form in forms.items():
        if form.needs:
            has = F.exists("rows", lambda r: r["role"].isin(*form.needs)) | (F.col("carried").isNotNull() if "carry" in form.needs else F.lit(False))
            need = need & ((F.col("form") != k) | has)
    # Generated, so that no filter reads the fields a second time or makes a second plan below:
    # who asks for some forms here, for others there, shares all up to the groups.
    return x.select(by, "ordinal", F.explode(F.array(F.struct("form", "rows", "carried"))).alias("_x")).select(by, "_x.form", "ordinal", "_x.rows", "_x.carried").where(need)


def _of(role: str) -> Column:
    return F.filter("rows", lambda r: r["role"] == role)


def _said(role: str, sep: str) -> Column:
    return F.array_join(F.transform(_of(role), lambda r: r["text"]), sep)


def _and(a: Column, sep: str, b: Column) -> Column:
    """a, and where b isn't empty also sep and b."""
    return F.concat(a, F.coalesce(F.concat(F.lit(sep), F.nullif(b, F.lit(""))), F.lit("")))


def _place(x: Column) -> Column:
    return F.concat(compact_path(x["path"]), F.lit(":"), x["line"].cast("string"))


def diagnosed(blocks: DataFrame, by: str) -> DataFrame:
    """by, ordinal, form, name, severity, category, message, path, line, col_no of each block."""
    head, at, carried, form = F.get("rows", 0), F.get(_of("at"), 0), F.col("carried"), F.col("form")
    # Where the diagnostic is: the first of these that there is.
    place = F.coalesce(
        F.when(form.isin("rust", "frame", "node", "java_test", "go_panic"), at),
        F.when(form.isin("node", "python"), carried), F.when(~form.isin("node", "python", "java_test", "frame", "rust", "go_panic"), head))
    package = F.when(form == "java_test", F.replace(at["text"], F.lit("."), F.lit("/"))).otherwise("")
    path = F.concat(package, compact_path(place["path"]))
    # The source line that the frame's place names, and the caret just below it.
    source = F.get(F.filter("rows", lambda r: (r["role"] == "source") & (r["line"] == at["line"])), 0)
    caret = F.get(F.filter("rows", lambda r: (r["role"] == "caret") & (r["ordinal"] == source["ordinal"] + 1)), 0)
    why = F.coalesce(F.nullif(_said("why", "; "), F.lit("")), carried["text"])
    frame = _and(head["text"], "\nSWC context: ", why)
    frame = bounded(_and(_and(frame, "\n", bounded(source["said"], FRAME_LINE)), "\n", bounded(caret["said"], FRAME_LINE)), FRAME)
    notes = _said("note", "; ")
    # What a line ending in a colon announces stands on the same line.
    told = F.regexp_replace(notes, ":; ", ": ")
    detail = F.concat_ws("; ", F.nullif(head["text"], F.lit("")), F.nullif(notes, F.lit("")))
    message = (
        F.when(form == "rust", F.when(at.isNull(), head["said"]).otherwise(_and(head["text"], "; ", F.get(_of("note"), 0)["text"])))
        .when(form == "java", _and(head["text"], ": ", F.get(_of("note"), 0)["text"]))
        .when(form == "frame", frame)
        .when(form == "symbols", F.concat(F.lit("undefined symbol: "), head["text"]))
        .when(form == "reference", F.concat(F.lit("undefined reference to "), head["text"]))
        .when(form == "rust_test", _and(F.concat(F.lit("Rust test "), head["text"], F.lit(" failed at "), _place(head), F.lit(":"), head["col_no"].cast("string")), ": ", notes))
        .when(form == "gtest", _and(F.concat(F.lit("C++ test "), carried["text"], F.lit(" failed")), ": ", told))
        .when(form == "go", _and(F.concat(F.lit("Go test "), carried["text"], F.lit(" failed at "), _place(head)), ": ", detail))
        .when(form == "go_fail", F.concat(F.lit("Go test "), head["text"], F.lit(" failed")))
        .when(form == "go_panic", F.concat(F.lit("Go test "), carried["text"], F.lit(" panicked"), F.coalesce(F.concat(F.lit(" at "), _place(at)), F.lit("")), F.lit(": "), head["text"]))
        .otherwise(head["text"]))
    name = F.when(form.isin("rust_test", "go_fail"), head["text"]).when(form.isin("gtest", "go", "go_panic"), carried["text"])
    category = F.lit("compilation")
    for k, f in FORMS.items():
        if f.category != "compilation":
            category = F.when(form == k, f.category).otherwise(category)
    # What Python can't parse never ran.
    category = F.when((form == "python") & head["text"].rlike(r"^(?:SyntaxError|IndentationError|TabError)\b"), "compilation").otherwise(category)
    # An exception with neither a frame nor a source header isn't Node's.
    mine = (form != "node") | at.isNotNull() | carried.isNotNull()
    return blocks.where(mine).select(
        by, "ordinal", "form", name.alias("name"), F.when(head["severity"] == "warning", "warning").otherwise("error").alias("severity"), category.alias("category"), message.alias("message"),
        path.alias("path"), place["line"].alias("line"), place["col_no"].alias("col_no"))


def go_failures(found: DataFrame, by: str) -> DataFrame:
    """A row for each Go test that failed: what it panicked with, else its first detail, else its
    name alone; where the test is marked as failed first."""
    x = found.where(F.col("form").isin("go", "go_fail", "go_panic"))
    first = lambda k: F.min_by(F.struct(*[c for c in x.columns if c not in (by, "name")]), F.when(F.col("form") == k, F.col("ordinal")))
    g = x.groupBy(by, "name").agg(first("go_panic").alias("_panic"), first("go").alias("_detail"), first("go_fail").alias("_fail")).where("_fail is not null")
    one = F.coalesce("_panic", "_detail", "_fail")
    return g.select(by, F.col("_fail.ordinal").alias("ordinal"), one["form"].alias("form"), "name", *(one[c].alias(c) for c in ("severity", "category", "message", "path", "line", "col_no")))


def block_diagnostics(lines: DataFrame, by: str, forms: dict[str, Form] | None = None, order: str = "ordinal", line: str = "line", chunk: int = CHUNK) -> DataFrame:
    """by, ordinal, form, name, severity, category, message, path, line, col_no of all blocks;
    Go's details count only for tests that failed."""
    return diagnostics_of(chunked(lines, by, order, line, chunk=chunk), by, forms, chunk)


def diagnostics_of(chunks: DataFrame, by: str, forms: dict[str, Form] | None = None, chunk: int = CHUNK, hidden: int = 0) -> DataFrame:
    """`block_diagnostics` of lines that are `chunked`, but for those with a flag of `hidden`."""
    forms = FORMS if forms is None else forms
    found = diagnosed(gathered_of(chunks, by, forms, chunk, hidden), by)
    if not {"go", "go_fail", "go_panic"} & {*forms}:
        return found
    return found.where(~F.col("form").isin("go", "go_fail", "go_panic")).unionByName(go_failures(found, by))


def test_failures(lines: DataFrame, by: str, order: str = "ordinal", line: str = "line", most: int = 20, chunk: int = CHUNK) -> DataFrame:
    """The failures that a test's log tells, at most `most` for each log: by, rank, name, message,
    path, line, col_no. Equal messages at equal places are one; those of a place come first."""
    x = block_diagnostics(lines, by, {k: FORMS[k] for k in TEST_FORMS}, order, line, chunk)
    x = x.groupBy(by, "name", "message", "path", "line", "col_no").agg(F.min("ordinal").alias("ordinal"))
    w = Window.partitionBy(by).orderBy(F.col("path").isNull(), "ordinal", "message", "path", "line")
    return x.withColumn("rank", F.row_number().over(w).cast("bigint") - 1).where(F.col("rank") < most).drop("ordinal")
