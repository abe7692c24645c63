"""Queries of whole logs: name -> (query, SQL that says the same).

Each document is a log: its own lines, and after most of them a block of LOGS with the line's
first word and number filled in. Of every fifth block a line is missing, so that blocks
are cut off, run into each other or nearly fit. The SQL parses the same lines by patterns and
windows of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import blocks, logs
from .sources.tables import table

S = "/tmp/s1/execroot/_main"
R = "/tmp/s1/bin/t.runfiles/_main"
#: {w} is a word of the line before, {n} a number.
LOGS = [
    ["error[E0{n}]: mismatched {w}", " --> src/{w}.rs:{n}:28", "  |", "2 |     let a = {w};", "  |             ^^^^ expected `{w}`", "  |"],
    ["warning: unused {w}", "  --> src/{w}.rs:{n}:3", "", "error: could not compile `{w}`", "error[{w}]: no code"],
    ["lib/{w}.java:{n}: error: cannot find symbol", "    return {w}.of(1);", "           ^", "  symbol:   variable {w}", "  location: class A"],
    ["lib/{w}.java:{n}: warning: {w} is old", "x", "y", "z", "w", "v", "  symbol:   class TooFar{n}"],
    ['Exception in thread "main" java.lang.AssertionError: {w} differs', "\tat org.junit.Assert.fail(Assert.java:89)", "\tat shop.{w}.Rates$In.find(Rates.java:{n})", "\tat shop.Main.main(Main.java:5)", ""],
    ["shop.errors.RateError", "\tat java.util.Map.of(Map.java:{n})", "", "\tat shop.Late.x(Late.java:1)", "java.lang.Error: {w}"],
    ["failed to process {w}", "  x Expected {w}", f"   ,-[{S}/web/{{w}}.ts:2:{{n}}]", " 1 | const a = 1;", " 2 | const {w} c = 2;", "   :         ^", " 3 | end", "   `----"],
    ["  × Unknown {w}", f"   ╭─[{R}/web/{{w}}.tsx:{{n}}:1]", " {n} │ export {w}", "Caused by:", "    0: failed to invoke {w}", "    1: Syntax Error", "    2: failed again"],
    [f"{R}/web/{{w}}.js:{{n}}", "  total({w}.rows);", "", "TypeError: Cannot read {w}", f"    at total ({R}/web/{{w}}.js:{{n}}:19)", f"    at {R}/web/other.js:1:2", "    at Module._compile (node:internal/loader:1:1)", ""],
    [f"{R}/web/{{w}}.cjs:{{n}}", "    ^", "SyntaxError: bad {w}", "    at wrap (node:internal/vm:1:1)", "", "RangeError: alone {w}", ""],
    ["Traceback (most recent call last):", '  File "/opt/lib/python3.11/runpy.py", line 5, in run', f'  File "{R}/shop/{{w}}_test.py", line {{n}}, in test_rate', "    self.assertEqual(1, 2)", "AssertionError: {w} != 2", "ValueError: no place {w}"],
    ['  File "shop/{w}.py", line {n}', "SyntaxError: '{w}' was never closed", '  File "<frozen runpy>", line 3, in x', "E       shop.errors.{w}Error: none", '  File "shop/o.py", line {n}, in f', "E       KeyError: '{w}'"],
    ["Undefined symbols for architecture arm64:", '  "{w}(int)", referenced from:', "      _main in a.o", '  "_{w}", referenced from:', "ld: symbol(s) not found", '  "late{n}", referenced from:'],
    [f"/usr/bin/ld: a.o: {S}/cc/{{w}}.cc:{{n}}: undefined reference to `{{w}}(int)'", "collect2: undefined reference to `vt{n}'", "undefined reference to nothing", '{w}.obj : error LNK2019: unresolved external symbol "int {w}(int)" referenced in main', "a.obj : error LNK1120: {n} unresolved externals"],
    ["test {w} ... FAILED", "thread '{w}' <PID> panicked at src/{w}.rs:{n}:5:", "assertion `left == right` failed: {w}", "  left: 1", " right: {n}", "note: run with `RUST_BACKTRACE=1`", "thread 'a::b' panicked at b.rs:1:{n}:", "boom", ""],
    ["[ RUN      ] Rates.{w}", "cc/{w}_test.cc:{n}: Failure", "Expected equality of these values:", "  Vat({n})", "    Which is: 3", "", "[  FAILED  ] Rates.{w} (0 ms)", "unknown file: Failure", "nobody runs"],
    ["[ RUN      ] Rates.T{n}", "unknown file: Failure", 'C++ exception with description "{w}" thrown.', "[  FAILED  ] Rates.T{n} (0 ms)", "[ RUN      ] Rates.Ok", "[       OK ] Rates.Ok (0 ms)"],
    ["=== RUN   Test{w}", "    {w}_test.go:{n}: got 4; want 5", "--- FAIL: Test{w} (0.00s)", "=== RUN   TestFine", "    fine_test.go:3: a log", "--- PASS: TestFine (0.00s)"],
    ["=== RUN   TestTable{n}", "=== RUN   TestTable{n}/{w}", "    table_test.go:{n}:", '        got: "{w}"', '        want: "b"', "--- FAIL: TestTable{n} (0.00s)", "    --- FAIL: TestTable{n}/{w} (0.00s)", "FAIL"],
    ["=== RUN   TestQ{w}", "--- FAIL: TestQ{w} (0.00s)", "panic: closed {w} [recovered, repanicked]", "", "goroutine 7 [running]:", "    /usr/local/go/src/testing/testing.go:18 +0x2", f"    {S}/shop/{{w}}_test.go:{{n}} +0x45"],
    ["ERROR: pkg/{w}/BUILD:{n}:9: name 'rate' is not defined", "ERROR: pkg/BUILD.bazel:{n}:1: Compiling {w} failed: error executing Swc command", "{w}_root_cause in rates", "ERROR: Build did NOT complete successfully", "{w}_root_cause in rates", "no such package {w}", "warning: analysis of {w} failed"],
    ["🚨 src/{w}.ts:{n}:3 · eslint · no-{w} — do not {w}", "⚠️ src/{w}.ts:{n} · ruff — hm {w}", "🚨 src/{w}.ts:x — no number", f'{S}/shop/{{w}}.go: import of "ex.org/{{w}}"', 'shop/{w}.gox: import of "ex.org"', "lib/{w}.bzl:{n}: in my_rule rule //a:{w}: bad", "INFO: lib/a.bzl:{n}: {w}", "test {w}_root_cause ... ok"],
    ["ERROR: Traceback (most recent call last):", '  File "pkg/{w}.bzl", line {n}, column 3, in _impl', "Error in fail: no {w}", "shop/{w}.go:{n}:4: cannot use {w}", "ui/{w}.ts({n},3): error TS2322: no {w}", "cc/{w}.cc:{n}:3: fatal error: {w} not found", "p/{w}.proto:{n}:1: {w} is not defined.", "warning: {w}", "tool ERROR: {w}", "shop/{w}.go:{n}: no column"],
]
EVERY = 5


def _log_lines(spark, sf_dir):
    """log, ordinal, line. A line's block is the one that (31 * doc_id + 7 * place) names, if any."""
    many = F.array(*(F.array(*map(F.lit, b)) for b in LOGS))

    def told(line, place):
        block = F.coalesce(F.get(many, (F.expr("31 * doc_id") + 7 * place) % F.lit(len(LOGS) + 2)), F.array())
        lost = F.when((F.col("doc_id") + place) % EVERY == 0, (F.col("doc_id") + 3 * place) % F.greatest(F.size(block), F.lit(1))).otherwise(-1)
        word = F.regexp_extract(line, "[a-z]+", 0)
        number = ((F.col("doc_id") + place) % 89 + 11).cast("string")
        kept = F.filter(block, lambda _, k: k != lost)
        return F.concat(F.array(line), F.transform(kept, lambda x: F.replace(F.replace(x, F.lit("{w}"), word), F.lit("{n}"), number)))

    lines = F.flatten(F.transform(F.split("text", "\n"), told))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("log"), F.posexplode(lines).alias("ordinal", "line")).withColumn("ordinal", F.col("ordinal").cast("bigint"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_LISTS = "[" + ", ".join("[" + ", ".join(map(_quoted, b)) + "]" for b in LOGS) + "]"
#: log, ordinal and line in the other engine.
LINES = f"""(SELECT log, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS ordinal, unnest(s) AS line FROM (SELECT doc_id AS log, flatten(list_transform(string_split(text, chr(10)), lambda l, i: list_prepend(l,
  list_transform(list_filter(coalesce(({_LISTS})[(31 * doc_id + 7 * (i - 1)) % {len(LOGS) + 2} + 1], CAST([] AS VARCHAR[])),
    lambda x, k: k - 1 <> CASE WHEN (doc_id + i - 1) % {EVERY} = 0 THEN (doc_id + 3 * (i - 1)) % greatest(len(({_LISTS})[(31 * doc_id + 7 * (i - 1)) % {len(LOGS) + 2} + 1]), 1) ELSE -1 END),
    lambda x: replace(replace(x, '{{w}}', regexp_extract(l, '[a-z]+')), '{{n}}', CAST((doc_id + i - 1) % 89 + 11 AS VARCHAR)))))) AS s FROM documents))"""
#: A path from the workspace on.
_SHORT = r"regexp_replace(regexp_replace(%s, '^.*\.runfiles/_main/', ''), '^.*/execroot/[^/]*/', '')"
_NULLS = {"name": "CAST(NULL AS VARCHAR)", "severity": "'error'", "path": "CAST(NULL AS VARCHAR)", "line": "CAST(NULL AS BIGINT)", "col_no": "CAST(NULL AS BIGINT)"}


def _row(form: str, category: str, message: str, **cols: str) -> str:
    c = _NULLS | cols
    return f"log, o AS ordinal, '{form}' AS form, {c['name']} AS name, {c['severity']} AS severity, {category} AS category, {message} AS message, {c['path']} AS path, {c['line']} AS line, {c['col_no']} AS col_no"


def _blocks_sql(base: str, opens: str, ends: str, reach: int) -> str:
    """CTE d: (log, o, ordinal, x) for the lines x of each block that opens at o."""
    return f"""b AS (SELECT *, coalesce({opens}, false) AS opens, coalesce(({ends}) AND NOT ({opens}), false) AS ends FROM (SELECT log, ordinal, line AS x FROM {base})),
  w AS (SELECT *, max(CASE WHEN opens OR ends THEN ordinal END) OVER (PARTITION BY log ORDER BY ordinal) AS o FROM b),
  d AS (SELECT w.log, w.o, w.ordinal, w.x FROM w JOIN b h ON h.log = w.log AND h.ordinal = w.o AND h.opens WHERE w.ordinal - w.o <= {reach})"""


def _first(value: str, pattern: str) -> str:
    return f"arg_min({value}, ordinal) FILTER (o < ordinal AND regexp_matches(x, '{pattern}'))"


_HEAD = "arg_min(x, ordinal)"


def _rust(base):
    at, label = r"^\s*--> .+:[0-9]+:[0-9]+\s*$", r"^\s*[0-9]*\s*\|.*\^+ [^|^]+$"
    return f"""WITH {_blocks_sql(base, r"regexp_matches(x, '^(error|warning)(\[E[0-9]+\])?: .')", "trim(x) = ''", 60)},
  g AS (SELECT log, o, trim({_HEAD}) AS head, {_first("regexp_extract(x, '--> (.+):([0-9]+):([0-9]+)', ['p', 'l', 'c'])", at)} AS spot, {_first("regexp_extract(x, '[\\^]+ ([^|^]+?)\\s*$', 1)", label)} AS label FROM d GROUP BY log, o)
  SELECT {_row("rust", "'compilation'", "CASE WHEN spot IS NULL THEN head ELSE regexp_replace(regexp_replace(head, '^(error|warning)(: )?', ''), '^.(E[0-9]+).: ', '\\1: ') || coalesce('; ' || label, '') END",
                  severity="CASE WHEN starts_with(head, 'warning') THEN 'warning' ELSE 'error' END", path="spot.p", line="CAST(spot.l AS BIGINT)", col_no="CAST(spot.c AS BIGINT)")} FROM g"""


def _java(base):
    return f"""WITH {_blocks_sql(base, r"regexp_matches(x, '^\S+\.java:[0-9]+: (error|warning): .')", "false", 6)},
  g AS (SELECT log, o, regexp_extract({_HEAD}, '^(\\S+):([0-9]+): (error|warning): (.+?)\\s*$', ['p', 'l', 's', 'm']) AS h, {_first("regexp_extract(x, 'symbol:\\s+(.+?)\\s*$', 1)", r"^\s+symbol:\s+\S")} AS sym FROM d GROUP BY log, o)
  SELECT {_row("java", "'compilation'", "h.m || coalesce(': ' || sym, '')", severity="h.s", path="h.p", line="CAST(h.l AS BIGINT)")} FROM g"""


def _java_test(base):
    frame = r"^\s+at ([a-z][\w$]*[.])*[A-Z][\w$]*([.$][\w$<>]+)*\([\w$]+[.]java:[0-9]+\)\s*$"
    mine = f"regexp_matches(x, '{frame}') AND NOT regexp_matches(x, '^\\s+at (java|javax|jdk|sun|junit|org[.]junit)[.]')"
    return f"""WITH {_blocks_sql(base, r"regexp_matches(x, '^(Exception in thread \"[^\"]*\" )?([a-z][\w$]*[.])+[A-Z][\w$]*(Error|Exception|Exit|Interrupt)(: .*)?$') OR regexp_matches(x, '^(Exception in thread \"[^\"]*\" )?([a-z][\w$]*[.])+(Error|Exception|Exit|Interrupt)(: .*)?$') AND false", "trim(x) = ''", 60)},
  g AS (SELECT log, o, regexp_replace({_HEAD}, '^Exception in thread "[^"]*" ', '') AS head, count(*) FILTER (regexp_matches(x, '^\\s+at [^()\\s]+[(].*[)]\\s*$')) AS frames,
    arg_min(regexp_extract(x, 'at (([a-z][\\w$]*[.])*)[A-Z].*[(]([^:]*):([0-9]+)[)]', ['p', 'q', 'f', 'l']), ordinal) FILTER ({mine}) AS spot FROM d GROUP BY log, o)
  SELECT {_row("java_test", "'test'", "regexp_replace(head, '\\s+$', '')", path="replace(spot.p, '.', '/') || spot.f", line="CAST(spot.l AS BIGINT)")} FROM g WHERE frames > 0"""


def _frame(base):
    at = r"^\s*(,-|╭─)\[.+:[0-9]+:[0-9]+\]\s*$"
    return f"""WITH {_blocks_sql(base, r"regexp_matches(x, '^\s+[x×] \S')", "false", 60)},
  g AS (SELECT log, o, {_first("regexp_extract(x, '\\[(.+):([0-9]+):([0-9]+)\\]', ['p', 'l', 'c'])", at)} AS spot, regexp_extract({_HEAD}, '[x×] (.+?)\\s*$', 1) AS head,
    string_agg(regexp_extract(x, '[0-9]+: (failed .+?)\\s*$', 1), '; ' ORDER BY ordinal) FILTER (regexp_matches(x, '^\\s+[0-9]+: failed ')) AS why FROM d GROUP BY log, o),
  s AS (SELECT g.log, g.o, min(d.ordinal) AS src FROM g JOIN d ON d.log = g.log AND d.o = g.o AND try_cast(regexp_extract(x, '^\\s*([0-9]+) [|│]', 1) AS BIGINT) = CAST(spot.l AS BIGINT) GROUP BY g.log, g.o),
  t AS (SELECT g.*, trim(a.x) AS src, trim(c.x) AS caret, CASE WHEN regexp_matches(p.line, '^failed to \\S') THEN rtrim(p.line) END AS pre FROM g LEFT JOIN s ON s.log = g.log AND s.o = g.o LEFT JOIN d a ON a.log = g.log AND a.o = g.o AND a.ordinal = s.src
    LEFT JOIN d c ON c.log = g.log AND c.o = g.o AND c.ordinal = s.src + 1 AND regexp_matches(c.x, '^\\s*[:·] .*\\^') LEFT JOIN {base} p ON p.log = g.log AND p.ordinal = g.o - 1 WHERE spot IS NOT NULL)
  SELECT {_row("frame", "'compilation'", "head || coalesce(chr(10) || 'SWC context: ' || coalesce(why, pre), '') || coalesce(chr(10) || src, '') || coalesce(chr(10) || caret, '')", path=_SHORT % "spot.p", line="CAST(spot.l AS BIGINT)", col_no="CAST(spot.c AS BIGINT)")} FROM t"""


def _node(base):
    said = r"regexp_matches(x, '^(Uncaught )?[A-Z][A-Za-z]*(Error|Exception|Exit|Interrupt)( \[\w+\])?: \S')"
    frame = r"^\s+at (.* \()?[^()\s][^()]*:[0-9]+:[0-9]+\)?\s*$"
    mine = f"regexp_matches(x, '{frame}') AND NOT regexp_matches(x, '^\\s+at (.* [(])?node:')"
    return f"""WITH {_blocks_sql(base, said, "trim(x) = ''", 40)},
  m AS (SELECT log, ordinal, x, opens, last_value(CASE WHEN opens OR h THEN ordinal END IGNORE NULLS) OVER (PARTITION BY log ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM (SELECT *, regexp_matches(x, '^\\S.*[.][cm]?[jt]sx?:[0-9]+\\s*$') AS h FROM b)),
  k AS (SELECT m.log, m.ordinal AS o, regexp_extract(p.x, '^(\\S.*):([0-9]+)\\s*$', ['p', 'l']) AS carried FROM m JOIN b p ON p.log = m.log AND p.ordinal = m.c AND NOT p.opens AND m.ordinal - p.ordinal <= 8 WHERE m.opens),
  g AS (SELECT log, o, regexp_replace(regexp_replace({_HEAD}, '^Uncaught ', ''), '\\s+$', '') AS head, arg_min(regexp_extract(x, '^\\s+at (?:.* [(])?([^()\\s][^()]*):([0-9]+):([0-9]+)[)]?\\s*$', ['p', 'l', 'c']), ordinal) FILTER ({mine}) AS spot FROM d GROUP BY log, o)
  SELECT g.{_row("node", "'test'", "head", path=_SHORT % "coalesce(spot.p, carried.p)", line="CAST(coalesce(spot.l, carried.l) AS BIGINT)", col_no="CAST(spot.c AS BIGINT)").replace(", o AS", ", g.o AS", 1)} FROM g LEFT JOIN k ON k.log = g.log AND k.o = g.o WHERE spot IS NOT NULL OR carried IS NOT NULL"""


def _python(base):
    return f"""WITH b AS (SELECT log, ordinal, line AS x, regexp_matches(line, 'File "[^"]+", line [0-9]+') AND NOT regexp_matches(line, 'File "(<frozen|<string|[^"]*/lib/python[0-9]|[^"]*site-packages|[^"]*_bootstrap[.]py")') AS spot,
    regexp_matches(line, '^(E\\s+)?([A-Za-z_][\\w.]*[.])?[A-Z]\\w*(Error|Exception|Exit|Interrupt)(: .*)?\\s*$') AS e FROM {base}),
  m AS (SELECT *, lag(x) OVER w AS p, lag(spot) OVER w AS pat, lag(ordinal) OVER w AS po FROM b WHERE spot OR e WINDOW w AS (PARTITION BY log ORDER BY ordinal)),
  g AS (SELECT log, ordinal AS o, regexp_extract(x, '^(?:E\\s+)?(.*?)\\s*$', 1) AS head, regexp_extract(p, 'File "([^"]+)", line ([0-9]+)', ['p', 'l']) AS spot FROM m WHERE e AND NOT spot AND pat AND ordinal - po <= 2000)
  SELECT {_row("python", "CASE WHEN regexp_matches(head, '^(SyntaxError|IndentationError|TabError)') THEN 'compilation' ELSE 'test' END", "head", path=_SHORT % "spot.p", line="CAST(spot.l AS BIGINT)")} FROM g"""


def _linkers(base):
    return f"""WITH b AS (SELECT log, ordinal AS o, line AS x, CASE WHEN regexp_matches(line, '^Undefined symbols for architecture .+:\\s*$') THEN 1 WHEN starts_with(line, 'ld: ') THEN 0 END AS mark FROM {base}),
  m AS (SELECT *, last_value(CASE WHEN mark IS NOT NULL THEN 2 * o + mark END IGNORE NULLS) OVER (PARTITION BY log ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM b),
  u AS (SELECT *, regexp_extract(x, '(^|\\s)(\\S+):([0-9]+): undefined reference to [`''"]?(.+?)[''"]?\\s*$', ['s', 'p', 'l', 'm']) AS r FROM b WHERE contains(x, 'undefined reference to '))
  SELECT {_row("symbols", "'compilation'", "'undefined symbol: ' || regexp_extract(x, '^\\s+\"(.+)\", referenced', 1)")} FROM m WHERE regexp_matches(x, '^\\s+".+", referenced from:\\s*$') AND k % 2 = 1 AND o - k // 2 <= 2000
  UNION ALL SELECT {_row("reference", "'compilation'", "'undefined reference to ' || r.m", path=_SHORT % "r.p", line="CAST(r.l AS BIGINT)")} FROM u WHERE r.l <> ''
  UNION ALL SELECT {_row("reference", "'compilation'", "'undefined reference to ' || regexp_extract(x, 'reference to [`''\"](.+?)[''\"]\\s*$', 1)")} FROM u WHERE r.l = '' AND regexp_matches(x, 'reference to [`''"].+[''"]\\s*$')
  UNION ALL SELECT {_row("external", "'compilation'", "regexp_extract(x, 'unresolved external symbol (\"[^\"]+\"|\\S+)')")} FROM b WHERE regexp_matches(x, ': (fatal )?error LNK[0-9]+: unresolved external symbol \\S')"""


def _rust_test(base):
    return f"""WITH {_blocks_sql(base, r"regexp_matches(x, '^thread ''[^'']+''.* panicked at .+:[0-9]+:[0-9]+:\s*$')", "trim(x) = '' OR regexp_matches(x, '^(note: |stack backtrace:)')", 30)},
  g AS (SELECT log, o, regexp_extract({_HEAD}, '^thread ''([^'']+)''.* panicked at (.+):([0-9]+):([0-9]+):', ['n', 'p', 'l', 'c']) AS h, string_agg(trim(x), '; ' ORDER BY ordinal) FILTER (ordinal > o) AS said FROM d GROUP BY log, o)
  SELECT {_row("rust_test", "'test'", "'Rust test ' || h.n || ' failed at ' || h.p || ':' || h.l || ':' || h.c || coalesce(': ' || said, '')", name="h.n", path="h.p", line="CAST(h.l AS BIGINT)", col_no="CAST(h.c AS BIGINT)")} FROM g"""


def _gtest(base):
    return f"""WITH {_blocks_sql(base, r"x = 'unknown file: Failure' OR regexp_matches(x, '^\S.*:[0-9]+: Failure\s*$')", "trim(x) = '' OR starts_with(x, '[')", 30)},
  n AS (SELECT log, ordinal AS o, last_value(CASE WHEN regexp_matches(x, '^\\[ RUN      \\] \\S+\\s*$') THEN regexp_extract(x, '^\\[ RUN      \\] (\\S+)', 1) WHEN regexp_matches(x, '^\\[(  FAILED  |       OK )\\]') THEN '' END IGNORE NULLS)
    OVER (PARTITION BY log ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS name FROM b),
  g AS (SELECT log, o, regexp_extract({_HEAD}, '^(\\S.*?):([0-9]+): Failure', ['p', 'l']) AS h, replace(string_agg(trim(x), '; ' ORDER BY ordinal) FILTER (ordinal > o), ':; ', ': ') AS said FROM d GROUP BY log, o)
  SELECT {_row("gtest", "'test'", "'C++ test ' || name || ' failed' || coalesce(': ' || said, '')", name="name", path="nullif(h.p, '')", line="CAST(nullif(h.l, '') AS BIGINT)")} FROM g JOIN n USING (log, o) WHERE name <> ''"""


def _go(base):
    name = r"last_value(coalesce(nullif(regexp_extract(x, '^\s*=== (RUN|CONT|NAME)\s+(\S+)\s*$', 2), ''), nullif(regexp_extract(x, '^\s*--- (FAIL|PASS|SKIP): (\S+) \(', 2), '')) IGNORE NULLS) OVER (PARTITION BY log ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""WITH {_blocks_sql(base, r"regexp_matches(x, '^\s+[^\s:/]+[.]go:[0-9]+:( .*)?$')", "NOT regexp_matches(x, '^\\s{8,}\\S')", 30)},
  n AS (SELECT log, ordinal AS o, x, {name} AS name FROM b),
  e AS (SELECT log, o, regexp_extract({_HEAD}, '^\\s+([^\\s:/]+[.]go):([0-9]+):(?: (.*?))?\\s*$', ['p', 'l', 'm']) AS h, string_agg(trim(x), '; ' ORDER BY ordinal) FILTER (ordinal > o) AS more FROM d GROUP BY log, o),
  i AS (SELECT log, name, arg_min(struct_pack(p := h.p, l := h.l, m := concat_ws('; ', nullif(h.m, ''), more)), o) AS v FROM e JOIN n USING (log, o) WHERE name IS NOT NULL GROUP BY log, name),
  pb AS (SELECT log, ordinal, x, max(CASE WHEN starts_with(x, 'panic: ') THEN ordinal END) OVER (PARTITION BY log ORDER BY ordinal) AS o FROM b),
  pa AS (SELECT log, o, regexp_replace(regexp_extract(arg_min(x, ordinal), '^panic: (.+?)\\s*$', 1), ' \\[recovered[^\\]]*\\]$', '') AS m,
    arg_min(regexp_extract(x, '^\\s+(/\\S+[.]go):([0-9]+)', ['p', 'l']), ordinal) FILTER (regexp_matches(x, '^\\s+/\\S+[.]go:[0-9]+( \\+0x[0-9a-f]+)?\\s*$') AND NOT regexp_matches(x, '^\\s+/usr/local/go/src/')) AS spot FROM pb WHERE ordinal - o <= 200 GROUP BY log, o),
  p AS (SELECT log, name, arg_min(struct_pack(m := m, spot := spot), o) AS v FROM pa JOIN n USING (log, o) WHERE name IS NOT NULL GROUP BY log, name),
  f AS (SELECT log, regexp_extract(x, '--- FAIL: (\\S+) \\(', 1) AS name, min(ordinal) AS o FROM b WHERE regexp_matches(x, '^\\s*--- FAIL: \\S+ \\(') GROUP BY ALL)
  SELECT f.log, f.o AS ordinal, CASE WHEN p.v IS NOT NULL THEN 'go_panic' WHEN i.v IS NOT NULL THEN 'go' ELSE 'go_fail' END AS form, f.name, 'error' AS severity, 'test' AS category,
    'Go test ' || f.name || CASE WHEN p.v IS NOT NULL THEN ' panicked' || coalesce(' at ' || {_SHORT % "p.v.spot.p"} || ':' || p.v.spot.l, '') || ': ' || p.v.m WHEN i.v IS NOT NULL THEN ' failed at ' || i.v.p || ':' || i.v.l || coalesce(': ' || nullif(i.v.m, ''), '') ELSE ' failed' END AS message,
    CASE WHEN p.v IS NOT NULL THEN {_SHORT % "p.v.spot.p"} ELSE i.v.p END AS path, CAST(CASE WHEN p.v IS NOT NULL THEN p.v.spot.l ELSE i.v.l END AS BIGINT) AS line, CAST(NULL AS BIGINT) AS col_no
  FROM f LEFT JOIN i ON i.log = f.log AND i.name = f.name LEFT JOIN p ON p.log = f.log AND p.name = f.name"""


def _query(*forms):
    return lambda spark, sf_dir: blocks.block_diagnostics(_log_lines(spark, sf_dir), "log", {k: blocks.FORMS[k] for k in forms})


def _all(base, *parts):
    return " UNION ALL ".join(f"SELECT * FROM ({p(base)})" for p in parts)


def k10_test_failures(spark, sf_dir):
    return blocks.test_failures(_log_lines(spark, sf_dir), "log")


def k01_tool_lines(spark, sf_dir):
    return logs.tool_diagnostics(_log_lines(spark, sf_dir), "log")


def k08_summary(spark, sf_dir):
    return logs.summary(_log_lines(spark, sf_dir), "log")


_STRIP = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"
_ERRORLESS = "contains(low, 'root_cause') AND NOT contains(low, 'error:') AND NOT contains(low, 'error[') AND NOT (starts_with(low, 'test ') AND ends_with(low, ' ... ok'))"


def _tool_lines(base: str) -> str:
    """CTE l: each line with what the build tool's parsers read in it."""
    return rf"""l0 AS (SELECT *, {_STRIP} AS t, lower({_STRIP}) AS low, regexp_replace({_STRIP}, '^ERROR: ', '') AS y FROM {base}),
l1 AS (SELECT *, y = 'Traceback (most recent call last):' AS head, (starts_with(t, 'Error in ') OR starts_with(t, 'Error: ')) AS err,
  CASE WHEN NOT regexp_matches(t, '^(DEBUG|INFO): ') AND regexp_matches(y, '^.*(\.bzl|\.bazel|[/\\]BUILD|[/\\]WORKSPACE):[0-9]+:') THEN regexp_extract(y, '^(.*(?:\.bzl|\.bazel|[/\\]BUILD|[/\\]WORKSPACE)):([0-9]+):(?:([0-9]+):)?\s*(.*)$', ['p', 'l', 'c', 'm']) END AS i,
  CASE WHEN regexp_matches(line, 'File "[^"]*(\.bzl|\.bazel|/BUILD|/WORKSPACE)", line [0-9]+') THEN regexp_extract(line, 'File "([^"]*)", line ([0-9]+)(?:, column ([0-9]+))?', ['p', 'l', 'c']) END AS f,
  CASE WHEN regexp_matches(t, '^(🚨|⚠️|⚠|ℹ️|ℹ) [^·—]+:[0-9]+ (· |— )') THEN regexp_extract(t, '^(🚨|⚠️|⚠|ℹ️|ℹ) ([^·—]+?)(?: · ([^·—]*?))?(?: · ([^·—]*?))? — (.+)$', ['s', 'p', 'tool', 'rule', 'm']) END AS lint,
  CASE WHEN regexp_matches(t, '^[^:]*\.go: import of "[^"]') THEN regexp_extract(t, '^([^:]*\.go): import of "([^"]*)', ['p', 'm']) END AS strict FROM l0),
l AS (SELECT *, CASE WHEN i IS NULL THEN NULL WHEN (starts_with(lower(i.m), 'in ') AND contains(lower(i.m), ' rule //')) OR contains(lower(i.m), 'analysis of target') OR contains(lower(i.m), 'aspect on target') THEN 'analysis' ELSE 'loading' END AS icat,
  contains(i.m, concat('name ', chr(39))) AND contains(i.m, ' is not defined') AS cause,
  CASE WHEN starts_with(low, 'test ') AND ends_with(low, ' ... ok') THEN NULL WHEN contains(low, 'root_cause') AND NOT contains(low, 'error:') AND NOT contains(low, 'error[') THEN 'test' WHEN contains(low, 'no such package') OR contains(low, 'no such target') THEN 'loading'
    WHEN contains(low, 'visibility') AND contains(low, 'error') THEN 'visibility' WHEN contains(low, 'analysis') AND (contains(low, 'error') OR contains(low, 'fail')) THEN 'analysis' WHEN contains(low, 'missing strict dependencies') THEN 'compilation' END AS fallback FROM l1)"""


_TOOL = rf"""k AS (SELECT *, CASE WHEN i IS NOT NULL THEN i.p WHEN f IS NOT NULL THEN f.p END AS p, CASE WHEN i IS NOT NULL THEN i.l WHEN f IS NOT NULL THEN f.l END AS n, CASE WHEN i IS NOT NULL THEN i.c WHEN f IS NOT NULL THEN f.c END AS c,
  CASE WHEN head AND starts_with(t, 'ERROR:') THEN 'loading' ELSE icat END AS cat FROM l WHERE head OR i IS NOT NULL OR f IS NOT NULL OR err),
kw AS (SELECT *, lag(p) OVER o AS lp, lag(n) OVER o AS ln, lag(c) OVER o AS lc, coalesce(last_value(cat IGNORE NULLS) OVER (PARTITION BY log ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'loading') AS lcat FROM k WINDOW o AS (PARTITION BY log ORDER BY ordinal)),
context AS (SELECT log, CASE WHEN bool_or(icat = 'analysis') THEN 'analysis' ELSE 'loading' END AS context FROM l WHERE head OR f IS NOT NULL OR i IS NOT NULL GROUP BY log),
u AS (SELECT log, line, count(*) AS n, min(ordinal) AS ordinal, any_value(t) AS t, any_value(low) AS low, any_value(lint) AS lint, any_value(strict) AS strict, any_value(i) AS i, any_value(cause) AS cause, any_value(fallback) AS fallback FROM l WHERE NOT head AND f IS NULL AND NOT err GROUP BY log, line),
v AS (SELECT u.*, context FROM u LEFT JOIN context USING (log)),
tool AS (
  SELECT log, 0 AS phase, ordinal, CASE WHEN err OR NOT contains(lower(i.m), 'warning:') THEN 'error' ELSE 'warning' END AS severity, CASE WHEN err THEN lcat ELSE icat END AS category, CASE WHEN err THEN t ELSE i.m END AS message,
    {_SHORT % "CASE WHEN err THEN lp ELSE i.p END"} AS path, TRY_CAST(CASE WHEN err THEN ln ELSE i.l END AS BIGINT) AS line, TRY_CAST(nullif(CASE WHEN err THEN lc ELSE i.c END, '') AS BIGINT) AS col_no, CAST(1 AS BIGINT) AS repetition_count FROM kw WHERE (err AND NOT head AND i IS NULL AND f IS NULL) OR (NOT head AND cause)
  UNION ALL SELECT log, 1, ordinal, CASE WHEN lint IS NOT NULL THEN CASE lint.s[1:1] WHEN '🚨' THEN 'error' WHEN '⚠' THEN 'warning' ELSE 'note' END WHEN strict IS NOT NULL THEN 'error' WHEN contains(low, 'warning:') AND (i IS NULL OR contains(lower(i.m), 'warning:')) AND NOT (context IS NOT NULL AND i IS NULL AND {_ERRORLESS}) THEN 'warning' ELSE 'error' END,
    CASE WHEN lint IS NOT NULL OR strict IS NOT NULL THEN 'compilation' WHEN i IS NOT NULL AND NOT cause THEN CASE WHEN contains(low, 'visibility') THEN 'visibility' WHEN contains(low, 'analysis') THEN 'analysis' ELSE 'compilation' END WHEN context IS NOT NULL AND {_ERRORLESS} THEN context ELSE fallback END,
    CASE WHEN lint IS NOT NULL THEN coalesce(nullif(concat_ws(' ', nullif(lint.tool, ''), '[' || nullif(lint.rule, '') || ']'), '') || ': ', '') || trim(lint.m) WHEN strict IS NOT NULL THEN 'missing strict dependency: ' || {_SHORT % "strict.p"} || ' imports "' || strict.m || '"; add its target to deps' ELSE t END,
    CASE WHEN lint IS NOT NULL THEN regexp_replace(lint.p, '(:[0-9]+){{1,2}}$', '') WHEN strict IS NOT NULL THEN {_SHORT % "strict.p"} END, CASE WHEN lint IS NOT NULL THEN CAST(regexp_extract(lint.p, ':([0-9]+)(:[0-9]+)?$', 1) AS BIGINT) END, CASE WHEN lint IS NOT NULL THEN TRY_CAST(regexp_extract(lint.p, ':[0-9]+:([0-9]+)$', 1) AS BIGINT) END, n
  FROM v WHERE lint IS NOT NULL OR strict IS NOT NULL OR (i IS NOT NULL AND NOT cause) OR (context IS NOT NULL AND {_ERRORLESS}) OR fallback IS NOT NULL)"""

_SINGLE = r"""single AS (SELECT log, ordinal, CASE WHEN r IS NULL AND NOT failed AND NOT bad THEN 'warning' ELSE coalesce(nullif(replace(r.s, 'fatal ', ''), ''), 'error') END AS severity, CASE WHEN r IS NULL AND failed THEN 'test' ELSE 'compilation' END AS category,
  CASE WHEN r IS NULL THEN t ELSE r.m END AS message, r.p AS path, CAST(r.l AS BIGINT) AS line, CAST(r.c AS BIGINT) AS col_no FROM (SELECT log, ordinal, t, low,
  CASE WHEN regexp_matches(line, '^[^\s(]+\.tsx?\([0-9]+,[0-9]+\): (error|warning) TS[0-9]+: ') THEN regexp_extract(line, '^([^\s(]+)\(([0-9]+),([0-9]+)\): (error|warning) (.+)$', ['p', 'l', 'c', 's', 'm'])
    WHEN regexp_matches(line, '^[^\s:]+\.(cc|cpp|c|h|hpp|hh|cxx|m|mm):[0-9]+:[0-9]+: (error|warning|fatal error): ') THEN regexp_extract(line, '^([^\s:]+):([0-9]+):([0-9]+): (error|warning|fatal error): (.+)$', ['p', 'l', 'c', 's', 'm'])
    WHEN regexp_matches(line, '^[^\s:]+\.(proto|go):[0-9]+:[0-9]+: .') THEN regexp_extract(line, '^([^\s:]+):([0-9]+):([0-9]+): ()(.+)$', ['p', 'l', 'c', 's', 'm']) END AS r,
  regexp_matches(line, '^\s*test \S.* \.\.\. FAILED\s*$') OR regexp_matches(line, '^\s*thread ''.* panicked at ') OR regexp_matches(line, 'assertion .* failed') AS failed,
  regexp_matches(low, '(^|\W)(fatal|error(\[\w+\])?):') AS bad, regexp_matches(low, '(^|\W)warning:') AS warns FROM rest
  WHERE NOT regexp_matches(line, '^(error|warning)(\[E[0-9]+\])?: .') AND NOT regexp_matches(line, '^\S+\.java:[0-9]+: (error|warning): .') AND NOT regexp_matches(line, '^(Exception in thread "[^"]*" )?([a-z][\w$]*[.])+[A-Z][\w$]*(Error|Exception|Exit|Interrupt)(: .*)?\s*$')
    AND NOT (contains(line, 'undefined reference to ') AND regexp_matches(line, 'undefined reference to [`''"].+[''"]\s*$')) AND NOT regexp_matches(line, '(^|\s)\S+:[0-9]+: undefined reference to .') AND NOT regexp_matches(line, ': (fatal )?error LNK[0-9]+: unresolved external symbol \S') AND NOT regexp_matches(line, '^(unknown file|\S.*:[0-9]+): Failure\s*$')) WHERE r IS NOT NULL OR failed OR bad OR warns)"""

_FORMS = (_rust, _java, _java_test, _frame, _node, _python, _linkers, _rust_test, _gtest, _go)
_TURN = "CASE form " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate("rust java java_test frame node python symbols reference external rust_test gtest go go_fail go_panic".split(), 1)) + " END"
_K01 = f"WITH {_tool_lines(LINES)}, {_TOOL} SELECT * FROM tool"
_K08 = rf"""WITH RECURSIVE lines AS MATERIALIZED (SELECT * FROM {LINES}), {_tool_lines("lines")}, {_TOOL},
rest AS MATERIALIZED (SELECT log, ordinal, line, t, low FROM l WHERE NOT (head OR err OR starts_with(low, 'debug:') OR starts_with(low, 'info:') OR low = 'error: build did not complete successfully' OR lint IS NOT NULL OR strict IS NOT NULL OR i IS NOT NULL OR f IS NOT NULL OR fallback IS NOT NULL)),
{_SINGLE},
many AS ({_all("rest", *_FORMS)}),
a AS (SELECT log, phase * 1125899906842624 + ordinal * 32 AS ordinal, severity, category, message, path, line, col_no, repetition_count FROM tool WHERE NOT (contains(lower(message), 'error executing ') AND contains(lower(message), ' command') AND log IN (SELECT log FROM many WHERE form = 'frame'))
  UNION ALL SELECT log, 2 * 1125899906842624 + ordinal * 32, severity, category, message, path, line, col_no, 1 FROM single
  UNION ALL SELECT log, 2 * 1125899906842624 + ordinal * 32 + {_TURN}, severity, category, message, path, line, col_no, 1 FROM many),
g AS (SELECT log, severity, category, message, path, line, col_no, CAST(least(sum(repetition_count), 4294967295) AS BIGINT) AS repetition_count, min(ordinal) AS ordinal FROM a GROUP BY ALL),
r AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY log) AS n, row_number() OVER (PARTITION BY log ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, CASE category WHEN 'test' THEN 1 ELSE 0 END,
  CASE WHEN path IS NOT NULL OR (contains(lower(message), 'root_cause') AND NOT contains(lower(message), 'error executing')) THEN 0 WHEN category = 'test' AND (contains(lower(message), 'panicked at') OR (contains(lower(message), 'assertion') AND contains(lower(message), ' failed'))) THEN 1
    WHEN regexp_matches(lower(message), '^(test failed:|test timed out:|test was incomplete:|test result was unavailable:)') THEN 3 WHEN contains(lower(message), 'error executing') THEN 2 ELSE 1 END, ordinal) - 1 AS rank, CAST(strlen(message) AS BIGINT) AS size FROM g),
w AS (SELECT log, rank, CASE WHEN size <= 4096 THEN size ELSE 0 END AS used, size <= 4096 AS kept FROM r WHERE rank = 0
  UNION ALL SELECT r.log, r.rank, CASE WHEN w.used + r.size <= 4096 THEN w.used + r.size ELSE w.used END, w.used + r.size <= 4096 FROM w JOIN r ON r.log = w.log AND r.rank = w.rank + 1 WHERE r.rank < 20),
z AS (SELECT r.*, n > sum(CASE WHEN kept THEN 1 ELSE 0 END) OVER (PARTITION BY r.log) AS truncated, kept FROM r JOIN w ON r.log = w.log AND r.rank = w.rank)
SELECT log, severity, category, message, path, line, col_no, repetition_count, rank, truncated, 'Bazel failed: ' || first_value(message) OVER (PARTITION BY log ORDER BY rank) AS headline, CASE WHEN truncated THEN 'diagnostics' END AS inspect_hint FROM z WHERE kept"""


_TESTS = (_java_test, _node, _python, _rust_test, _gtest, _go)
_K10 = f"""WITH a AS ({_all(LINES, *_TESTS)}),
u AS (SELECT log, name, message, path, line, col_no, min(ordinal) AS o FROM a GROUP BY ALL),
r AS (SELECT * EXCLUDE o, row_number() OVER (PARTITION BY log ORDER BY path IS NULL, o, message, path, line) - 1 AS rank FROM u)
SELECT * FROM r WHERE rank < 20"""

QUERIES = {
    "k21_linkers": (_query("symbols", "reference", "external"), _linkers(LINES)),
    "k22_rust": (_query("rust"), _rust(LINES)),
    "k24_java": (_query("java", "java_test"), _all(LINES, _java, _java_test)),
    "k26_source_frames": (_query("frame"), _frame(LINES)),
    "k27_node": (_query("node"), _node(LINES)),
    "k29_python": (_query("python"), _python(LINES)),
    "k30_test_logs": (_query("rust_test", "gtest", "go", "go_fail", "go_panic"), _all(LINES, _rust_test, _gtest, _go)),
    "k10_test_failures": (k10_test_failures, _K10),
    "k01_tool_lines": (k01_tool_lines, _K01),
    "k08_summary": (k08_summary, _K08),
}
