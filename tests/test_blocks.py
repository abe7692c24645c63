"""Blocks of lines against hand-written expectations: whole, cut off, and interleaved."""

from __future__ import annotations

import pytest

from ledgerflow.operators import blocks as B

SANDBOX = "/tmp/out/execroot/_main"
RUNFILES = "/tmp/out/bin/t.runfiles/_main"
#: text of a log, and (form, category, message, path, line, column) of what it tells.
CASES = {
    "rust": ("""error[E0277]: cannot add `&str` to `u8`
  --> src/sum.rs:14:9
   |
14 |     let a = 1u8 + "x";
   |                 ^ no implementation for `u8 + &str`
   |
   = help: implement it

warning: unused variable: `b`
 --> src/sum.rs:3:5
  |
3 |     let b = 1;
  |         ^ help: prefix it
error: could not compile `sum`
""", [("rust", "compilation", "E0277: cannot add `&str` to `u8`; no implementation for `u8 + &str`", "src/sum.rs", 14, 9),
      ("rust", "compilation", "unused variable: `b`; help: prefix it", "src/sum.rs", 3, 5), ("rust", "compilation", "error: could not compile `sum`", None, None, None)]),
    "java": ("""lib/Total.java:8: error: cannot find symbol
        return Rates.of(1);
               ^
  symbol:   variable Rates
  location: class Total
lib/Total.java:9: warning: [removal] stop() is deprecated
  a.stop();
""", [("java", "compilation", "cannot find symbol: variable Rates", "lib/Total.java", 8, None), ("java", "compilation", "[removal] stop() is deprecated", "lib/Total.java", 9, None)]),
    "java_test": ("""Exception in thread "main" java.lang.IllegalStateException: no rate
\tat java.base/java.util.Map.of(Map.java:3)
\tat org.junit.Assert.fail(Assert.java:89)
\tat shop.tax.Rates$Inner.find(Rates.java:44)
\tat shop.tax.Main.main(Main.java:5)
""", [("java_test", "test", "java.lang.IllegalStateException: no rate", "shop/tax/Rates.java", 44, None)]),
    "frame": (f"""failed to process the bundle
  x Expected a semicolon
   ,-[{SANDBOX}/web/cart.ts:2:7]
 1 | const a = 1;
 2 | const b c = 2;
   :         ^
 3 | end
   `----
  × Unknown plugin
   ╭─[{RUNFILES}/web/side.tsx:5:1]
 5 │ export default Price
   ╰───
Caused by:
    0: failed to invoke plugin on 'web/side.tsx'
    1: Syntax Error
  x no place, no block
""", [("frame", "compilation", "Expected a semicolon\nSWC context: failed to process the bundle\n2 | const b c = 2;\n:         ^", "web/cart.ts", 2, 7),
      ("frame", "compilation", "Unknown plugin\nSWC context: failed to invoke plugin on 'web/side.tsx'\n5 │ export default Price", "web/side.tsx", 5, 1)]),
    "node": (f"""{RUNFILES}/web/cart.js:7
  total(undefined.rows);
                  ^

TypeError: Cannot read properties of undefined (reading 'rows')
    at total ({RUNFILES}/web/cart.js:7:19)
    at Module._compile (node:internal/modules/cjs/loader:1:1)

{RUNFILES}/web/bad.cjs:3
let let = 1;
    ^

SyntaxError: let is disallowed as a lexically bound name
    at wrap (node:internal/vm:1:1)

RangeError: stands alone
""", [("node", "test", "TypeError: Cannot read properties of undefined (reading 'rows')", "web/cart.js", 7, 19), ("node", "test", "SyntaxError: let is disallowed as a lexically bound name", "web/bad.cjs", 3, None)]),
    "python": (f"""Traceback (most recent call last):
  File "/opt/lib/python3.11/runpy.py", line 5, in run
  File "{RUNFILES}/shop/_tax_stage2_bootstrap.py", line 9, in <module>
  File "{RUNFILES}/shop/tax_test.py", line 31, in test_rate
    self.assertEqual(rate(), 2)
  File "<frozen runpy>", line 3, in x
AssertionError: 1 != 2
ValueError: no place is left
  File "shop/tax.py", line 4
    rate = {{
SyntaxError: '{{' was never closed
shop.Boom: x
E       shop.errors.RateError: none
  File "shop/other.py", line 8, in f
E       KeyError: 'vat'
""", [("python", "test", "AssertionError: 1 != 2", "shop/tax_test.py", 31, None), ("python", "compilation", "SyntaxError: '{' was never closed", "shop/tax.py", 4, None), ("python", "test", "KeyError: 'vat'", "shop/other.py", 8, None)]),
    "linkers": (f"""Undefined symbols for architecture x86_64:
  "rate(int)", referenced from:
      _main in a.o
  "vat()", referenced from:
      _main in a.o
ld: symbol(s) not found for architecture x86_64
  "late()", referenced from:
/usr/bin/ld: a.o: {SANDBOX}/cc/rate.cc:12: undefined reference to `rate(int)'
collect2: undefined reference to `vtable'
rate.obj : error LNK2019: unresolved external symbol "int __cdecl rate(int)" referenced in function main
""", [("symbols", "compilation", "undefined symbol: rate(int)", None, None, None), ("symbols", "compilation", "undefined symbol: vat()", None, None, None),
      ("reference", "compilation", "undefined reference to rate(int)", "cc/rate.cc", 12, None), ("reference", "compilation", "undefined reference to vtable", None, None, None),
      ("external", "compilation", 'unresolved external symbol "int __cdecl rate(int)"', None, None, None)]),
    "rust_test": ("""running 1 test
test rate ... FAILED
thread 'rate' <PID> panicked at src/rate.rs:9:5:
assertion `left == right` failed: rates differ
  left: 1
 right: 2
note: run with `RUST_BACKTRACE=1`
thread 'other' panicked at src/o.rs:1:2:
boom
""", [("rust_test", "test", "Rust test rate failed at src/rate.rs:9:5: assertion `left == right` failed: rates differ; left: 1; right: 2", "src/rate.rs", 9, 5),
      ("rust_test", "test", "Rust test other failed at src/o.rs:1:2: boom", "src/o.rs", 1, 2)]),
    "gtest": ("""cc/early_test.cc:1: Failure
no test runs yet
[ RUN      ] Rates.Vat
cc/rates_test.cc:20: Failure
Expected equality of these values:
  Vat(1)
    Which is: 3
  4

cc/rates_test.cc:21: Failure
second
[  FAILED  ] Rates.Vat (0 ms)
[ RUN      ] Rates.Throws
unknown file: Failure
C++ exception with description "none" thrown in the test body.
[  FAILED  ] Rates.Throws (0 ms)
""", [("gtest", "test", "C++ test Rates.Vat failed: Expected equality of these values: Vat(1); Which is: 3; 4", "cc/rates_test.cc", 20, None), ("gtest", "test", "C++ test Rates.Vat failed: second", "cc/rates_test.cc", 21, None),
      ("gtest", "test", 'C++ test Rates.Throws failed: C++ exception with description "none" thrown in the test body.', None, None, None)]),
    "go": ("""=== RUN   TestRate
    rate_test.go:18: got 4; want 5
--- FAIL: TestRate (0.00s)
=== RUN   TestFine
    rate_test.go:3: only a log
--- PASS: TestFine (0.00s)
=== RUN   TestTable
=== RUN   TestTable/vat
    table_test.go:31:
        got: "a"
        want: "b"
--- FAIL: TestTable (0.00s)
    --- FAIL: TestTable/vat (0.00s)
--- FAIL: TestLate (0.00s)
    late_test.go:9: told after its mark
""", [("go", "test", "Go test TestRate failed at rate_test.go:18: got 4; want 5", "rate_test.go", 18, None), ("go_fail", "test", "Go test TestTable failed", None, None, None),
      ("go", "test", 'Go test TestTable/vat failed at table_test.go:31: got: "a"; want: "b"', "table_test.go", 31, None), ("go", "test", "Go test TestLate failed at late_test.go:9: told after its mark", "late_test.go", 9, None)]),
    "go_panic": (f"""=== RUN   TestQueue
--- FAIL: TestQueue (0.00s)
panic: closed [recovered, repanicked]

goroutine 7 [running]:
testing.tRunner.func1()
    /usr/local/go/src/testing/testing.go:18 +0x2
shop.TestQueue(...)
    {SANDBOX}/shop/queue_test.go:57 +0x45
""", [("go_panic", "test", "Go test TestQueue panicked at shop/queue_test.go:57: closed", "shop/queue_test.go", 57, None)]),
}


def logs(spark, texts):
    """A row for each line, in no order."""
    rows = [(k, i, x) for k, text in texts.items() for i, x in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows[::-1], "log string, ordinal long, line string").repartition(5)


def told(rows):
    return [(r.form, r.category, r.message, r.path, r.line, r.col_no) for r in sorted(rows, key=lambda r: r.ordinal)]


def test_forms(spark):
    got = B.block_diagnostics(logs(spark, {k: t for k, (t, _) in CASES.items()}), "log").collect()
    for k, (_, want) in CASES.items():
        assert told(r for r in got if r.log == k) == want, k
    assert [r.severity for r in sorted(got, key=lambda r: r.ordinal) if r.log == "rust"] == ["error", "warning", "error"]


def test_any_two_forms_interleave(spark):
    """Lines of two logs in turn give what each gives: a form sees its own lines only. Forms
    that take every line for a note, or that a blank or plain line ends, are left out."""
    plain = ["java", "frame", "python", "linkers", "go_panic"]
    texts = {}
    for a in plain:
        for b in plain:
            if a < b:
                x, y = (CASES[k][0].rstrip("\n").split("\n") for k in (a, b))
                n = max(len(x), len(y))
                texts[a, b] = "\n".join(z for p in zip(x + [""] * n, y + [""] * n) for z in p)
    got = B.block_diagnostics(logs(spark, {f"{a} {b}": t for (a, b), t in texts.items()}), "log").collect()
    for a, b in texts:
        ours = [r for r in got if r.log == f"{a} {b}"]
        want = CASES[a][1] + CASES[b][1]
        # A frame's carried line, source and caret stand just before or below in its own log only.
        key = lambda r: (r[0], r[3], r[4], r[5]) if r[0] == "frame" else r
        assert sorted(map(str, map(key, told(ours)))) == sorted(map(str, map(key, want))), (a, b)


@pytest.mark.parametrize("reach,chunk", [(40, 40), (40, 41), (40, 57)])
def test_chunks_change_nothing(spark, monkeypatch, reach, chunk):
    monkeypatch.setattr(B, "REACH", reach)
    text = "\n".join(t for t, _ in CASES.values())
    lines = logs(spark, {"all": text})
    want = sorted(map(str, B.block_diagnostics(lines, "log").collect()))
    assert sorted(map(str, B.block_diagnostics(lines, "log", chunk=chunk).collect())) == want and len(want) > 20


def test_unfinished_blocks_are_cut(spark):
    lines = ["error[E1]: a", *["x"] * 70, " --> late.rs:1:1", "thread 't' panicked at a.rs:1:1:", *[f"n{k}" for k in range(90)]]
    got = B.block_diagnostics(logs(spark, {"l": "\n".join(lines)}), "log").collect()
    rust, test = sorted(got, key=lambda r: r.ordinal)
    assert rust.message == "error[E1]: a" and rust.path is None
    assert test.message.endswith("; n29") and "n30" not in test.message


def test_long_frames_are_bounded(spark):
    text = f"  x Bad\n   ,-[a.ts:1:1]\n 1 | {'é' * 2000}\n   : ^"
    r = B.block_diagnostics(logs(spark, {"l": text}), "log").first()
    assert len(r.message.encode()) <= 600 and "…" in r.message and r.message.endswith(": ^")


def test_failures_of_a_log(spark):
    retry = CASES["go"][0] * 3
    many = "\n".join(f"=== RUN   T{k}\n    a_test.go:{k}: m\n--- FAIL: T{k} (0s)" for k in range(30))
    got = B.test_failures(logs(spark, {"retry": retry, "many": many, "none": "fine\n", "gtest": CASES["gtest"][0]}), "log").collect()
    of = lambda k: [(r.name, r.path) for r in sorted(got, key=lambda r: r["rank"]) if r.log == k]
    assert of("retry") == [("TestRate", "rate_test.go"), ("TestTable/vat", "table_test.go"), ("TestLate", "late_test.go"), ("TestTable", None)]
    assert of("many") == [(f"T{k}", "a_test.go") for k in range(20)] and of("none") == []
    assert of("gtest") == [("Rates.Vat", "cc/rates_test.cc"), ("Rates.Vat", "cc/rates_test.cc"), ("Rates.Throws", None)]


def test_nulls_and_none(spark):
    rows = [(None, 0, "=== RUN   T"), (None, 1, "    a_test.go:1: m"), (None, 2, "--- FAIL: T (0s)"), ("a", 0, None), ("a", None, "error: x"), ("a", 1, "")]
    got = B.block_diagnostics(spark.createDataFrame(rows, "log string, ordinal long, line string"), "log").collect()
    assert [(r.log, r.message) for r in got] == [(None, "Go test T failed at a_test.go:1: m")]
    assert B.block_diagnostics(spark.createDataFrame([], "log string, ordinal long, line string"), "log").count() == 0
