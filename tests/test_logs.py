"""Whole logs against hand-written diagnostics."""

from __future__ import annotations

from ledgerflow.operators import logs
from tests.test_blocks import SANDBOX
from tests.test_blocks import logs as lines_of

LOGS = {
    "rules": ("""INFO: Analyzed target //a:a
ERROR: pkg/BUILD:4:9: name 'rate' is not defined
ERROR: pkg/BUILD:4:9: Building x failed: visibility of y
ERROR: Traceback (most recent call last):
  File "pkg/defs.bzl", line 7, column 3, in _impl
    fail("no")
Error in fail: no rates
custom_root_cause in rates
custom_root_cause in rates
ERROR: Build did NOT complete successfully
""", [("loading", "name 'rate' is not defined", "pkg/BUILD", 4, 1), ("loading", "Error in fail: no rates", "pkg/defs.bzl", 7, 1),
      ("loading", "custom_root_cause in rates", None, None, 2), ("visibility", "ERROR: pkg/BUILD:4:9: Building x failed: visibility of y", None, None, 1)]),
    "no_rules": ("custom_root_cause in rates\ntest my_root_cause ... ok\nfailures:\n", [("test", "custom_root_cause in rates", None, None, 1)]),
    "analysis": ("pkg/BUILD:1:1: in my_rule rule //a:b: bad\n  root_cause here\n", [("analysis", "root_cause here", None, None, 1), ("compilation", "pkg/BUILD:1:1: in my_rule rule //a:b: bad", None, None, 1)]),
    "go": ("INFO: Analyzed\nERROR: Build did NOT complete successfully\nshop/rate.go:12:40: cannot use 4 as string\n", [("compilation", "cannot use 4 as string", "shop/rate.go", 12, 1)]),
    "strict": (f"""ERROR: compile failed
compilepkg: missing strict dependencies:
{SANDBOX}/shop/rate.go: import of "ex.org/vat"
No dependencies were provided.
""", [("compilation", 'missing strict dependency: shop/rate.go imports "ex.org/vat"; add its target to deps', "shop/rate.go", None, 1), ("compilation", "compilepkg: missing strict dependencies:", None, None, 1), ("compilation", "ERROR: compile failed", None, None, 1)]),
    "noise": ("warning: twice\nwarning: twice\nrate.cc:7: error: bad type\n", [("compilation", "rate.cc:7: error: bad type", None, None, 1), ("compilation", "warning: twice", None, None, 2)]),
    "frames": (f"""ERROR: {SANDBOX}/pkg/BUILD.bazel:2:1: Compiling failed: error executing Swc command
\x1b[31m  x Expected a semicolon\x1b[0m
   ,-[\x1b[36m{SANDBOX}/web/cart.ts:2:7\x1b[0m]
 2 | const b c = 2;
   :         ^
ERROR: Build did NOT complete successfully
""", [("compilation", "Expected a semicolon\n2 | const b c = 2;\n:         ^", "web/cart.ts", 2, 1)]),
    "rust": ("""error[E0308]: mismatched types
 --> a.rs:2:28
  |
2 |     let x: u8 = "";
  |                 ^^ expected `u8`
error: aborting due to 1 previous error
""", [("compilation", "E0308: mismatched types; expected `u8`", "a.rs", 2, 1), ("compilation", "error: aborting due to 1 previous error", None, None, 1)]),
    "python": ("""Traceback (most recent call last):
  File "/opt/lib/python3.11/py_compile.py", line 144, in compile
  File "shop/tax_test.py", line 6
    rates = {
SyntaxError: '{' was never closed
py_compile.PyCompileError:   File "shop/tax_test.py", line 6
SyntaxError: '{' was never closed
""", [("compilation", "SyntaxError: '{' was never closed", "shop/tax_test.py", 6, 2)]),
    "tests": ("test a::root_cause ... ok\ntest a::fails ... FAILED\nfailures:\nthread 'a::fails' panicked at a.rs:7:9:\nassertion `l == r` failed\n",
              [("test", "Rust test a::fails failed at a.rs:7:9: assertion `l == r` failed", "a.rs", 7, 1), ("test", "test a::fails ... FAILED", None, None, 1),
               ("test", "thread 'a::fails' panicked at a.rs:7:9:", None, None, 1), ("test", "assertion `l == r` failed", None, None, 1)]),
    "clean": ("all is well\n\n", []),
}


def test_logs(spark):
    got = logs.summary(lines_of(spark, {k: t for k, (t, _) in LOGS.items()}), "log").collect()
    for k, (_, want) in LOGS.items():
        rows = sorted((r for r in got if r.log == k), key=lambda r: r["rank"])
        told = [(r.category, r.message, r.path, r.line, r.repetition_count) for r in rows]
        assert sorted(map(str, told)) == sorted(map(str, want)), k
        # Located diagnostics come first, warnings last; the first one is the headline.
        assert told[:1] == want[:1] and {r.headline for r in rows} <= {f"Bazel failed: {want[0][1]}" if want else None}, k
        assert not any(r.truncated or r.inspect_hint for r in rows)


def test_budget(spark):
    text = "\n".join(f"a.go:{k}:1: message {k}" for k in range(30))
    rows = logs.summary(lines_of(spark, {"l": text}), "log", items=5, most=25).collect()
    assert [(r["rank"], r.message) for r in sorted(rows, key=lambda r: r["rank"])] == [(0, "message 0"), (1, "message 1")]
    assert {(r.headline, r.truncated, r.inspect_hint) for r in rows} == {("Bazel failed: message 0", True, "diagnostics")}


def test_null_log_and_none(spark):
    kind = "log string, ordinal long, line string"
    rows = [(None, 0, "a/BUILD:1:1: in r rule //x"), (None, 1, "root_cause"), ("b", 0, None), ("b", 1, "root_cause")]
    got = logs.summary(spark.createDataFrame(rows, kind), "log").collect()
    assert sorted((str(r.log), r.category, r.message) for r in got) == [("None", "analysis", "root_cause"), ("None", "compilation", "a/BUILD:1:1: in r rule //x"), ("b", "test", "root_cause")]
    assert logs.summary(spark.createDataFrame([], kind), "log").count() == 0
