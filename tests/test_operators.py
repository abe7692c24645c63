"""Worked examples of the operators, and properties of the codecs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerflow.functions import text as T
from ledgerflow.operators import events, graph, pages, parsers, reduce, retention, stats
from ledgerflow.sources.frames import Decoder, frame, read_frames
from pyspark.sql import functions as F


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]


def test_text(spark):
    assert one(spark, lambda c: T.redact(c, [r"token=[^\s]+"]), "x token=secret y") == ["x [REDACTED] y"]
    assert one(spark, lambda c: T.bounded(c, 4), "aéé", "abcd", None) == ["aé…", "abcd", None]
    assert one(spark, lambda c: T.cut_bytes(c, 4), "aéé") == ["aé"]
    assert one(spark, T.strip_terminal, "\x1b[31mred\x1b[0m\nold\rnew\nx\r\n") == ["red\nnew\nx\n"]
    assert one(spark, T.ascii_lower, "ÀBC") == ["Àbc"]
    assert one(spark, lambda c: T.wildcard(c, "//app/*:test"), "//app/lib:test", "//other/lib:test") == [True, False]
    assert one(spark, lambda c: T.wildcard(c, "//app/..."), "//app/lib:core", "//ap", "//apple", "//app:t") == [True, False, False, False]
    assert one(spark, lambda c: T.compact_path(c, "/w"), "/w/a/b.cc", "x/execroot/_main/a.cc", "./c", "q.runfiles/_main/d", '"<WORKSPACE>/e.cc"', "a.runfiles/__main__/b.runfiles/__main__/f", "./././g", "r\\\\h", "/opt/src/main.go", "'q'") == ["a/b.cc", "a.cc", "c", "d", "e.cc", "f", "././g", "r//h", "/opt/src/main.go", "'q'"]
    assert one(spark, lambda c: T.redact(c, ["s"], 10), "ssss", "ok", None) == ["[REDACTED]", "ok", None]
    assert one(spark, lambda c: T.seconds_to_ms(c.cast("double")), "-1", "NaN", "Infinity", "1.25") == [None, None, None, 1250]
    assert one(spark, lambda c: T.base64url(c.cast("binary")), "??>") == ["Pz8-"]
    assert one(spark, T.uuid7_ms, "0188bac7-4afa-78aa-bc3b-bd1eef28d881") == [0x0188BAC74AFA]
    assert one(spark, lambda c: T.ratio_percent(c.cast("double"), F.lit(0)), "1") == [0.0]


DIAG = "inv string, ordinal long, severity string, category string, message string, path string, line long, target string, action string, repetition_count long"


def test_root_causes(spark):
    rows = [("i", k, "error", "action", "CppCompile action failed with exit code 1", None, None, f"//t:{k}", "CppCompile", 1) for k in range(48)]
    rows.append(("i", 48, "error", "compilation", "boom", "a.cc", 3, "//t:1", None, 1))
    out = reduce.root_causes(spark.createDataFrame(rows, DIAG), items=2, most=1000).orderBy("rank").collect()
    assert [(r.message, r.target, r.repetition_count) for r in out] == [("boom", "//t:1", 1), ("CppCompile action failed with exit code 1", None, 48)]


def test_skip_budget(spark):
    df = spark.createDataFrame([("i", 0, 5), ("i", 1, 9), ("i", 2, 3)], "inv string, rank long, size long")
    assert [r.size for r in reduce.within_bytes(df, F.col("size"), 10, 20).orderBy("rank").collect()] == [5, 3]


def test_closure_of_a_cycle(spark):
    edges = spark.createDataFrame([("i", 1, 2), ("i", 2, 3), ("i", 3, 1), ("i", 1, 3), ("j", 1, 9)], "inv string, parent long, child long")
    out = graph.closure(spark.createDataFrame([("i", 1)], "inv string, node long"), edges)
    assert sorted((r.node, r.depth) for r in out.collect()) == [(1, 0), (2, 1), (3, 1)]


def test_pages_follow_without_gap(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(7)], "ordinal long, v long")
    seen, after = [], -1
    while rows := pages.by_ordinal(df, 2, after).collect():
        seen += [r.ordinal for r in rows]
        after = seen[-1]
    assert seen == list(range(7))


def test_cursor_is_tied_to_its_query():
    ctx = pages.context("a", "b")
    assert pages.decode_cursor(pages.encode_cursor(3, ctx, 41), 3, ctx) == (41,)
    for wrong in (pages.encode_cursor(3, pages.context("ab", ""), 41), pages.encode_cursor(2, ctx, 41), "!!", ""):
        with pytest.raises(pages.InvalidCursor):
            pages.decode_cursor(wrong, 3, ctx)


def test_retention(spark):
    rows = [(1, 10, 50, False, False), (2, 20, 50, False, True), (3, 30, 50, False, False), (4, None, 50, True, False), (5, 1, 9, False, False)]
    out = {r.id: r.action for r in retention.plan(spark.createDataFrame(rows, "id long, finished long, bytes long, live boolean, protected boolean"), 5, 150).collect()}
    assert out == {1: "delete", 2: "prune", 3: "keep", 4: "keep", 5: "delete"}


def test_draws_are_the_generator():
    state, out = stats.seed("x"), []
    for _ in range(3 * 5):
        state = (state * stats.LCG_FACTOR + stats.LCG_STEP) & stats.MASK
        out.append(state % 5)
    assert stats.draws("x", 5, 3).ravel().tolist() == out
    v, lo, hi = stats.bootstrap(np.array([100.0, 200.0]), np.array([50.0, 100.0]), "x")
    assert v == lo == hi == 50.0


@pytest.mark.parametrize("piece", [7, 50, 1 << 20])
def test_resamples_in_blocks_are_the_same(spark, monkeypatch, piece):
    rng = np.random.default_rng(2)
    base, new = rng.integers(1, 1000, 23).astype(float), rng.integers(1, 1000, 23).astype(float)
    at = stats.draws("x", 23)
    est = np.sort(100.0 * (base[at].sum(1) - new[at].sum(1)) / base[at].sum(1))
    want = (100.0 * (base.sum() - new.sum()) / base.sum(), est[99], est[3899])
    monkeypatch.setattr(stats, "PIECE", piece)
    assert stats.bootstrap(base, new, "x") == pytest.approx(want, rel=1e-12)
    pairs = spark.createDataFrame([("x", k, float(b), float(n)) for k, (b, n) in enumerate(zip(base, new))], "g string, k long, base double, new double")
    r = stats.bootstrap_by(pairs, "g", ["k"]).collect()
    assert len(r) == 1 and tuple(r[0])[1:] == pytest.approx(want, rel=1e-12)


def test_bootstrap_takes_all_orders(spark):
    import duckdb

    from ledgerflow import catalog

    sf = "/root/testdata/sf0.001"
    want = duckdb.sql(f"""
        WITH s AS (SELECT o_orderstatus AS g, o_orderpriority AS p, row_number() OVER (PARTITION BY g, p ORDER BY o_orderkey) AS k, ceil(o_totalprice) AS v FROM '{sf}/orders.parquet'),
        x AS (SELECT coalesce(a.g, b.g) AS g, a.v AS base, b.v AS new FROM (SELECT * FROM s WHERE p = '1-URGENT') a FULL JOIN (SELECT * FROM s WHERE p = '5-LOW') b ON a.g = b.g AND a.k = b.k)
        SELECT g, count(*) FILTER (base + new IS NOT NULL), count(*) FILTER (base + new IS NULL), 100 * (sum(base) FILTER (new IS NOT NULL) - sum(new) FILTER (base IS NOT NULL)) / sum(base) FILTER (new IS NOT NULL) FROM x GROUP BY g""").fetchall()
    got = {r.o_orderstatus: r for r in catalog.queries()["f11_bootstrap"](spark, sf).collect()}
    assert len(got) == len(want) == 3
    for g, pairs, unpaired, value in want:
        assert (got[g].pairs, got[g].unpaired) == (pairs, unpaired) and pairs > 50
        assert got[g].value == pytest.approx(value) and got[g].low < got[g].value < got[g].high


def test_unpaired_sample_is_an_error(spark):
    a, b = (spark.createDataFrame([(k, 1) for k in n], "k long, v long") for n in ((1, 2), (1,)))
    with pytest.raises(Exception, match="no pair"):
        stats.paired(a, b, ["k"], "v").collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=8), st.lists(st.integers(1, 40), min_size=1, max_size=30))
def test_decoding_does_not_hang_on_chunks(frames, cuts):
    data, d, out, at, k = b"".join(map(frame, frames)), Decoder(), [], 0, 0
    while at < len(data):
        n = cuts[k % len(cuts)]
        out += d.push(data[at:at + n])
        at, k = at + n, k + 1
    assert out == frames and d.finish() is None


def test_truncated_and_oversized_frames():
    d = Decoder()
    assert d.push(frame(b"ab") + frame(b"cdef")[:-1]) == [b"ab"] and "inside" in d.finish()
    d = Decoder(most=3)
    assert d.push(frame(b"ab") + frame(b"cdef")) == [b"ab"] and d.push(frame(b"x")) == [] and "limit" in d.error
    d = Decoder()
    assert d.push(b"\xff" * 11) == [] and d.error


def test_frame_source(spark, tmp_path):
    (tmp_path / "a").write_bytes(frame(b"1") + frame(b"22") + b"\x05x")
    out = read_frames(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [r.frame for r in out] == [b"1", b"22", None] and "inside" in out[2].error


def test_streaming_decode_equals_batch(spark, tmp_path):
    from ledgerflow.streaming.decode import decode_chunks

    data = b"".join(frame(bytes([k]) * k) for k in range(1, 30))
    pieces = [("a", k, data[k * 7:k * 7 + 7]) for k in range(-(-len(data) // 7))]
    schema = "inv string, seq long, data binary"
    for k, part in enumerate((pieces[:20], pieces[20:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = decode_chunks(stream).writeStream.format("memory").queryName("decoded").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.ordinal, bytes(r.frame)) for r in spark.table("decoded").collect()) == [(k - 1, bytes([k]) * k) for k in range(1, 30)]


def test_rules_of_null_columns(spark):
    assert one(spark, lambda c: events.test_status(c.cast("int")), None, "5", "8") == ["incomplete", "incomplete", "failed"]
    assert one(spark, lambda c: events.action_message(c, F.lit(None)), None, "", "Link") == ["Bazel action failed", "Bazel action failed", "Link action failed"]
    assert one(spark, events.evidence_priority, None, "failures:", "test a ... ok", "TEST a ... FAILED", "Error: x", "assertion `a` failed", 'b.go: import of "c"') == [None, None, None, 2, 1, 0, 1]


def test_parsers(spark):
    lines = ["a.cc:3:4: fatal error: x.h missing", "b.cpp(7): error C2065: y", "c.ts:1:2 - warning TS9: z", "D.java:5: error: w", "e.go:1:2: undefined: v", '  File "f.py", line 9', "error[E0308]: mismatched", "ld: undefined reference to `g'", "fine", None]
    got = parsers.parsed(spark.createDataFrame([(x,) for x in lines], "line string")).drop("line").collect()
    assert [tuple(r) for r in got] == [
        ("clang", "a.cc", 3, 4, "error", "x.h missing"), ("msvc", "b.cpp", 7, None, "error", "C2065: y"), ("typescript_pretty", "c.ts", 1, 2, "warning", "TS9: z"), ("java", "D.java", 5, None, "error", "w"),
        ("go", "e.go", 1, 2, "error", "undefined: v"), ("python", "f.py", 9, None, "error", None), ("rust", None, None, None, "error", "mismatched"), ("linker", None, None, None, "error", "undefined reference to `g'")]
    assert parsers.regex_diagnostics(spark.createDataFrame([("ab" * 9,)], "t string"), "t", "a", 4).count() == 4
    with pytest.raises(ValueError):
        parsers.regex_diagnostics(spark.createDataFrame([], "t string"), "t", "a", 1001)


def test_build_lines(spark):
    from ledgerflow.operators import build_lines as B

    def of(parser, *lines):
        return [r and tuple(r) for r in one(spark, parser, *lines)]

    assert of(B.inline, "ERROR: /w/execroot/m/a.bzl:3: in x.bzl:4:5: bad", "a.bzl:x: y", "a/BUILD:7:", "\tWORKSPACE:1: y", "x\\BUILD:1:2: warning: z", "INFO: a.bzl:1: y", "a.bzl:99999999999: y", "", None) == [
        ("a.bzl:3: in x.bzl", 4, 5, "error", "loading", "bad"), None, None, None, ("x/BUILD", 1, 2, "warning", "loading", "warning: z"), None, None, None, None]
    assert of(B.lint, "🚨 a.ts:1:2 · t · r — m", "ℹ a.ts:1 — m", "⚠️ a.ts:1 ·  · r — m", "🚨 a.ts — m", "🚨 a.ts:1 —  ", None) == [
        ("a.ts", 1, 2, "error", "compilation", "t [r]: m"), ("a.ts", 1, None, "note", "compilation", "m"), ("a.ts", 1, None, "warning", "compilation", "[r]: m"), None, None, None]
    assert of(B.strict_dependency, 'x.go: import of "y"', 'x.go: import of ""', 'x.py: import of "y"', None)[1:] == [None, None, None]
    assert of(B.traceback_location, 'File "a/BUILD", line 3', 'File "aBUILD", line 3', 'File "a.bzl", line x', None) == [("a/BUILD", 3, None), None, None, None]
    lines = ["Error: early", "ERROR: Traceback (most recent call last):", '\tFile "a.bzl", line 3, column 4, in f', '\tFile "b.py", line 9', "Error in fail: x", "Error in fail: y",
             "c.bzl:1: analysis of target //x", "Traceback (most recent call last):", "Error in z", None]
    got = B.tracebacks(spark.createDataFrame([("i", k, x) for k, x in enumerate(lines)], "inv string, ordinal int, line string"), "inv").orderBy("ordinal").collect()
    assert [(r.ordinal, r.path, r.line, r.col_no, r.category) for r in got] == [(0, None, None, None, "loading"), (4, "a.bzl", 3, 4, "loading"), (5, None, None, None, "loading"), (8, None, None, None, "analysis")]


def test_outcomes(spark):
    from ledgerflow.operators import outcomes as O

    assert one(spark, O.log_key, "//a/b:c", "@r//a:c", "@r//:c", "//a", "a:b:c") == ["a/b/c", "a/c", "c", "a", "a/b:c"]
    files = spark.createDataFrame([("/o/testlogs/a/b/c/test.log",), ("/o/testlogs/a",), ("testlogs/a/x",), ("C:\\o\\testlogs\\a\\x",), (None,), ("/o/testlogs/testlogs/a/x",)], "uri string")
    tests = spark.createDataFrame([("//a/b:c",), ("//a",), (None,)], "label string")
    assert sorted(tuple(r) for r in O.with_artifacts(tests, files).collect()) == [("//a", "/o/testlogs/a/b/c/test.log"), ("//a", "/o/testlogs/testlogs/a/x"), ("//a", "C:\\o\\testlogs\\a\\x"), ("//a/b:c", "/o/testlogs/a/b/c/test.log")]
    d = spark.createDataFrame([("//a", "x"), (None, None), ("//b", "y"), ("//c", None)], "target string, action string")
    assert [tuple(r) for r in O.unsuppressed(d, spark.createDataFrame([("//a",), (None,)], "l string"), "l", ["//c*"], ["y"]).collect()] == [(None, None)]


def test_records(spark):
    from ledgerflow.sources import text_records as R

    assert one(spark, R.rows_in, "", None, "a", "a\n", "a\nb", "\n") == [0, 0, 1, 1, 2, 1]
    assert [bytes(x) for x in one(spark, lambda c: R.tail(c.cast("binary"), 3), "abcdef", "ab", None)] == [b"def", b"ab", b""]
    lines = spark.createDataFrame([("r", k, x) for k, x in enumerate(["DA:1,1", "SF:a", "DA:1,0", "DA:2,18446744073709551615", "BRDA:x", "SF:b", "DA:1,0", "SF:a", "DA:3,1"])], "run string, ordinal int, line string")
    assert sorted(((r.path or "", r.found, r.hit, r.percent) for r in R.lcov(lines, "run").collect())) == [("", 4, 2, 50.0), ("a", 3, 2, 66.666667), ("b", 1, 0, 0.0)]
    with pytest.raises(Exception, match="no number"):
        R.lcov(spark.createDataFrame([("r", 0, "SF:a"), ("r", 1, "DA:1,x")], "run string, ordinal int, line string"), "run").collect()


def test_clusters_and_percentiles(spark):
    rows = [("x", c, float(10 * c + k), float(3 * c + k)) for c in range(1, 6) for k in range(3)]
    base, new = (np.array([sum(r[j] for r in rows if r[1] == c) for c in range(1, 6)]) for j in (2, 3))
    got = stats.bootstrap_clusters(spark.createDataFrame(rows, "g string, c long, base double, new double"), "g", "c").collect()
    assert tuple(got[0])[1:] == pytest.approx(stats.bootstrap(base, new, "x", high=True))
    for n in (1, 2, 7, 40):
        values = sorted((k * 37) % 11 for k in range(n))
        df = spark.createDataFrame([("a", v) for v in values] + [("a", None)], "g string, v long")
        r = stats.percentiles(df, ["g"], "v", {"a": ("nearest", 95), "c": ("lower", 95), "d": ("rounded", 95), "e": ("lower", 50)}).collect()[0]
        assert tuple(r)[1:] == (n, values[-(-n * 95 // 100) - 1], values[(n - 1) * 95 // 100], values[int((n - 1) * 0.95 + 0.5)], values[(n - 1) // 2])


def test_scanned_pages_follow_without_gap(spark):
    rows = [(k, k % 4 == 1) for k in range(23)]
    df = spark.createDataFrame([*rows, (23, None)], "ordinal long, v boolean")
    for limit, scan in ((2, 100), (100, 3), (1, 1)):
        seen, hits, after = [], [], -1
        while True:
            page = pages.scanned_page(df, limit, after, F.col("v"), scan).orderBy("ordinal").collect()
            assert len(page) <= scan and sum(r.hit for r in page) <= limit
            seen, hits = seen + [r.ordinal for r in page], hits + [r.ordinal for r in page if r.hit]
            if not page or not page[-1].truncated:
                break
            assert page[-1].next == page[-1].ordinal
            after = page[-1].next
        assert seen == list(range(24)) and hits == [k for k, v in rows if v]


def test_rules_of_runs_and_streams(spark):
    from ledgerflow.operators import policy

    assert one(spark, policy.command_verdict, "build", "clean", "zip", None) == ["ok", "denied", "unsupported", "unsupported"]
    assert one(spark, lambda c: policy.arguments_verdict(F.array(c), 1, 5, 9), "abc", "-s=1", "a\0b", "abcdef") == [None, "reserved", "invalid", "too_long"]
    assert one(spark, policy.holds_secret, "gho_" + "a" * 20, "C:\\Users\\me", "x", None) == [True, True, False, None]
    assert one(spark, T.lock_pid, "a\npid=7\n", "pid=x", "xpid=3", None) == [7, None, None, None]
    assert one(spark, T.padded_names, "<WORKSPACE>___/a", None) == ["<workspace>/a", None]
    assert one(spark, lambda c: T.workspace_named(c, "/w.x"), "/w.x/a /wyx", None) == ["<workspace>/a /wyx", None]
    runs = [("a", k, s) for k, s in enumerate(("queued", "starting", "running", "failed"))] + [("b", 0, "running"), ("c", 0, "queued"), ("c", 1, None)]
    got = events.legal_runs(spark.createDataFrame(runs, "run string, k int, state string"), "run", "k", "state").collect()
    assert {r.run: r.legal for r in got} == {"a": True, "b": False, "c": False}
    streams = spark.createDataFrame([(0, "x", "y"), (1, None, "x"), (2, None, None)], "k int, head string, own string")
    got = events.routed(streams, spark.createDataFrame([("x",), ("x",)], "run string"), "run", F.col("head"), F.col("own"), "k").collect()
    assert sorted((r.k, r.verdict) for r in got) == [(0, "ok"), (1, "already_exists"), (2, "not_found")]
    a, b = (spark.createDataFrame([(1, k), (1, 5), (k, 9)], "id int, n int") for k in (2, 3))
    assert [tuple(r) for r in events.merged_max(a, b, "id", ["n"]).collect()] == [(1, 5)]
