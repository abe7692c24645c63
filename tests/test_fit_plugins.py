"""Byte budgets, plug-ins, test results in XML and diagnostics told again."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import fit, outcomes, plugins
from ledgerflow.operators.plugins import Plugin, Plugins, diagnostic, patch
from ledgerflow.sources.test_xml import test_cases as xml_cases


def test_json_sizes(spark):
    texts = [None, "", "plain", 'q"\\/', "\b\f\n\r\t", "".join(map(chr, range(32))), "é日🙂", "\x7f"]
    d = spark.createDataFrame([(k, t, k * 10**k - 5) for k, t in enumerate(texts)], "k long, t string, n long")
    size = fit.json_object_bytes({"k": fit.json_number_bytes(F.col("k")), "t": fit.json_text_bytes(F.col("t")), "n": fit.json_number_bytes(F.col("n"))})
    whole = F.octet_length(F.to_json(F.struct("k", "t", "n"), {"ignoreNullFields": "false"}))
    assert [tuple(r) for r in d.where(size != whole).collect()] == []


def test_pages_fit_with_their_cursors(spark):
    sizes = {"a": [10, 20, 30], "b": [50, 1, 1], "c": [200], "d": [5] * 30}
    items = spark.createDataFrame([(p, k, s, "x" * (40 if (p, k) == ("b", 0) else k)) for p, v in sizes.items() for k, s in enumerate(v)], "page string, n int, size long, cursor string")
    got = fit.fitting_pages(items, "page", "n", F.col("size"), 100, 10, F.length("cursor"), 1).collect()

    def longest(v, cursor):
        best = 0
        for m in range(1, len(v) + 1):
            if 10 + sum(v[:m]) + m - 1 + cursor(m - 1) <= 100:
                best = m
        return best

    for p, v in sizes.items():
        m = longest(v, lambda k: 40 if (p, k) == ("b", 0) else k)
        rows = sorted((r for r in got if r.page == p), key=lambda r: r.n)
        assert [r.kept for r in rows] == [k < m for k in range(len(v))], p
        assert {r.truncated for r in rows} == {m < len(v)} and {r.next_order for r in rows} == {m - 1 if m else None} and all(r.fits for r in rows)


def plain_fit(head, lists, limit):
    """The loop: one thing less at a time until it fits."""
    def size():
        return len(json.dumps({"headline": head["headline"], "command": head["command"], "truncated": head["truncated"], **lists}, separators=(",", ":"), ensure_ascii=False).encode())

    def shrink(name, least):
        raw = head[name].encode()
        if len(raw) <= least:
            return False
        cut = raw[:max(len(raw) * 3 // 4, least)].decode("utf-8", "ignore") + "…"
        if len(cut.encode()) >= len(raw):
            return False
        head[name] = cut
        return True

    while size() > limit:
        head["truncated"] = True
        for name in fit.GIVEN_UP:
            if lists[name]:
                lists[name].pop()
                break
        else:
            if not shrink("headline", 96) and not shrink("command", 32):
                break
    return head, lists, size()


@pytest.mark.parametrize("limit", [60, 131, 150, 203, 230, 235, 236, 237, 320, 321, 2000])
def test_results_are_fitted_as_step_by_step(spark, limit):
    cases = {1: ("é" * 300, "build //a", [3, 1, 0]), 2: ("short", "c" * 90, [9, 9, 9]), 3: ("h", "c", [0, 0, 0]), 4: ('"\n' * 60, "test " + "日" * 40, [1, 0, 2])}
    heads, items, want = [], [], {}
    for k, (headline, command, counts) in cases.items():
        lists = {name: [f"{name}{i}" for i in range(n)] for name, n in zip(fit.GIVEN_UP, counts)}
        empty = len(json.dumps({"headline": "", "command": "", "truncated": False, **{n: [] for n in fit.GIVEN_UP}}, separators=(",", ":"))) - 4
        heads.append((k, headline, command, empty))
        items += [(k, name, i, len(json.dumps(x))) for name, v in lists.items() for i, x in enumerate(v)]
        want[k] = plain_fit({"headline": headline, "command": command, "truncated": False}, lists, limit)
    h, i = fit.fitted_results(spark.createDataFrame(heads, "id int, headline string, command string, base long"), spark.createDataFrame(items, "id int, list string, position int, size long"), "id", F.lit(limit))
    left = i.collect()
    for r in h.collect():
        head, lists, size = want[r.id]
        assert (r.headline, r.command, r.truncated, r.bytes) == (head["headline"], head["command"], head["truncated"], size)
        assert {n: sum(x.id == r.id and x.list == n for x in left) for n in fit.GIVEN_UP} == {n: len(v) for n, v in lists.items()}


EVENTS = "inv string, ordinal long, label string, target_kind string, action_type string, message string"
DIAGNOSTICS = "inv string, ordinal long, severity string, category string, message string, path string, line long, col_no long, target string, action string, repetition_count long"


def test_plugins(spark):
    def mine(c):
        return patch([diagnostic(f"{len(c['events'])} events", category="test", path="a.py", line=3)], headline="mine")

    def takes(c):
        return patch([diagnostic("taken over")], headline="late", suppress_builtin_diagnostics=True)

    def breaks(c):
        raise KeyError("no such thing")

    many = Plugins([
        Plugin("breaks", breaks, priority=9), Plugin("takes", takes, override=True, priority=5, labels=("//lib/...",), actions=("Javac",)), Plugin("too", takes, override=True, labels=("//*",)),
        Plugin("mine", mine, priority=7, commands=("test",)), Plugin("over", lambda c: patch([diagnostic("x")] * 3)), Plugin("wrong", lambda c: {"diagnostics": [], "suppress_builtin_diagnostics": 1}),
        Plugin("empty", lambda c: patch()), Plugin("never", mine, kinds=("x_test",))], most_items=2)
    runs = spark.createDataFrame([("a", "test"), ("b", "build"), ("c", "test")], "inv string, command string")
    events = spark.createDataFrame([("a", 1, "//lib/x:y", None, None, None), ("a", 2, "//app:z", None, "Javac", None), ("a", 3, None, "rule", "Cpp", "m"), ("b", 1, "//app:z", None, None, None)], EVENTS)
    told = plugins.reports(runs, events, "inv", many, most=2).cache()
    r = {x.inv: x for x in told.collect()}
    assert r["a"].applied == ["mine", "takes"] and r["a"].headline == "mine" and r["a"].collisions == ["'too' also matches what 'takes' owns"] and r["a"].input_truncated
    assert r["b"].applied == ["too"] and not r["b"].collisions and r["c"].applied == ["mine"] and not r["c"].input_truncated
    assert sorted(f.name for f in r["a"].failures) == ["breaks", "over", "wrong"] and "no such thing" in next(f.error for f in r["a"].failures if f.name == "breaks")
    assert r["a"].labels == ["//app:z", "//lib/x:y"] and [x.message for x in r["a"].added] == ["2 events", "taken over"] and r["a"].added[0].path == "a.py"
    base = [("a", k, "error", "test", f"m{k}", None, None, None, t, a, 1) for k, (t, a) in enumerate([("//lib/q", None), ("//app:z", None), ("//else", "Javac"), ("//else", "Cpp"), (None, None)])] + [("c", 0, "error", "test", "stays", None, None, None, "//lib/x", None, 1)]
    out = plugins.applied(spark.createDataFrame(base, DIAGNOSTICS), told, "inv").collect()
    assert [x.message for x in sorted(out, key=lambda x: x.ordinal) if x.inv == "a"] == ["m3", "m4", "2 events", "taken over"]
    assert sorted(x.message for x in out if x.inv == "c") == ["0 events", "stays"]


@pytest.mark.parametrize("bad", [
    None, {}, {"diagnostics": []}, {"diagnostics": [], "suppress_builtin_diagnostics": True, "more": 1}, patch([{"message": "x"}]), patch([diagnostic("x", severity="fatal")]), patch([diagnostic("x", category="other")]),
    patch([diagnostic("x", path="a", line=-1)]), patch([diagnostic("x", repetition_count=True)]), patch([{**diagnostic("x"), "location": {"path": None}}]), patch(headline=3), patch([diagnostic("x" * 900)]), patch("xy")])
def test_patches_are_checked(bad):
    with pytest.raises(plugins.PatchError):
        plugins.validated(bad, 5, 500)


def test_plugins_are_checked():
    for wrong in ([Plugin("a", patch), Plugin("a", patch)], [Plugin("", patch)], [Plugin("x" * 129, patch)], [Plugin("o", patch, override=True)]):
        with pytest.raises(ValueError):
            Plugins(wrong)


def test_regex_matches():
    assert plugins.regex_matches("a1 b2 c3", r"(?P<l>[a-z])(?P<d>\d)", 2) == [{"l": "a", "d": "1"}, {"l": "b", "d": "2"}]
    with pytest.raises(plugins.PatchError):
        plugins.regex_matches("", "x", 1001)


def test_xml(spark):
    texts = {
        1: '<testsuite><testcase name="one" time="0.25"><failure message="bad"/></testcase></testsuite>',
        2: '<testsuites><testsuite name="s"><testcase name="ok"/><testcase name="skip"><skipped message="later"/></testcase></testsuite><testsuite><testcase name="two" time="-1"/></testsuite></testsuites>',
        3: '<testsuite><testcase name="a"><failure/></testcase><testcase time="x"><error>boom &amp; bust</error></testcase><testcase name="c"><skipped/><error message="e">t</error><failure message="f"/></testcase></testsuite>',
        4: '<testsuite><testcase name="cut">', 5: "", 6: None, 7: "<testsuites/>", 8: '<testsuites><testsuite><testsuite><testcase name="deep"/></testsuite><testcase name="near" time="1e300"/></testsuite></testsuites>', 9: "no xml"}
    d = spark.createDataFrame(list(texts.items()), "id int, xml string")
    bad = (None, None, None, None, None, "the text is not well-formed")
    want = {1: [(0, "one", "failed", 250, "bad", None)], 2: [(0, "ok", "passed", None, None, None), (1, "skip", "skipped", None, "later", None), (2, "two", "passed", None, None, None)],
            3: [(0, "a", "failed", None, None, None), (1, "", "failed", None, "boom & bust", None), (2, "c", "failed", None, "f", None)], 4: [bad], 5: [bad], 6: [bad], 7: [], 8: [(0, "near", "passed", 2**63 - 1, None, None)], 9: [bad]}
    got = xml_cases(d, "xml").collect()
    for k, rows in want.items():
        assert [tuple(r)[1:] for r in sorted(got, key=lambda r: r.position or 0) if r.id == k] == rows, k
    assert [(r.position, r.name) for r in xml_cases(d.where("id = 8"), "xml", 2).collect()] == [(0, "near"), (1, "deep")]


def test_told_again(spark):
    kind = "inv string, category string, message string, path string, line long, col_no long, target string"
    old = [("a", "compilation", "m", None, None, None, "//t"), ("a", "compilation", "m", "x.cc", 1, None, None), ("a", "compilation", "m", "y.cc", 1, None, None), ("a", "test", "m", None, None, None, None), ("a", "test", "m", None, None, None, "//t"),
           ("a", "compilation", "part", "x.cc", 1, None, None), ("a", "compilation", "part", "x.cc", 2, None, None), ("a", "loading", "m", None, None, None, None), ("b", "compilation", "m", None, None, None, None), ("a", "compilation", "part", None, None, None, None)]
    new = [("a", "test", "m", "x.cc", 1, None, "//t"), ("a", "test", "a part of it", "x.cc", 1, None, "//t")]

    def goes(e, n):
        place = e[3:6] == n[3:6]
        return e[0] == n[0] and (e[1] == "compilation" or (e[1] == n[1] and e[6] is None)) and ((e[2] == n[2] and (place or e[3] is None)) or (e[3] is not None and place and e[2] in n[2]))

    got = outcomes.not_retold(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind), "inv").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(e) for e in old if not any(goes(e, n) for n in new))


def test_contexts_are_read_in_pieces():
    import pyarrow as pa

    from ledgerflow.operators import plugins

    batch = pa.RecordBatch.from_pydict({"n": list(range(50)), "t": ["x" * (k % 7 * 10) for k in range(50)]})
    got = list(plugins.pieces(batch, "t", 100))
    assert [n for b in got for n in b.column("n").to_pylist()] == list(range(50))
    assert len(got) > 10 and all(b.num_rows == 1 or sum(map(len, b.column("t").to_pylist())) <= 100 for b in got)
    assert list(plugins.pieces(batch.slice(0, 0), "t", 100)) == []
