"""Expectations and parity of cases, by hand."""

from ledgerflow.operators import expectations as X

D = "case string, rank long, severity string, category string, message string, path string, target string, action string, line long, col_no long, repetition_count long"
W = "case string, n long, rank long, message_equals string, message_prefix string, message_contains string, path string, target string, action string, line long, col_no long, repetition_count long, severity string, category string"
DIAGNOSTICS = [("a", 0, "error", "test", "no such file", "x.c", "//t", None, 3, None, 1), ("a", 1, "warning", "test", None, None, None, None, None, None, 2), ("b", 0, "error", "loading", "no such file", "y.c", None, "Javac", 3, 4, 1)]


def wish(case, n, **w):
    return (case, n, *(w.get(c.split()[0]) for c in W.split(", ")[2:]))


def test_diagnostics(spark):
    wishes = [
        wish("a", 0, rank=0, message_prefix="no such"), wish("a", 1, rank=1, message_prefix="no such"), wish("a", 2, rank=2), wish("a", 3, message_equals="no such file", line=3), wish("a", 4, message_equals="no such file", line=4),
        wish("a", 5, message_contains="such", severity="error"), wish("a", 6, path="y.c"), wish("b", 0, action="Javac", col_no=4), wish("b", 1, target="//t"), wish("b", 2), wish("c", 0), wish("c", 1, rank=0), wish("a", 7, repetition_count=2), wish("a", 8, message_contains="")]
    got = {(r.case, r.n): r.rule for r in X.unmet_diagnostics(spark.createDataFrame(wishes, W), spark.createDataFrame(DIAGNOSTICS, D)).collect()}
    assert got == {("a", 1): "diagnostic at rank", ("a", 2): "no such rank", ("a", 4): "no diagnostic", ("a", 6): "no diagnostic", ("b", 1): "no diagnostic", ("c", 0): "no diagnostic", ("c", 1): "no such rank"}
    assert X.unmet_diagnostics(spark.createDataFrame([], W), spark.createDataFrame(DIAGNOSTICS, D)).count() == 0


def test_many_findings_give_a_row_for_each_wish(spark):
    many = spark.range(20_000).selectExpr("'a' AS case", "id AS rank", "'error' AS severity", "'test' AS category", "concat('m', id % 10) AS message", "'p' AS path", *(f"cast(null AS {t}) AS {c}" for c, t in [("target", "string"), ("action", "string"), ("line", "long"), ("col_no", "long")]), "1L AS repetition_count")
    wishes = [wish("a", n, message_equals=f"m{n}") for n in range(12)]
    assert sorted(r.n for r in X.unmet_diagnostics(spark.createDataFrame(wishes, W), many).collect()) == [10, 11]


def test_artifacts_and_what_is_forbidden(spark):
    a = spark.createDataFrame([("a", "log", "text", "file:///w/log", True), ("a", "xml", None, "bytestream://x", None)], "case string, name string, kind string, uri string, locally_available boolean")
    wishes = [("a", 0, "log", None, "text", None, True), ("a", 1, None, "m", None, "stream", None), ("a", 2, "log", None, None, "stream", None), ("a", 3, None, None, None, None, False)]
    got = X.unmet_artifacts(spark.createDataFrame(wishes, "case string, n long, name_equals string, name_contains string, kind string, uri_contains string, locally_available boolean"), a)
    assert sorted(r.n for r in got.collect()) == [2, 3]
    seen = spark.createDataFrame([("a", "raw secret"), ("b", None)], "case string, raw_text string")
    no = [("a", 0, "message", "such"), ("a", 1, "path", "x.c"), ("a", 2, "target", "/u"), ("a", 3, "artifact_uri", "/w/"), ("a", 4, "raw", "secret"), ("b", 0, "raw", "secret"), ("b", 1, "path", "x.c"), ("a", 5, "raw", "such")]
    got = X.present(spark.createDataFrame(no, "case string, n long, place string, fragment string"), seen, spark.createDataFrame(DIAGNOSTICS, D), a)
    assert sorted(map(tuple, got.collect())) == [("a", 0, "forbidden message"), ("a", 1, "forbidden path"), ("a", 3, "forbidden artifact_uri"), ("a", 4, "forbidden raw")]


def test_parity(spark):
    heads = "case string, state string, exit_code long, headline string, inspect_hint string"
    files = "case string, position long, name string, kind string"
    live = [("a", "failed", 1, "in <WORKSPACE>__/x", "log"), ("b", "failed", 1, "h", None), ("c", "failed", None, None, None)]
    replay = [("a", "failed", 1, "in <workspace>_/x", None), ("b", "succeeded", None, "h2", "log"), ("d", "failed", 1, "", None)]
    first = [DIAGNOSTICS[0], DIAGNOSTICS[2], ("c", *DIAGNOSTICS[0][1:])]
    again = [("a", 0, "error", "compilation", "no such file", "x.c", None, None, 3, None, 1), ("b", 0, "error", "test", *DIAGNOSTICS[2][4:])]
    la, ra = [("a", 0, "x", "k"), ("a", 1, "y", None), ("b", 0, "x", "k")], [("a", 0, "x", "k"), ("a", 1, "y", None), ("b", 0, "x", "k"), ("b", 1, "z", "k")]
    rows = lambda x, s: spark.createDataFrame(x, s)
    got = X.parity(rows(live, heads), rows(replay, heads), rows(first, D), rows(again, D), rows(la, files), rows(ra, files))
    want = [("b", "state"), ("b", "exit code"), ("b", "headline"), ("b", "inspect hint"), ("b", "primary diagnostic"), ("b", "artifacts"), ("c", "not in both"), ("c", "primary diagnostic in one"), ("d", "not in both")]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_findings_are_shuffled_once_and_never_copied(spark):
    a = spark.createDataFrame([("a", "f", "log", "u", True)], "case string, name string, kind string, uri string, locally_available boolean")
    wishes, d = spark.createDataFrame([wish("a", 0, rank=0), wish("a", 1, line=3)], W), spark.createDataFrame(DIAGNOSTICS, D)
    no = spark.createDataFrame([("a", 0, "message", "such"), ("a", 1, "path", "y")], "case string, n long, place string, fragment string")
    seen = spark.createDataFrame([("a", "x")], "case string, raw_text string")
    for got in (X.unmet_diagnostics(wishes, d), X.present(no, seen, d, a)):
        # A generator made a row for each equality, or place, that a finding has.
        assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
