"""Pages of evidence against a loop that reads record by record."""

import random

from ledgerflow.operators.pages import evidence_pages


def page(records, start, items, scan, wanted, test_log):
    items_most, scan_most = min(max(items, 1), 100), min(max(scan, items, 1), 10_000)
    own = [wanted is None or any(x is not None and wanted.lower() in x.lower() for x in r) for r in records]  # a null holds nothing
    found, scanned = [], 0
    for k in range(start, len(records)):
        hit = own[k] or test_log and any(0 <= j < len(records) and own[j] and records[j][0] == records[k][0] for j in (k - 1, k + 1))
        if scanned == scan_most or hit and len(found) == items_most:
            return found, True, k
        scanned += 1
        if hit:
            found.append(k)
    return found, False, None


def test_pages(spark):
    r = random.Random(4)
    runs = {f"r{n}": [(r.choice([None, "//a", "//B"]), r.choice(["x", "FAIL y", "fail", "", None])) for _ in range(r.choice([1, 2, 30, 130]))] for n in range(12)}
    asked, want = [], {}
    for k in range(150):
        inv, start, items, scan, wanted, test = r.choice([*runs, "none"]), r.choice([0, 0, 1, 7, 200]), r.choice([0, 1, 3, 200]), r.choice([0, 1, 5, 40, 20_000]), r.choice([None, "Fail", "//b", "nothing", ""]), r.random() < 0.5
        asked.append((k, inv, start, items, scan, wanted, test))
        want[k] = page(runs.get(inv, []), start, items, scan, wanted, test)
    records = spark.createDataFrame([(i, n, *x) for i, v in runs.items() for n, x in enumerate(v)], "inv string, position long, label string, text string")
    got = evidence_pages(records, spark.createDataFrame(asked, "request long, inv string, start long, items long, scan long, filter string, test_log boolean")).collect()
    assert {g.request: ([x.position for x in g["items"]], g.truncated, g.next) for g in got} == want


def test_query_reads_what_is_asked_for(spark, tmp_path):
    """User 300 asks for 6 items of 5 records (5 + 300 % 60, 300 % 7)."""
    import duckdb

    from ledgerflow import catalog_cases
    from tests.compare import same

    con = duckdb.connect()
    con.execute("create table events as select i as event_id, u as user_id, case i % 3 when 0 then 'click' else 'error' end as event_type from range(40) r(i), (values (300), (301), (720), (1)) v(u)")
    con.execute(f"copy events to '{tmp_path}/events.parquet'")
    df = catalog_cases.h07_evidence_pages(spark, str(tmp_path))
    assert same(df, con, catalog_cases._H07) == ""
    assert {r.request: r.next for r in df.collect()}[300] == 5
