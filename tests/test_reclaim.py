"""Reclaiming in two phases, stopped in between and begun again."""

from ledgerflow.operators.retention import Reclaim, reclaimed

LEDGER = "id long, terminal boolean, deferred boolean, expires long, evidence_bytes long, manifest_bytes long"


def test_actions(spark):
    ledger = [(1, False, False, None, 10, 1), (2, True, True, 100, 10, 1), (3, True, True, 50, 10, 1), (4, True, True, None, 0, 1), (5, True, False, None, None, 1), (6, None, None, None, None, None), (7, True, None, 900, 10, 1)]
    chosen = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 6, 7, 8, 8)], "id long")
    got = sorted(map(tuple, reclaimed(chosen, spark.createDataFrame(ledger, LEDGER), 50).collect()))
    assert got == [(1, "skip", 0), (2, "prune", 10), (3, "delete", 11), (4, "prune", 0), (5, "delete", 1), (6, "skip", 0), (7, "delete", 11), (8, "skip", 0)]


def test_two_phases(spark, tmp_path):
    evidence, ledger, root = (str(tmp_path / x) for x in ("evidence", "ledger", "gone"))
    spark.range(100).selectExpr("id", "id % 10 AS day", "concat('e', id) AS x").write.partitionBy("day").parquet(evidence)
    spark.range(100).selectExpr("id", "id % 10 AS day").write.partitionBy("day").parquet(ledger)
    r = Reclaim(spark, root)
    actions = spark.range(100).where("id % 10 = 3 OR id < 20 AND id % 10 = 5 OR id = 7").selectExpr("id", "CASE WHEN id = 7 THEN 'prune' WHEN id = 15 THEN 'skip' ELSE 'delete' END AS action")
    r.hide(actions, 0)
    r.hide(actions, 0)  # again, as after a failure
    gone = {k for k in range(100) if k % 10 == 3} | {5}
    ids = lambda df: {x.id for x in df.collect()}
    read = spark.read.parquet
    assert ids(r.without(read(ledger), False)) == set(range(100)) - gone and ids(r.without(read(evidence), True)) == set(range(100)) - gone - {7}
    assert len(ids(read(evidence))) == 100  # nothing is unlinked yet
    kept = sorted((tmp_path / "evidence" / "day=1").iterdir())
    assert r.unlink(evidence, "day", True) == 3 and r.unlink(evidence, "day", True) == 0
    assert ids(read(evidence)) == set(range(100)) - gone - {7} and not (tmp_path / "evidence" / "day=3").exists()
    assert sorted((tmp_path / "evidence" / "day=1").iterdir()) == kept  # other days' files stay
    assert r.unlink(ledger, "day", False) == 2 and ids(read(ledger)) == set(range(100)) - gone
    r.hide(spark.createDataFrame([(8, "delete")], "id long, action string"), 1)
    assert r.unlink(ledger, "day", False) == 1 and ids(r.without(read(ledger), False)) == set(range(100)) - gone - {8}
