"""Streams against batches and against hand-made outcomes."""

from __future__ import annotations

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerflow.operators import folds
from ledgerflow.sources import build_events as B
from ledgerflow.sources.frames import Decoder, FrameError, frame
from ledgerflow.streaming.durable import DurableLog
from ledgerflow.streaming.fold import fold_chunks

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHUNK = "inv string, seq long, data binary, eof boolean, exit boolean"


def run(*labels, code=0, last=True, retry=False):
    """The bytes of a run that completes these (label, success)."""
    out = [B.encode_event("started", B.encode_event_id("started"))] + [B.encode_event("completed", B.encode_event_id("target_completed", x), success=ok) for x, ok in labels]
    out.append(B.encode_event("finished", B.encode_event_id("build_finished"), last=last, success=code == 0, code=39 if retry else code))
    return b"".join(map(frame, out))


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["aborted", "action", "completed", "test_summary", "finished", "exec_request", "progress"]), st.text(max_size=8), st.booleans(), st.booleans(), st.integers(-2**31, 2**31 - 1), st.text(max_size=20), st.integers(-2**63, 2**63 - 1))
def test_events_round_trip(kind, label, last, success, code, description, ms):
    ident = B.encode_event_id("test_summary", label)
    got = dict(zip((c.split()[0] for c in B.COLUMNS.split(", ")), B.event(B.encode_event(kind, ident, last, success=success, code=code, description=description, attempts=2, shards=3, duration_ms=ms))))
    assert (got["id_kind"], got["label"], got["kind"], got["last"]) == ("test_summary", label or None, kind, last)
    if kind in ("action", "completed", "finished", "exec_request"):
        assert got["success"] == success
    if kind in ("aborted", "action", "test_summary"):
        assert got["code"] == code
    if kind == "finished":
        assert got["code"] == code
    if kind in ("aborted", "action"):
        assert got["description"] == description
    if kind == "test_summary":
        assert (got["attempts"], got["shards"], got["duration_ms"]) == (2, 3, ms)


@pytest.mark.parametrize("bad", [b"\x08", b"\x0a\x05ab", b"\xff" * 11, b"\x0b", b"\x00\x01"])
def test_broken_events_are_errors(bad):
    with pytest.raises(FrameError):
        B.event(bad)


STREAMS = {
    "good": [(run(("//a", True), ("//b", False), ("//a", False), code=1), False, True)],
    "pieces": [(run(("//a", True), ("//b", True))[:9], False, False), (run(("//a", True), ("//b", True))[9:], False, False), (b"", False, True)],
    "eof": [(run(("//c", True), last=False), True, False), (b"", False, True)],
    "retried": [(run(("//x", False), last=False, retry=True), False, False), (run(("//y", True)), False, True)],
    "unretried": [(run(("//x", False), ("//z", True), last=False, retry=True), True, True)],
    "endless": [(run(("//a", True), last=False), False, True)],
    "cut": [(run(("//a", True))[:-3], False, True)],
    "broken": [(frame(b"\x08") + frame(b""), False, False), (b"more", False, True)],
}
WANT = {  # attempt, events, requested, succeeded, failed, exit code, error
    "good": (0, 5, 2, 1, 1, 1, None), "pieces": (0, 4, 2, 2, 0, 0, None), "eof": (0, 3, 1, 1, 0, 0, None), "retried": (1, 3, 1, 1, 0, 0, None), "unretried": (0, 4, 2, 1, 1, 39, None),
    "endless": (0, 3, 1, 1, 0, 0, "the stream has no end"), "cut": (0, 2, 1, 1, 0, None, "the stream ends inside a frame"), "broken": (0, 0, 0, 0, 0, None, "a message ends inside a number"),
}


def test_stream_is_folded(spark, tmp_path):
    """Three triggers: chunks one after the other, then what comes too late."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    at, query = str(tmp_path / "in"), None
    empty = spark.createDataFrame([], CHUNK)
    empty.write.parquet(at)
    out = fold_chunks(spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 100).parquet(at), grace_ms=1500)
    query = out.writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()

    def told(n):
        end = time.time() + 90
        while time.time() < end:
            rows = spark.table("folded").collect()
            if len(rows) >= n or query.exception():
                return rows
            time.sleep(0.3)
        return spark.table("folded").collect()

    try:
        for k in range(3):
            rows = [(i, k, c[k][0], c[k][1], c[k][2]) for i, c in STREAMS.items() if k < len(c)]
            spark.createDataFrame(rows, CHUNK).coalesce(1).write.mode("append").parquet(at)
            if k == 0:
                assert len(told(4)) >= 4
        # One late row: what came after the stream that broke.
        got = {r.inv: r for r in told(len(STREAMS) + 1) if r.error != "late"}
        assert query.exception() is None
        assert {i: (r.attempt, r.events, r.requested, r.succeeded, r.failed_targets, r.exit_code, r.error) for i, r in got.items()} == WANT
        spark.createDataFrame([("good", 9, b"xyz", False, False)], CHUNK).coalesce(1).write.mode("append").parquet(at)
        late = [r for r in told(len(STREAMS) + 2) if r.error == "late"]
        assert sorted((r.inv, r.late_bytes) for r in late) == [("broken", 4), ("good", 3)]
    finally:
        query.stop()


def test_batch_is_the_stream(spark):
    """The table's fold of the same events gives the same outcomes."""
    rows = []
    for i, chunks in STREAMS.items():
        d = Decoder()
        rows += [(i, k, f) for k, f in enumerate(d.push(b"".join(c[0] for c in chunks)))]
    ev = B.events(spark.createDataFrame(rows, "inv string, ordinal long, frame binary"))
    got = {r.inv: (r.attempt, r.events, r.requested, r.succeeded, r.failed_targets, r.exit_code) for r in folds.outcomes(ev.where("event_error is null"), "inv").collect()}
    assert got == {i: w[:6] for i, w in WANT.items() if i != "broken"} | {"broken": got["broken"]}
    assert ev.where("event_error is not null").select("inv").collect() == [("broken",)]


def test_states_are_taken_or_refused(spark):
    edges = {"queued": ("running", "cancelled"), "running": ("succeeded", "failed", "cancelled")}
    log = [("a", 1, "queued"), ("a", 2, "running"), ("a", 3, "succeeded"), ("a", 4, "cancelled"), ("b", 1, "running"), ("b", 2, "queued"), ("b", 3, None), ("b", 4, "cancelled"), ("c", 1, "failed")]
    got = folds.current_states(spark.createDataFrame(log, "id string, n long, state string"), "id", "n", "state", edges, "queued")
    assert sorted(map(tuple, got.collect())) == [("a", "succeeded", 1), ("b", "cancelled", 2), ("c", None, 1)]


LOG = "id string, attempt int, version long, state string"


def test_replayed_batches_change_nothing(spark, tmp_path):
    seen = []
    log = DurableLog(str(tmp_path), LOG, "id", "version", "attempt", every=3, then=lambda df, n: seen.append((n, df.count())))
    batches = [[("a", 0, 1, "queued"), ("b", 0, 1, "queued")], [("a", 0, 9, "failed")], [("a", 1, 1, "queued")], [("b", 0, 3, "done"), ("b", 0, 2, "running")], [("c", 0, 1, "queued")]]
    for n, rows in enumerate(batches):
        log.write(spark.createDataFrame(rows, LOG), n)
        if n in (2, 4):  # the batch failed after its write and is run again
            log.write(spark.createDataFrame(rows, LOG), n)
    want = [("a", 1, 1, "queued"), ("b", 0, 3, "done"), ("c", 0, 1, "queued")]
    assert sorted(map(tuple, log.view(spark).collect())) == want
    assert log.log(spark).count() == 7 and log._snapshot(spark, None) == 2
    assert sorted(map(tuple, log.view(spark, 1).collect())) == [("a", 0, 9, "failed"), ("b", 0, 1, "queued")]
    assert [n for n, _ in seen] == [0, 1, 2, 2, 3, 4, 4]


def test_nothing_written_yet(spark, tmp_path):
    assert DurableLog(str(tmp_path / "none"), LOG, "id", "version").view(spark).count() == 0


def test_stream_into_the_log(spark, tmp_path):
    at = str(tmp_path / "in")
    spark.createDataFrame([("a", 0, 1, "x"), ("b", 0, 1, "y")], LOG).write.parquet(at)
    log = DurableLog(str(tmp_path / "out"), LOG, "id", "version", every=2)

    def go():
        q = spark.readStream.schema(LOG).parquet(at).writeStream.foreachBatch(log.write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(60)

    go()
    spark.createDataFrame([("a", 0, 2, "z")], LOG).write.mode("append").parquet(at)
    go()
    assert sorted(map(tuple, log.view(spark).collect())) == [("a", 0, 2, "z"), ("b", 0, 1, "y")]
