"""A ledger's folders with each fault."""

import json
import uuid

import pytest

from ledgerflow.sources.ledger import load_ledger

SCHEMA = "schema_version bigint, invocation struct<id: string, state: string>, payload_bytes bigint"


def new_id(ms, tail):
    return str(uuid.UUID(int=ms << 80 | 7 << 76 | 2 << 62 | tail))


def put(root, run, text, folder=None):
    u = uuid.UUID(run) if folder is None else None
    at = root / "invocations" / (folder or f"{(u.int >> 80) // 86_400_000:08x}/{u.bytes[15] & 15:02x}/{run}")
    at.mkdir(parents=True)
    if text is not None:
        (at / "manifest.json").write_text(text)


def test_ledger(spark, tmp_path):
    ids = [new_id(86_400_000 * 20_000 + k, 5 + k) for k in range(9)]
    good = lambda i: json.dumps({"schema_version": 1, "invocation": {"id": i, "state": "failed"}, "payload_bytes": 3})
    put(tmp_path, ids[0], good(ids[0]))
    put(tmp_path, ids[1], good(ids[1]))
    put(tmp_path, ids[2], None)  # never committed
    args = (spark, str(tmp_path), SCHEMA, "invocation.id", ("invocation.state",))
    rows = load_ledger(*args).collect()
    assert {(r.id, r.record.invocation.state, r.bytes) for r in rows} == {(i, "failed", len(good(i))) for i in ids[:2]}
    put(tmp_path, ids[3], json.dumps({"schema_version": 2, "runs": [1]}))
    put(tmp_path, ids[4], "{" + good(ids[4]))
    put(tmp_path, ids[5], good(ids[0]))
    put(tmp_path, ids[6], good(ids[6]), folder=f"00000001/00/{ids[6]}")
    put(tmp_path, ids[7], json.dumps({"schema_version": 1, "invocation": {"id": ids[7]}, "payload_bytes": 3}))
    put(tmp_path, ids[8], "")  # passed over, as its docstring says
    put(tmp_path, "x", good(ids[0]), folder="00004e20/05/some-name")
    got = {r.id: (r.error, r.record) for r in load_ledger(*args, strict=False).collect()}
    assert {k: e for k, (e, _) in got.items()} == {ids[0]: None, ids[1]: None, ids[3]: "unsupported 2", ids[4]: "corrupt", ids[5]: "another id", ids[6]: "misplaced", ids[7]: "corrupt", "some-name": "not a run"}
    assert all((e is None) == (r is not None) for e, r in got.values())
    with pytest.raises(Exception, match="unsupported 2|corrupt|another id|misplaced|not a run"):
        load_ledger(*args).select("id").collect()
