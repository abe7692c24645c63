"""Framed files by ranges and as they grow, held against the decoder that reads them whole."""

import random

import pytest

from ledgerflow.sources import frame_ranges as R
from ledgerflow.sources.frames import Decoder, FrameError, frame


def written(tmp_path, name, frames, tail=b""):
    data = b"".join(map(frame, frames)) + tail
    (tmp_path / name).write_bytes(data)
    return data


def some(n, seed=1):
    r = random.Random(seed)
    return [r.randbytes(r.choice([0, 1, 50, 127, 128, 300, 20_000])) for _ in range(n)]


@pytest.mark.parametrize("step", [1, 1000, 100_000, 1 << 30])
def test_ranges_agree_with_the_decoder(spark, tmp_path, step):
    one, two = some(200), some(70, 2)
    whole = written(tmp_path, "one", one)
    written(tmp_path, "two", two, tail=b"\x05abc")
    written(tmp_path, "three", [])
    rows = R.read_ranges(spark, str(tmp_path), step=step).orderBy("path", "ordinal").collect()
    got = {n: [r for r in rows if r.path.endswith(n)] for n in ("one", "two", "three")}
    assert [bytes(r.frame) for r in got["one"]] == one == Decoder().push(whole) and [r.ordinal for r in got["one"]] == list(range(200))
    assert all(whole[r.offset:].startswith(frame(bytes(r.frame))) for r in got["one"])
    assert [bytes(r.frame) for r in got["two"][:-1]] == two and got["two"][-1].frame is None
    assert got["two"][-1].error == R.ENDS and got["two"][-1].ordinal == 70 and got["three"] == []
    with pytest.raises(Exception, match=R.ENDS):
        R.read_ranges(spark, str(tmp_path), partial=False, step=step).collect()


def test_runs_of_bad_lengths():
    import io
    good = frame(b"abc") * 3
    for bad, said in ((b"\xff" * 11, "more than"), (frame(b"")[:0] + b"\xff\xff\xff\xff\x7f", "over the limit"), (b"\x80", R.ENDS)):
        data = good + bad
        got = list(R.runs(io.BytesIO(data), len(data)))
        assert got[-1][:3] == (0, 12, 0) and said in got[-1][3]
    assert list(R.runs(io.BytesIO(b""), 0)) == []
    assert [x[:3] for x in R.runs(io.BytesIO(good), 12, step=4, at=4, ordinal=1)] == [(4, 8, 1), (8, 12, 2)]


def test_a_file_that_changed_is_told(tmp_path):
    written(tmp_path, "x", [b"abc", b"defg"])
    with pytest.raises(FrameError):
        list(R.frames_of(str(tmp_path / "x"), 0, 7, 0))
    with pytest.raises(FrameError):
        list(R.frames_of(str(tmp_path / "x"), 0, 90, 0))


def test_a_growing_file_and_its_digest(spark, tmp_path):
    spark.dataSource.register(R.GrowingFrames)
    frames, at = some(60, 3), tmp_path / "grows"
    data = b"".join(map(frame, frames))
    cuts = [len(data) // 3 + 5, 2 * len(data) // 3 + 1, len(data)]
    seen, state = str(tmp_path / "seen"), str(tmp_path / "state")
    for cut in cuts:  # each start goes on from the checkpoint, in the middle of a frame or not
        at.write_bytes(data[:cut])
        q = (spark.readStream.format("growing_frames").option("path", str(at)).option("step", "20000").load()
             .writeStream.format("parquet").option("path", seen).option("checkpointLocation", state).trigger(availableNow=True).start())
        q.awaitTermination(60)
        assert q.exception() is None
        q.stop()
    got = spark.read.parquet(seen)
    assert [bytes(r.frame) for r in got.orderBy("ordinal").collect()] == frames
    file = R.read_ranges(spark, str(at), step=10_000).withColumn("path", R.F.lit(str(at)))
    assert R.verified(R.digests(got), R.digests(file)).first().replay is False
    lost = got.where("ordinal <> 7")
    assert R.verified(R.digests(lost), R.digests(file)).first().replay is True
    for streamed in (got, lost, got.limit(0)):
        assert [bytes(r.frame) for r in R.verified_frames(streamed, file).orderBy("ordinal").collect()] == frames
