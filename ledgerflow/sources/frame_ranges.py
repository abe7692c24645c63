"""Framed streams of any size by ranges of bytes, growing files as a stream, and digests that
tell whether what a stream saw is what the file holds.

A frame's place is known only from the lengths before it. So one task a file walks over the
lengths, skipping what is between them, and writes down runs of whole frames; the runs are then
read by as many tasks as there are. No file is ever held as one value."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .frames import MOST, Decoder, FrameError, _length, frame

RUN, PIECE = 64 << 20, 4 << 20
ENDS = "the stream ends inside a frame"
ROWS = "path string, ordinal bigint, offset bigint, frame binary, error string"
NAMES = ["path", "ordinal", "offset", "frame", "error"]


def _uri(path: str) -> str:
    """Spark writes file:/a, Arrow wants file:///a."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def opened(path: str):
    """A file of any file system that Arrow knows, by its URI, and its size."""
    system, at = fs.FileSystem.from_uri(_uri(path))
    return system.open_input_file(at), system.get_file_info(at).size


def runs(f, size: int, step: int = RUN, at: int = 0, ordinal: int = 0, most: int = MOST) -> Iterator[tuple[int, int, int, str | None]]:
    """(begin, end, first ordinal, error) of runs of whole frames from a border on, each of `step`
    bytes or little more. An error stands with the last run, which may be empty."""
    begin, first, base, buffer, error = at, ordinal, at, b"", None
    while at < size:
        if at + 10 > base + len(buffer):
            f.seek(at)
            base, buffer = at, f.read(1 << 16)
        try:
            head = _length(buffer, at - base)
        except FrameError as e:
            error = str(e)
            break
        if head and head[0] > most:
            error = f"a frame of {head[0]} bytes is over the limit"
        elif not head or base + head[1] + head[0] > size:
            error = ENDS
        if error:
            break
        at, ordinal = base + head[1] + head[0], ordinal + 1
        if at - begin >= step:
            yield begin, at, first, None
            begin, first = at, ordinal
    if at > begin or error:
        yield begin, at, first, error


def frames_of(path: str, begin: int, end: int, first: int) -> Iterator[pa.RecordBatch]:
    """The frames of a run, in batches of a few MB."""
    f, _ = opened(path)
    decoder, at, offset = Decoder(), begin, begin
    f.seek(begin)
    while at < end:
        piece = f.read(min(PIECE, end - at))
        at += len(piece)
        # A frame begins where the one before it ends: what is pending is the next one's head.
        frames = decoder.push(piece)
        if not piece or decoder.error:
            raise FrameError(f"{path} changed while it was read: {decoder.error or ENDS}")
        stops = at - len(decoder.pending)
        offsets = []
        for x in reversed(frames):
            stops -= len(x) + _head(len(x))
            offsets.append(stops)
        if frames:
            yield _batch(path, first, offsets[::-1], frames)
            first += len(frames)
    if decoder.pending:
        raise FrameError(f"{path} changed while it was read: {ENDS}")


def _head(n: int) -> int:
    return max(1, (n.bit_length() + 6) // 7)


def _batch(path, first, offsets, frames, error=None) -> pa.RecordBatch:
    n = len(frames)
    return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(range(first, first + n), pa.int64()), pa.array(offsets, pa.int64()), pa.array(frames, pa.binary()), pa.array([error] * n, pa.string())], NAMES)


def read_ranges(spark: SparkSession, path: str, partial: bool = True, step: int = RUN, tasks: int | None = None) -> DataFrame:
    """path, ordinal, offset, frame, error of all frames of the files at path, a task for each run of
    frames. With partial a file's first error is its last row (frame null); else it fails the
    query. An empty file gives no rows. Offsets count lengths as written in the fewest bytes."""
    def walk(batches):
        for b in batches:
            for name in b.column("path").to_pylist():
                f, size = opened(name)
                for begin, end, first, error in runs(f, size, step):
                    if error and not partial:
                        raise FrameError(f"{name}: {error}")
                    yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([x], pa.int64()) for x in (begin, end, first)), pa.array([error], pa.string())], ["path", "begin", "end", "first", "error"])

    def read(batches):
        for b in batches:
            for r in b.to_pylist():
                n = r["first"]
                for x in frames_of(r["path"], r["begin"], r["end"], n):
                    n += len(x)
                    yield x
                if r["error"]:
                    yield _batch(r["path"], n, [r["end"]], [None], r["error"])

    files = spark.read.format("binaryFile").load(path).select("path")  # contents are not read
    found = files.mapInArrow(walk, "path string, begin bigint, end bigint, first bigint, error string")
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(tasks, "path", "begin").mapInArrow(read, ROWS)


def write_frames(df: DataFrame, path: str, file: str, order: str, payload: str) -> None:
    """One framed file for each value of column `file`, its frames by column `order`. A task that is
    run again writes the same file anew. A null payload is an empty frame."""
    rows = df.select(F.col(file).cast("string").alias("file"), order, F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))

    def write(batches):
        name, out = None, None
        for b in batches:
            for n, x in zip(b.column("file").to_pylist(), b.column("payload").to_pylist()):
                if n != name:
                    if out is not None:
                        out.close()
                    system, at = fs.FileSystem.from_uri(_uri(path))
                    name, out = n, system.open_output_stream(f"{at}/{n}.frames")
                out.write(frame(x))
        if out is not None:
            out.close()
        yield from ()

    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    rows.repartition("file").sortWithinPartitions("file", order).mapInArrow(write, "file string").count()


class Run(InputPartition):
    def __init__(self, path: str, begin: int, end: int, first: int):
        self.path, self.begin, self.end, self.first = path, begin, end, first


class _Growing(DataSourceStreamReader):
    """Offsets are the last border that is there as a whole, and the ordinal after it; a frame that
    is still being written waits for the next batch. Planning reads lengths only."""

    def __init__(self, options):
        self.path, self.step = options["path"], int(options.get("step", RUN))
        self.at, self.ordinal = 0, 0

    def initialOffset(self):
        return {"at": 0, "ordinal": 0}

    def _walk(self, at, ordinal, size=None, step=1):
        f, there = opened(self.path)
        return runs(f, there if size is None else size, step, at, ordinal)

    def latestOffset(self, *_):
        for _, end, first, error in self._walk(self.at, self.ordinal):
            if error and error != ENDS:
                raise FrameError(f"{self.path}: {error}")
            if not error:
                self.at, self.ordinal = end, first + 1
        return {"at": self.at, "ordinal": self.ordinal}

    def partitions(self, start, end):
        return [Run(self.path, b, e, n) for b, e, n, _ in self._walk(start["at"], start["ordinal"], end["at"], self.step)]

    def read(self, partition):
        yield from frames_of(partition.path, partition.begin, partition.end, partition.first)

    def commit(self, end):
        pass


class GrowingFrames(DataSource):
    """spark.readStream.format("growing_frames").option("path", uri): the frames of a file that
    grows, in runs of `step` bytes. A replayed batch reads the same range again."""

    @classmethod
    def name(cls):
        return "growing_frames"

    def schema(self):
        return ROWS

    def streamReader(self, schema):
        return _Growing(self.options)


def digests(frames: DataFrame) -> DataFrame:
    """path, frames, bytes, digest of frames(path, offset, frame): 240 bits that don't depend on
    the order or the tasks, so the same sum serves a stream's running aggregate and a batch."""
    sha = F.sha2(F.concat(F.col("offset").cast("string").cast("binary"), F.lit(b":"), "frame"), 256)
    parts = [F.bit_xor(F.conv(F.substring(sha, 1 + 15 * k, 15), 16, 10).cast("bigint")) for k in range(4)]
    whole = F.concat_ws("", *(F.lpad(F.lower(F.hex(p)), 15, "0") for p in parts))
    return frames.where("frame IS NOT NULL").groupBy("path").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.octet_length("frame")).alias("bytes"), whole.alias("digest"))


def verified(seen: DataFrame, kept: DataFrame) -> DataFrame:
    """path, replay of each file of either side, both as digests() gives them: whether it must be read again, as
    the stream saw something else than the file holds, or nothing of it."""
    s, k = seen.alias("s"), kept.alias("k")
    same = (F.col("s.digest") == F.col("k.digest")) & (F.col("s.frames") == F.col("k.frames")) & (F.col("s.bytes") == F.col("k.bytes"))
    return s.join(k, F.col("s.path") == F.col("k.path"), "full").select(F.coalesce("s.path", "k.path").alias("path"), (~F.coalesce(same, F.lit(False))).alias("replay"))


def verified_frames(streamed: DataFrame, file: DataFrame) -> DataFrame:
    """The streamed frames of files that hold just these, and the file's own of all others."""
    found = verified(digests(streamed), digests(file))
    return streamed.join(found.where("not replay"), "path", "left_semi").unionByName(file.join(found.where("replay"), "path", "left_semi"))
