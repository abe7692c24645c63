"""Varint-framed event streams: encoding, decoding in pieces, and a batch source."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MOST = 64 << 20


class FrameError(ValueError):
    pass


def frame(payload: bytes) -> bytes:
    n, head = len(payload), bytearray()
    while n >= 0x80:
        head.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(head) + bytes([n]) + payload


def _length(data: bytes, at: int) -> tuple[int, int] | None:
    """The length at a place and where its frame begins; None if more bytes are needed."""
    value = 0
    for k in range(10):
        if at + k >= len(data):
            return None
        b = data[at + k]
        if k == 9 and b > 1:
            raise FrameError("a length has more than 64 bits")
        value |= (b & 0x7F) << 7 * k
        if b < 0x80:
            return value, at + k + 1
    raise FrameError("a length has more than 10 bytes")


class Decoder:
    """Frames of a stream that comes in pieces of any size. After an error nothing more is
    decoded; what was complete before it stays valid."""

    def __init__(self, pending: bytes = b"", most: int = MOST):
        self.pending, self.most, self.error = pending, most, None

    def push(self, piece: bytes) -> list[bytes]:
        if self.error:
            return []
        data, at, out = self.pending + piece, 0, []
        try:
            while at < len(data) and (head := _length(data, at)):
                n, begin = head
                if n > self.most:
                    raise FrameError(f"a frame of {n} bytes is over the limit")
                if begin + n > len(data):
                    break
                out.append(data[begin:begin + n])
                at = begin + n
        except FrameError as e:
            self.error = str(e)
        self.pending = data[at:]
        return out

    def finish(self) -> str | None:
        if not self.error and self.pending:
            self.error = "the stream ends inside a frame"
        return self.error


def read_frames(spark: SparkSession, path: str, partial: bool = True) -> DataFrame:
    """path, ordinal, frame, error of all frames of the files at path. With partial a file's
    first error is its last row; else it fails the query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                d = Decoder()
                frames = d.push(content)
                error = d.finish()
                if error and not partial:
                    raise FrameError(f"{name}: {error}")
                n = len(frames) + bool(error)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(n), pa.int64()), pa.array(frames + [None] * bool(error), pa.binary()), pa.array([None] * len(frames) + [error] * bool(error), pa.string())], ["path", "ordinal", "frame", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, ordinal bigint, frame binary, error string")
