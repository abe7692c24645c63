"""Incremental fold of framed streams: each run's outcome once its stream has ended.

Chunks of a run's stream are decoded as they come; events go into the state and are dropped.
A run is told when its process has ended and its stream is whole (the last event is marked,
or the source says there is no more). If the process ended first, the rest may come within a
grace; a timer tells the run with an error else. A build that says it is retried resets what
was counted, but keeps it in case no event follows. What comes after a run was told, or after
a frame that can't be decoded, is counted as late and changes nothing.

Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor

from ..operators.folds import RETRIED
from ..sources.build_events import event
from ..sources.frames import Decoder, FrameError

OUT = "inv string, attempt int, events bigint, requested bigint, succeeded bigint, failed_targets bigint, exit_code int, bytes bigint, error string, late_bytes bigint"
_HEAD = "pending binary, error string, attempt int, events bigint, exit_code int, marked boolean, eof boolean, ended boolean, told boolean, bytes bigint, saved string"
GRACE_MS = 2_000


class Fold(StatefulProcessor):
    """State of a run: a head (what is pending, counts and marks) and a map of its targets,
    which may be many."""

    def __init__(self, grace_ms: int = GRACE_MS):
        self.grace_ms = grace_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", _HEAD)
        self.targets = handle.getMapState("targets", "label string", "success boolean")

    def handleInputRows(self, key, rows, timerValues):
        h = self.head.get() if self.head.exists() else (b"", None, 0, 0, None, False, False, False, False, 0, None)
        pending, error, attempt, n, code, marked, eof, ended, told, size, saved = h
        late = 0
        decoder = Decoder(bytes(pending))
        decoder.error = error
        for r in sorted(rows, key=lambda r: r.seq):
            data = bytes(r.data or b"")
            if told or decoder.error:
                late += len(data)
                continue
            size += len(data)
            eof, ended = eof or bool(r.eof), ended or bool(r.exit)
            for frame in decoder.push(data):
                try:
                    _, label, _, kind, last, success, exit_code, *_ = event(frame)
                except FrameError as e:
                    decoder.error = str(e)
                    break
                n, marked = n + 1, marked or last
                if kind == "completed":
                    label = label or "<unknown>"
                    if not self.targets.containsKey((label,)):
                        self.targets.updateValue((label,), (bool(success),))
                if kind == "finished":
                    code = exit_code
                    if code == RETRIED:
                        saved = ",".join(map(str, (attempt, n, *self._counted())))
                        self.targets.clear()
                        attempt, n, code, marked = attempt + 1, 0, None, False
        if told:
            if late:
                yield Row(inv=key[0], attempt=None, events=None, requested=None, succeeded=None, failed_targets=None, exit_code=None, bytes=None, error="late", late_bytes=late)
            return
        self.head.update((decoder.pending, decoder.error, attempt, n, code, marked, eof, ended, False, size, saved))
        if decoder.error or ((marked or eof) and ended):
            yield from self._tell(key, decoder, late)
        elif ended:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.grace_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.head.exists() and not self.head.get()[8]:
            decoder = Decoder(bytes(self.head.get()[0]))
            decoder.finish()
            decoder.error = decoder.error or "the stream has no end"
            yield from self._tell(key, decoder, 0)

    def _counted(self) -> tuple[int, int, int]:
        values = [bool(v[0]) for v in self.targets.values()]
        return len(values), sum(values), len(values) - sum(values)

    def _tell(self, key, decoder: Decoder, late: int):
        _, _, attempt, n, code, marked, eof, ended, _, size, saved = self.head.get()
        decoder.finish()
        counts = self._counted()
        if n == 0 and saved:  # the retry told nothing: what was before it stands
            attempt, n, *counts = map(int, saved.split(","))
            code = RETRIED
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.targets.clear()
        self.head.update((b"", decoder.error, attempt, n, code, marked, eof, ended, True, size, None))
        yield Row(inv=key[0], attempt=attempt, events=n, requested=counts[0], succeeded=counts[1], failed_targets=counts[2], exit_code=code, bytes=size, error=decoder.error, late_bytes=late)

    def close(self) -> None:
        pass


def fold_chunks(chunks: DataFrame, grace_ms: int = GRACE_MS) -> DataFrame:
    """chunks(inv, seq, data, eof: the source has no more, exit: the process has ended) -> OUT, a
    row for each run when it is told."""
    return chunks.groupBy("inv").transformWithState(Fold(grace_ms), OUT, "Append", "ProcessingTime")
