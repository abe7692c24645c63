"""Streaming decode: chunks of framed streams to events, with the pending bytes as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.frames import Decoder


def decode_chunks(chunks: DataFrame) -> DataFrame:
    """chunks(inv, seq, data) -> inv, ordinal, frame, error. Chunks of a stream are taken in
    the order of seq within a trigger; bytes after a stream's first error are ignored."""
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, ordinal, error = state.get if state.exists else (b"", 0, None)
        decoder = Decoder(bytes(pending))
        decoder.error = error
        rows = pd.concat(list(parts)).sort_values("seq")
        for data in rows["data"]:
            frames = decoder.push(bytes(data))
            fresh = decoder.error if decoder.error and not error else None
            n = len(frames)
            if n or fresh:
                yield pd.DataFrame({"inv": [key[0]] * (n + bool(fresh)), "ordinal": range(ordinal, ordinal + n + bool(fresh)), "frame": frames + [None] * bool(fresh), "error": [None] * n + [fresh] * bool(fresh)})
            ordinal += n
            error = decoder.error
        state.update((decoder.pending, ordinal, error))

    return chunks.groupBy("inv").applyInPandasWithState(run, "inv string, ordinal bigint, frame binary, error string", "pending binary, ordinal bigint, error string", "append", GroupStateTimeout.NoTimeout)
