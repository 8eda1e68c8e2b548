"""Streams of frames: groups that complete by count, and hourly windows.

Frames of many files arrive interleaved. A group is emitted when as many distinct frames have come as
were announced; what is still open at the end of its time is reported as incomplete. State is the set of
frame numbers seen, as bits; on completion only the counts stay, so that late repeats don't open the group again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "site string, datetime string, n_frames int, received int, state string"
STATE = "seen binary, received int, n_frames int"


def complete_groups(frames: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """From a stream ``(site, datetime, n_frames, frame_idx)``: a row ``complete`` for each finished group.

    With ``timeout_ms`` a group that gets no frame for so long is reported as ``incomplete``.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    mode = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        def row(want, got, name):
            return pd.DataFrame([(*key, want, got, name)], columns=["site", "datetime", "n_frames", "received", "state"])

        seen, got, want = state.get if state.exists else (b"", 0, 0)
        done = got >= want > 0
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield row(want, got, "incomplete")
            return
        if done:  # late repeats of a group that was emitted
            return
        bits = np.unpackbits(np.frombuffer(seen, np.uint8), bitorder="little")
        for b in batches:
            if not len(b):
                continue
            idx = np.unique(b["frame_idx"].to_numpy(np.int64))
            want = max(want, int(b["n_frames"].max()))
            if idx[-1] >= len(bits):
                bits = np.concatenate([bits, np.zeros(idx[-1] + 1 - len(bits), np.uint8)])
            got += int((bits[idx] == 0).sum())
            bits[idx] = 1
        done = got >= want > 0
        state.update((b"" if done else np.packbits(bits, bitorder="little").tobytes(), got, want))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        if done:
            yield row(want, got, "complete")

    return frames.where("frame_idx is not null and frame_idx >= 0 and n_frames is not null").groupBy("site", "datetime").applyInPandasWithState(step, OUT, STATE, "append", mode)


def complete_batch(frames: DataFrame) -> DataFrame:
    """The same over a table, with the open groups as ``incomplete``."""
    f = frames.where("frame_idx is not null and frame_idx >= 0 and n_frames is not null")
    g = f.groupBy("site", "datetime").agg(F.max("n_frames").alias("n_frames"), F.countDistinct("frame_idx").cast("int").alias("received"))
    return g.withColumn("state", F.when(F.col("received") >= F.col("n_frames"), "complete").otherwise("incomplete"))


def hourly(rows: DataFrame, time_column: str, by: list[str], watermark: str | None = None) -> DataFrame:
    """Tumbling hours: counts per hour and key, for tables and (with a watermark) for streams."""
    d = rows.withWatermark(time_column, watermark) if watermark else rows
    g = d.groupBy(F.window(time_column, "1 hour"), *by).agg(F.count("*").alias("n"))
    return g.select(F.date_format("window.start", "yyyyMMddHH").alias("hour"), *by, "n")


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process all there is and stop; a restart goes on where it left off."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
