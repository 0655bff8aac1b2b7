"""Streaming event detection over ``(ts, cell)`` spikes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def activity(stream: DataFrame, bin_width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, n_cells): approximate distinct cells per time bin, closed by the watermark."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", bin_width)).agg(F.approx_count_distinct("cell", 0.01).alias("n_cells"))
    return w.select(F.col("window.start").alias("start"), "n_cells")


def activity_exact(stream: DataFrame, bin_width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, n_cells): exact distinct cells per bin, repeats dropped within the watermark."""
    bins = stream.withWatermark("ts", late).withColumn("bin", F.window("ts", bin_width))
    one = bins.dropDuplicates(["bin", "cell"])
    return one.groupBy("bin").agg(F.count("*").alias("n_cells")).select(F.col("bin.start").alias("start"), "n_cells")


def sliding_activity(stream: DataFrame, width: str, step: str, late: str = "10 minutes") -> DataFrame:
    """(start, n_cells): approximate distinct cells of sliding windows."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.approx_count_distinct("cell", 0.01).alias("n_cells"))
    return w.select(F.col("window.start").alias("start"), "n_cells")


def detect(frames: DataFrame, threshold: float) -> DataFrame:
    """(recording_id, start_frame, end_frame, peak): runs of frames at or over a threshold, emitted when they close.

    ``frames(recording_id, frame, n)`` arrives in order of frames per recording; the state is
    the open run. A gap in frames closes it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, peak = state.get if state.exists else (-1, -1, 0)
        out = []
        for pdf in batches:
            for f, n in pdf.sort_values("frame")[["frame", "n"]].itertuples(index=False):
                if start >= 0 and (n < threshold or f > last + 1):
                    out.append((key[0], start, last, peak))
                    start = -1
                if n >= threshold:
                    start, peak = (int(f), int(n)) if start < 0 else (start, max(peak, int(n)))
                    last = int(f)
        state.update((start, last, peak))
        yield pd.DataFrame(out, columns=["recording_id", "start_frame", "end_frame", "peak"])

    return frames.groupBy("recording_id").applyInPandasWithState(
        step, "recording_id string, start_frame int, end_frame int, peak int", "start int, last int, peak int", "append", GroupStateTimeout.NoTimeout
    )
