"""Runs and events on unordered streams: session windows, and a state machine with timers.

Both give what the batch operators give on the same rows, once the watermark has passed
them, and keep nothing of what is closed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

#: State stores of ``open_events``: list and map state need this one.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def runs(stream: DataFrame, bin_seconds: int, start: str = "2024-01-01 00:00:00", late: str = "1 hour", by: tuple[str, ...] = ("recording_id", "cell")) -> DataFrame:
    """(*by, start_frame, end_frame, length): maximal runs of consecutive time bins of each cell.

    ``stream(*by, ts)`` in any order. A bin is a session that lasts one bin and a half, so
    the bin after it falls in and the one after that does not; a run is emitted when the
    watermark, ``late`` behind the newest bin, has passed it. Rows later than that are lost.
    Repeated rows change nothing.
    """
    at = F.floor(F.unix_micros("ts") / (bin_seconds * 1_000_000)) * bin_seconds
    bins = stream.select(*by, F.timestamp_seconds(at).alias("bin")).withWatermark("bin", late)
    gap = bin_seconds * 1500
    held = bins.groupBy(*by, F.session_window("bin", f"{gap} milliseconds").alias("w")).agg(F.count("*").alias("n"))
    first = F.unix_millis(F.to_timestamp(F.lit(start)))
    frame = lambda t: F.floor((t - first) / (bin_seconds * 1000)).cast("int")
    out = held.select(*by, frame(F.unix_millis("w.start")).alias("start_frame"), frame(F.unix_millis("w.end") - gap).alias("end_frame"))
    return out.withColumn("length", F.col("end_frame") - F.col("start_frame") + 1)


OPEN = StructType([StructField("start", LongType()), StructField("last", LongType()), StructField("peak", LongType())])
WAITING = StructType([StructField("frame", LongType()), StructField("n", LongType())])
EVENT = StructType([StructField("recording_id", StringType()), StructField("start_frame", IntegerType()), StructField("end_frame", IntegerType()), StructField("peak", LongType())])


class OpenEvents(StatefulProcessor):
    """The events of one recording: frames wait until the watermark has passed them, then open, prolong or close an event in order.

    A frame is final when the watermark passes its end. Timers stand at the end of the
    first waiting frame, and, with an event open, at the end of the frame that could
    prolong it; when neither is left, the recording has no state.
    """

    def __init__(self, threshold: float, frame_ms: int):
        self.threshold, self.frame_ms = threshold, frame_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.open = handle.getValueState("open", OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [(int(f), int(n)) for pdf in rows for f, n in zip(pdf["frame"], pdf["n"], strict=True)]
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer((min(fresh)[0] + 1) * self.frame_ms)
        yield pd.DataFrame(columns=[f.name for f in EVENT])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // self.frame_ms  # frames below are final
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        later = [x for x in waiting if x[0] >= passed]
        event = tuple(self.open.get()) if self.open.exists() else None
        out = []
        for f, n in (x for x in waiting if x[0] < passed):
            if event and (n < self.threshold or f > event[1] + 1):
                out.append(event)
                event = None
            if n >= self.threshold:
                event = (event[0], f, max(event[2], n)) if event else (f, f, n)
        if event and event[1] + 1 < passed:  # the frame that could prolong it is final, and was not busy
            out.append(event)
            event = None
        self.waiting.clear()
        self.open.clear()
        if later:
            self.waiting.put(later)
            self.handle.registerTimer((later[0][0] + 1) * self.frame_ms)
        if event:
            self.open.update(event)
            self.handle.registerTimer((event[1] + 2) * self.frame_ms)
        yield pd.DataFrame([(key[0], a, b, p) for a, b, p in out], columns=[f.name for f in EVENT]).astype({"start_frame": "int32", "end_frame": "int32", "peak": "int64"})

    def close(self) -> None:
        pass


def open_events(stream: DataFrame, threshold: float, frame_ms: int, late: str = "10 seconds") -> DataFrame:
    """(recording_id, start_frame, end_frame, peak): runs of frames at or over a threshold.

    ``stream(recording_id, ts, n)`` has one row for each frame that has any activity, in any
    order; frames are counted in ``frame_ms`` from 1970 on. A frame that never comes is a
    silent one. Needs the state stores of ``ROCKS``.
    """
    frames = stream.select("recording_id", "ts", F.floor(F.unix_millis("ts") / frame_ms).cast("long").alias("frame"), F.col("n").cast("long").alias("n"))
    return frames.withWatermark("ts", late).groupBy("recording_id").transformWithStateInPandas(
        statefulProcessor=OpenEvents(threshold, frame_ms), outputStructType=EVENT, outputMode="Append", timeMode="EventTime"
    )
