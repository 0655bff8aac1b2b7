"""Adapters from event tables to the engine's long tables.

``spikes(recording_id, cell, frame)`` holds one row per active (cell, frame);
``recordings(recording_id, n_cells, n_frames, sampling_rate)`` carries the extent, so
that silent cells and frames count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPIKES = T.StructType([T.StructField("recording_id", T.StringType()), T.StructField("cell", T.IntegerType()), T.StructField("frame", T.IntegerType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_spikes(events: DataFrame, bin_seconds: int = 3600, start: str = "2024-01-01 00:00:00", recording_id: str = "events") -> DataFrame:
    """Distinct (user, time bin) of an events table."""
    seconds = F.expr(f"timestampdiff(SECOND, timestamp_ntz'{start}', cast(ts as timestamp_ntz))")
    return events.where("ts is not null and user_id is not null").select(
        F.lit(recording_id).alias("recording_id"), F.col("user_id").cast("int").alias("cell"), F.floor(seconds / bin_seconds).cast("int").alias("frame")
    ).distinct()


def ship_day_spikes(lineitem: DataFrame, start: str = "1995-01-01", recording_id: str = "shipments", distinct: bool = True) -> DataFrame:
    """Distinct (supplier, ship day), or one for each line."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit(start).cast("date"))
    s = lineitem.select(F.lit(recording_id).alias("recording_id"), F.col("l_suppkey").cast("int").alias("cell"), day.cast("int").alias("frame"))
    return s.distinct() if distinct else s


def event_traces(events: DataFrame, recording_id: str = "events") -> DataFrame:
    """(recording_id, cell, frame, value): each user's values in time order, the row index as frame."""
    from pyspark.sql import Window as W

    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.lit(recording_id).alias("recording_id"), F.col("user_id").cast("int").alias("cell"), (F.row_number().over(order) - 1).cast("int").alias("frame"), "value"
    )


def recordings_of(spikes: DataFrame, n_frames: int, sampling_rate: float = 1.0) -> DataFrame:
    """Extent of recordings whose cells are those that occur."""
    return spikes.groupBy("recording_id").agg(F.count_distinct("cell").cast("int").alias("n_cells")).select(
        "recording_id", "n_cells", F.lit(n_frames).alias("n_frames"), F.lit(float(sampling_rate)).alias("sampling_rate")
    )


def cells_of(spikes: DataFrame) -> DataFrame:
    return spikes.select("recording_id", "cell").distinct()


def dense_spikes(spark: SparkSession, matrix, recording_id: str = "r") -> DataFrame:
    """Spikes of a small dense matrix (rows are cells; values over 0 count)."""
    rows = [(recording_id, i, j) for i, row in enumerate(matrix) for j, v in enumerate(row) if v > 0]
    return spark.createDataFrame(rows, SPIKES)


def binarise(samples: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Spikes of a non-binary raster ``(recording_id, cell, frame, value)``."""
    return samples.where(F.col("value") > threshold).select("recording_id", "cell", "frame")
