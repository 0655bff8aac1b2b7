"""Cutting lineage durably, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session names no folder, as in tests.
FALLBACK = "/tmp/checkpoints/pulsegrid"


def shared_place(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that all executors share; what is put there goes with the session's JVM."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{(folder or FALLBACK).rstrip('/')}/pulsegrid-{kind}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def durable(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read back from there.

    What made them is not run again, also where executors are lost; the files go with the
    session's JVM. (A checkpoint would compute the rows twice.)
    """
    path = shared_place(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
