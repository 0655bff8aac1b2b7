import pandas as pd

from pulsegrid.operators import raster, sce
from pulsegrid.sources import files
from pulsegrid.sources import tables as S
from pulsegrid.streaming import events


def _run(df, tmp_path, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.sql("select * from out")


def test_stream_detects_what_the_batch_does(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    n = [0, 3, 4, 0, 0, 5, 1, 6, 6, 0]
    pd.DataFrame({"recording_id": "r", "frame": range(10), "n": n}).astype({"frame": "int32", "n": "int64"}).to_parquet(tmp_path / "a.parquet")
    s = spark.readStream.schema("recording_id string, frame int, n long").parquet(str(tmp_path) + "/*.parquet")
    out = _run(events.detect(s, 3), tmp_path)
    assert sorted(tuple(r)[1:] for r in out.collect()) == [(1, 2, 4), (5, 5, 5), (7, 8, 6)]


def test_stream_activity(spark, tmp_path):
    t = pd.to_datetime(["2024-01-01 00:05", "2024-01-01 00:10", "2024-01-01 00:10", "2024-01-01 01:10", "2024-01-01 05:00"], utc=True)
    pd.DataFrame({"ts": t, "cell": [1, 2, 2, 3, 9]}).to_parquet(tmp_path / "a.parquet", coerce_timestamps="us")
    s = spark.readStream.schema("ts timestamp, cell long").parquet(str(tmp_path) + "/*.parquet")
    out = _run(events.activity_exact(s), tmp_path)
    assert sorted(r.n_cells for r in out.collect()) == [1, 2]


def test_sequence_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([([1, 2, 3], [[5, 7, -1], [9, 11, 12]], 2), ([4, 5], [[1, 2]], None)], "cells array<int>, times array<array<int>>, category int")
    files.write_sequences([1, 2, 3, 4, 5], df, str(tmp_path / "s"))
    assert sorted(map(tuple, files.read_sequences(spark, str(tmp_path / "s")).collect())) == sorted(map(tuple, df.collect()))


def test_matrix_files(spark, tmp_path):
    (tmp_path / "a.ca2").write_text("1.5 2 3\n\n4 5 6\n")
    m = files.matrix_samples(files.read_matrix(spark, str(tmp_path / "a.ca2")))
    assert sorted((r.cell, r.frame, r.value) for r in m.collect())[:3] == [(0, 0, 1.5), (0, 1, 2.0), (0, 2, 3.0)]
    (tmp_path / "b.stim").write_text("0 2 1\n")
    assert sorted(map(tuple, files.read_stimulus(spark, str(tmp_path / "b.stim"), True).collect())) == [(0, 2), (1, 1)]


def test_no_redundancy_agrees_on_window_one(spark):
    s = S.dense_spikes(spark, [[0, 1, 1, 0, 1], [0, 1, 0, 0, 1]])
    r = spark.createDataFrame([("r", 2, 5)], "recording_id string, n_cells int, n_frames int")
    thr = spark.createDataFrame([("r", 2.0)], "recording_id string, threshold double")
    assert sce.detect(s, r, 1, thr).count() == 2
    assert raster.activity_sum(s, r).count() == 5
