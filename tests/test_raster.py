"""Answers worked out by hand on a 3 x 10 raster, and on edge cases."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import assemblies, raster, sce, surrogates, trains, transitions
from pulsegrid.sources import tables as S

TOY = [[0, 1, 1, 0, 0, 1, 0, 0, 0, 1], [1, 1, 0, 0, 0, 0, 1, 0, 0, 0], [0, 0, 0, 0, 1, 1, 1, 0, 0, 0]]


@pytest.fixture(scope="module")
def toy(spark):
    s = S.dense_spikes(spark, TOY)
    r = spark.createDataFrame([("r", 3, 10, 1.0)], "recording_id string, n_cells int, n_frames int, sampling_rate double")
    return s, r, S.cells_of(s)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_rates_and_activity(toy):
    s, r, c = toy
    assert rows(raster.spike_rates(s, r, c), "cell", "rate") == [(0, 0.4), (1, 0.3), (2, 0.3)]
    assert [n for _, n in rows(raster.activity_sum(s, r), "frame", "n_cells_active")] == [1, 2, 1, 0, 1, 2, 2, 0, 0, 1]


def test_silent_cell_counts(spark, toy):
    s, r, _ = toy
    cells = spark.createDataFrame([("r", i) for i in range(4)], "recording_id string, cell int")
    assert rows(raster.spike_rates(s, r, cells), "cell", "rate")[3] == (3, 0.0)
    assert rows(raster.run_durations(s, cells), "cell", "durations")[3] == (3, [])


def test_intervals_and_runs(toy):
    s, r, c = toy
    assert rows(raster.isi_lists(s), "cell", "isi") == [(0, [1, 3, 4]), (1, [1, 5]), (2, [1, 1])]
    assert rows(raster.runs(s), "cell", "start_frame", "end_frame") == [(0, 1, 2), (0, 5, 5), (0, 9, 9), (1, 0, 1), (1, 6, 6), (2, 4, 6)]
    ids = {(c_, f): i for c_, f, i in rows(raster.transient_ids(s, r, c), "cell", "frame", "run_id")}
    assert ids[0, 1] == 0 and ids[0, 5] == 1 and ids[0, 9] == 2 and ids[0, 0] == -1 and len(ids) == 30


def test_bins(toy):
    s, r, _ = toy
    assert raster.bin_or(s, r, 5).count() == 30
    assert rows(raster.bin_sum(s, 5), "cell", "bin", "n") == [(0, 0, 2), (0, 1, 2), (1, 0, 2), (1, 1, 1), (2, 0, 1), (2, 1, 2)]


def test_sce(spark, toy):
    s, r, _ = toy
    thr = lambda t: spark.createDataFrame([("r", float(t))], "recording_id string, threshold double")
    e = sce.detect(s, r, 1, thr(2))
    assert rows(e, "start_frame", "end_frame") == [(1, 1), (5, 6)]
    assert rows(sce.sce_cells(s, e), "sce_id", "cell") == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)]
    assert [n for _, n in rows(raster.window_activity(s, r, 3), "frame", "n")] == [2, 2, 2, 2, 3, 3, 2]
    e = sce.detect(s, r, 3, thr(3))
    assert rows(e, "start_frame", "end_frame") == [(4, 7)]
    assert rows(sce.sce_cells(s, e), "cell") == [(0,), (1,), (2,)]


def test_event_open_at_the_end(spark):
    s = S.dense_spikes(spark, [[0] * 8 + [1, 1], [0] * 8 + [1, 1]])
    r = spark.createDataFrame([("r", 2, 10)], "recording_id string, n_cells int, n_frames int")
    thr = spark.createDataFrame([("r", 2.0)], "recording_id string, threshold double")
    assert rows(sce.detect(s, r, 1, thr), "start_frame", "end_frame") == [(8, 9)]
    assert rows(sce.detect(s, r, 1, thr, keep_open=False), "start_frame") == []


def test_transitions(toy):
    s, r, _ = toy
    got = {(a, b): (w, m) for a, b, w, m in rows(transitions.transitions(s, r, 1, 3), "src", "dst", "weight", "mean_lag")}
    assert got == {(0, 1): (1, 1.0), (0, 2): (2, 1.5), (1, 0): (2, 1.0), (2, 0): (1, 1.0), (2, 1): (2, 1.5)}


def test_roll_keeps_counts(toy):
    s, r, _ = toy
    n = surrogates.rolled(s, r, 7).groupBy("surr", "cell").agg(F.count_distinct("frame").alias("n"))
    assert {(c, k) for _, c, k in rows(n, "surr", "cell", "n")} == {(0, 4), (1, 3), (2, 3)}


def test_percentile_and_scaling(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "score double")
    assert raster.percentile_rank(d, 2.0).first()[0] == 75
    v = spark.range(1).select(trains.scaled(F.lit(0), 100).alias("v")).first()[0]
    assert v == pytest.approx(1.1111, abs=1e-4)


def test_train_distance(spark):
    t = spark.createDataFrame([("r", 0, 0.0), ("r", 0, 10.0), ("r", 1, 1.0), ("r", 1, 8.0)], "recording_id string, cell int, t double")
    assert rows(trains.train_distances(t), "i", "j", "d") == [(0, 1, 3.0)]


def test_activations(spark, toy):
    s, r, c = toy
    a = assemblies.activations(s, r, c.withColumn("cluster", F.lit(0)), 3, 0.9)
    assert rows(a, "cluster", "start_frame", "end_frame") == [(0, 4, 7)]


def test_empty_raster(spark, toy):
    _, r, _ = toy
    e = spark.createDataFrame([], S.SPIKES)
    assert raster.runs(e).count() == 0
    assert raster.activity_sum(e, r).agg(F.sum("n_cells_active")).first()[0] == 0
    assert transitions.transitions(e, r, 1, 3).count() == 0
