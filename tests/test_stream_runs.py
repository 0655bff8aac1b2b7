"""Streams in any order against the batch operators on the same rows."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import raster
from pulsegrid.streaming import runs as streams

HOUR = 3600
START = pd.Timestamp("2024-01-01", tz="UTC")


def folder(tmp_path, batches):
    """One file for each batch, in order of name and time."""
    import os

    (tmp_path / "in").mkdir()
    for i, b in enumerate(batches):
        f = tmp_path / "in" / f"{i:03d}.parquet"
        b.to_parquet(f, coerce_timestamps="us", index=False)
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(tmp_path / "in")


def collected(df, tmp_path, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in df.sparkSession.sql(f"select * from {name}").collect()], q


def read(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_session_runs_equal_batch_runs(spark, tmp_path):
    """Rows within the delay come in any order and more than once."""
    r = random.Random(1)
    rows = sorted({(c, f) for c in range(4) for f in r.sample(range(60), 30)})
    at = lambda f: START + pd.Timedelta(hours=f) + pd.Timedelta(minutes=r.randrange(60))
    batches = []
    for lo in range(0, 60, 12):  # in blocks of 12 hours, shuffled inside, some twice
        part = [x for x in rows if lo <= x[1] < lo + 12]
        part += r.sample(part, 5)
        r.shuffle(part)
        batches.append(pd.DataFrame({"recording_id": "r", "cell": [c for c, _ in part], "ts": [at(f) for _, f in part]}).astype({"cell": "int32"}))
    batches.append(pd.DataFrame({"recording_id": "end", "cell": pd.array([0], "int32"), "ts": [START + pd.Timedelta(days=30)]}))
    s = read(spark, folder(tmp_path, batches), "recording_id string, cell int, ts timestamp")
    got, _ = collected(streams.runs(s, HOUR, late="24 hours"), tmp_path, "session_runs")
    want = raster.runs(spark.createDataFrame([("r", *x) for x in rows], "recording_id string, cell int, frame int"))
    assert sorted(got) == sorted((x.recording_id, x.cell, x.start_frame, x.end_frame, x.length) for x in want.collect())


def test_session_runs_lose_rows_behind_the_watermark(spark, tmp_path):
    at = lambda h: START + pd.Timedelta(hours=h)
    one = lambda *h: pd.DataFrame({"recording_id": "r", "cell": pd.array([1] * len(h), "int32"), "ts": [at(x) for x in h]})
    s = read(spark, folder(tmp_path, [one(0, 1), one(50), one(51), one(2, 49), one(200)]), "recording_id string, cell int, ts timestamp")
    got, _ = collected(streams.runs(s, HOUR, late="5 hours"), tmp_path, "late_runs")
    assert sorted(x[2:] for x in got) == [(0, 1, 2), (49, 51, 3)]  # 45 hours were passed before the late rows came


@pytest.fixture
def rocks(spark):
    key, value = next(iter(streams.ROCKS.items()))
    spark.conf.set(key, value)
    yield spark
    spark.conf.unset(key)


def test_open_events_in_any_order(rocks, tmp_path):
    """Shuffled frames give the batch events; an event open at the end closes by its timer; state goes."""
    spark, r = rocks, random.Random(2)
    n = {rec: {f: r.choice([1, 4, 5, 6]) for f in range(200) if r.random() < 0.85} for rec in ("a", "b")}
    n["b"] |= {f: 9 for f in range(195, 200)}
    rows = [(rec, f, x) for rec, d in n.items() for f, x in d.items()]
    batches = []
    for lo in range(0, 200, 40):
        part = [x for x in rows if lo <= x[1] < lo + 40]
        r.shuffle(part)
        batches.append(part)
    batches += [[("clock", 400, 0)], [("clock", 500, 0)]]
    frames = [pd.DataFrame({"recording_id": [x[0] for x in b], "ts": [START + pd.Timedelta(seconds=x[1]) for x in b], "n": [x[2] for x in b]}) for b in batches]
    s = read(spark, folder(tmp_path, frames), "recording_id string, ts timestamp, n long")
    got, q = collected(streams.open_events(s, 4, 1000, late="60 seconds"), tmp_path, "opened")
    first = int(START.timestamp())
    busy = spark.createDataFrame([(rec, f, x) for rec, f, x in rows if x >= 4], "recording_id string, frame int, n int")
    want = []
    for run in raster.islands(busy, ["recording_id"]).collect():
        want.append((run.recording_id, run.start_frame, run.end_frame, max(n[run.recording_id][f] for f in range(run.start_frame, run.end_frame + 1))))
    assert sorted((a, b - first, c - first, d) for a, b, c, d in got) == sorted(want)
    assert any(x[0] == "b" and x[2] == 199 for x in want)


def test_open_events_wait_for_frames_that_come_early(rocks, tmp_path):
    spark = rocks
    f = lambda *x: pd.DataFrame({"recording_id": "r", "ts": [START + pd.Timedelta(seconds=s) for s, _ in x], "n": [v for _, v in x]})
    s = read(spark, folder(tmp_path, [f((5, 7), (4, 8)), f((3, 9), (2, 1)), f((6, 7)), f((500, 0)), f((900, 0))]), "recording_id string, ts timestamp, n long")
    got, _ = collected(streams.open_events(s, 5, 1000, late="10 seconds"), tmp_path, "early")
    first = int(START.timestamp())
    assert [(b - first, c - first, d) for _, b, c, d in got] == [(3, 6, 9)]
