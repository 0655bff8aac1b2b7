"""Pairs of cells counted by products of blocks, against plain counting, with blocks of a few cells."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import follow_blocks, surrogates, transitions
from pulsegrid.sources import tables as S

N = 40


def plain(spikes, low, high, n=N, skip=()):
    """{(src, dst): (weight, mean lag)}, by looking ahead from every spike."""
    at = {}
    for c, f in spikes:
        at.setdefault(c, set()).add(f)
    out = {}
    for c, f in spikes:
        for o, fs in at.items():
            seen = sorted(x for x in fs if max(0, f + low) <= x < min(f + high, n) and x not in skip)
            if o != c and seen:
                out.setdefault((c, o), []).append(seen[0] - f)
    return {k: (float(len(v)), sum(v) / len(v)) for k, v in out.items()}


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(follow_blocks, "MOST", 3)
    monkeypatch.setattr(follow_blocks, "LEAST", 3)
    monkeypatch.setattr(follow_blocks, "STRIP", 2)


@pytest.fixture
def raster(spark):
    rng = random.Random(4)
    rows = {"a": sorted({(rng.randrange(11), rng.randrange(-2, N + 3)) for _ in range(120)}), "b": sorted({(rng.randrange(5), rng.randrange(N)) for _ in range(30)})}
    s = spark.createDataFrame([(k, c, f) for k, v in rows.items() for c, f in v], S.SPIKES)
    return rows, s, spark.createDataFrame([("a", 11, N), ("b", 5, N)], "recording_id string, n_cells int, n_frames int")


def found(df, *names):
    return {(r.recording_id, r.src, r.dst): tuple(r[n] for n in names) for r in df.collect()}


def no_pairs_in_plan(df):
    """Pairs are neither joined nor grouped by Spark: what is shuffled are blocks."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "src" not in plan.split("MapInArrow", 1)[1] and "Aggregate" not in plan.split("MapInArrow", 1)[0]


def test_degrees_by_blocks(raster, few):
    rows, s, r = raster
    want = {}
    for k, v in rows.items():
        tied = {frozenset(p) for p in plain(v, 1, 3)}
        for c in {c for p in tied for c in p}:
            want[k, c] = sum(c in p for p in tied)
    got = transitions.transition_degrees(s, r, 1, 3)
    assert {(x.recording_id, x.node): x.degree for x in got.collect()} == want


def test_top_followers_by_blocks(raster, few):
    rows, s, r = raster
    want = {}
    for k, v in rows.items():
        edges = plain(v, 1, 3)
        for c in {a for a, _ in edges}:
            best = sorted((-w, d, m) for (a, d), (w, m) in edges.items() if a == c)[:2]
            want |= {(k, c, d): (-w, m, i + 1) for i, (w, d, m) in enumerate(best)}
    assert found(transitions.top_transitions(s, r, 1, 3, 2), "weight", "mean_lag", "rank") == want


def test_graph_files_take_few_edges(spark, raster, few, tmp_path):
    from pulsegrid.sources import graphs

    rows, s, r = raster
    top = transitions.top_transitions(s, r, 1, 3, 2).where("recording_id = 'a'")
    graphs.write_graph(top.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "weight"), str(tmp_path / "g"))
    back = {(int(x.src), int(x.dst)): x.weight for x in graphs.read_graph(spark, str(tmp_path / "g")).collect()}
    every = {k: w for k, (w, _) in plain(rows["a"], 1, 3).items()}
    assert back and all(every[k] == w for k, w in back.items()) and len(back) == 2 * len({a for a, _ in every})


def test_edge_filter_by_blocks(spark, raster, few):
    rows, s, r = raster
    s = s.where(f"frame >= 0 and frame < {N}")
    drawn = {}
    for x in surrogates.rolled(s, r, 20).collect():
        drawn.setdefault((x.recording_id, x.surr), []).append((x.cell, x.frame))
    want = {}
    for k in ("a", "b"):
        real = plain([x for x in rows[k] if 0 <= x[1] < N], 1, 3)
        null = [plain(drawn[k, i], 1, 3) for i in range(20)]
        for p, (w, m) in real.items():
            cut = float(np.percentile([n.get(p, (0.0,))[0] for n in null], 95))
            if w > cut:
                want[k, *p] = (w, m, pytest.approx(cut))
    assert want and found(transitions.significant_transitions(s, r, 1, 3, 20), "weight", "mean_lag", "cut") == want


def test_blocks_are_sent_in_proportion_to_the_spikes(spark):
    """Five times the cells are dealt to as many blocks, so that each is sent as often."""

    def meetings(cells):
        s = spark.range(cells).select(F.lit("r").alias("recording_id"), F.col("id").cast("int").alias("cell"), (F.col("id") % 9).cast("int").alias("frame"))
        r = spark.createDataFrame([("r", cells, 2000)], "recording_id string, n_cells int, n_frames int")
        pairs = transitions.top_transitions(s, r, 1, 3, 1)._jdf.queryExecution().optimizedPlan().toString()
        return int(pairs.split("RepartitionByExpression", 1)[1].split("\n", 1)[0].rsplit(", ", 1)[1])

    assert meetings(2000) == meetings(10000) > 12


def test_no_reverse_by_parts_without_lags(raster, few):
    rows, s, r = raster
    want = {}
    for k, v in rows.items():
        edges = plain(v, 1, 3)
        want |= {(k, a, d): (w - edges.get((d, a), (0.0,))[0],) for (a, d), (w, _) in edges.items() if w > edges.get((d, a), (0.0,))[0]}
    got = transitions.transitions(s, r, 1, 3, no_reverse=True, lags=False)
    assert got.columns == ["recording_id", "src", "dst", "weight"] and found(got, "weight") == want


def test_blocks_are_packed_before_they_are_sent(spark, raster):
    rng = random.Random(6)
    for kind, frames in ((pa.int32(), range(-3, 700)), (pa.int64(), [-(2**63), 2**63 - 1, 2**40, -5, 0])):
        cells = [{"cell": c, "frames": sorted(rng.choices(frames, k=rng.randrange(1, 90))), "rate": None if c == 4 else c / 7} for c in rng.sample(range(300), 200)]
        searched = [dict(c, searched=[x % 2 == 0 for x in c["frames"]]) for c in cells]
        for rows in (cells, searched):
            fields = [("cell", pa.int32()), ("frames", pa.list_(kind)), ("rate", pa.float64()), ("searched", pa.list_(pa.bool_()))][: 3 + (rows is searched)]
            block = follow_blocks.pack(pa.array([{"cell": -1, "frames": [9]}, *rows], pa.struct(fields)).slice(1))
            assert follow_blocks.unpack(pa.py_buffer(block)).to_pylist() == [{k: r[k] for k in ("cell", "rate", *["searched"] * (rows is searched), "frames")} for r in sorted(rows, key=lambda r: r["cell"])]
        if kind == pa.int32():
            assert len(follow_blocks.pack(pa.array(cells, pa.struct(fields[:3])))) < 2 * sum(len(c["frames"]) for c in cells)
    _, s, r = raster
    plan = transitions.top_transitions(s, r, 1, 3, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan.split("RepartitionByExpression", 1)[1]


def test_surrogate_counts_are_kept_in_place_and_not_sorted(monkeypatch):
    rng = np.random.default_rng(8)
    cells = [{"cell": c, "frames": [int(f) for f in rng.integers(-3, N + 3, 30)]} for c in range(7)]
    side = follow_blocks.Side(pa.array(cells, pa.struct([("cell", pa.int32()), ("frames", pa.list_(pa.int32()))])), N)
    t, x = side.sources()
    for low, high in ((1, 3), (-2, 2), (N, N + 2), (-N - 5, -N)):
        hit, lag = follow_blocks.follows(side.raster(), t, low, high)
        for i, c in enumerate(cells):
            first = [min((f for f in c["frames"] if max(0, u + low) <= f < min(u + high, N)), default=None) for u in t]
            assert hit[i].tolist() == [f is not None for f in first] and all(f is None or lag[i, j] == f - t[j] for j, f in enumerate(first))
    offsets = rng.integers(0, N, 7)
    moved = (side.frames + offsets[side.at]) % N
    want, n = np.unique(moved), np.zeros((7, N))
    np.add.at(n, (side.at, moved), 1)
    monkeypatch.delattr(np, "unique")
    t, x = side.sources(offsets)
    assert (t == want).all() and (x == n[:, want]).all()
    for most in (1, 2, 4):
        drawn, held = rng.integers(0, 9, (12, 3, 5)), np.zeros((most, 3, 5), np.float32)
        for d in drawn:
            transitions.keep_largest(held, d.astype(np.float32))
        assert (held == -np.sort(-drawn, axis=0)[:most]).all()
