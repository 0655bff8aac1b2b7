"""Distributions, sweep lines, movies, table functions, sinks and the catalogue of fits against plain versions."""

import os
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import tables as functions
from pulsegrid.operators import assemblies, distributions, movies, spatial, sweeps
from pulsegrid.operators import raster, sce
from pulsegrid.operators.surrogates import rolled
from pulsegrid.sources import graphs, results


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def uneven(spark):
    """Groups of very different size, with ties, one value, nulls, and a null group."""
    r = random.Random(1)
    rows = [("big", round(r.expovariate(0.2), 1)) for _ in range(3000)] + [("tied", float(r.randrange(3))) for _ in range(200)]
    rows += [("one", 4.5), ("same", 2.0), ("same", 2.0), ("two", 1.0), ("two", 8.0), ("none", None), (None, 3.0), (None, 5.0), ("big", None)]
    return rows, frame(spark, rows, "g string, v double")


def groups(rows):
    out = {}
    for g, v in rows:
        if v is not None:
            out.setdefault(g, []).append(v)
    return out


def test_histogram_equals_numpy(uneven):
    rows, df = uneven
    got = {}
    for r in distributions.histogram(df, "v", ["g"], bins=17).collect():
        got.setdefault(r.g, []).append((r.bin, r.left_edge, r.right_edge, r.n, r.percent))
    want = groups(rows)
    assert got.keys() == want.keys()
    for g, v in want.items():
        n, edges = np.histogram(v, 17)
        out = sorted(got[g])
        assert [x[0] for x in out] == list(range(17)) and [x[3] for x in out] == n.tolist()
        assert [x[1] for x in out] + [out[-1][2]] == pytest.approx(edges.tolist())
        assert sum(x[4] for x in out) == pytest.approx(100)


def test_bins_by_factor_and_marks(spark, uneven):
    _, df = uneven
    n = {r.g: r.n for r in distributions.histogram(df, "v", ["g"], factor=2).groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert n["one"] == 9 and n["two"] == 16 and n["same"] == 4
    marks = frame(spark, [("two", 8.0), ("two", 1.0), ("two", 99.0), ("one", None)], "g string, mark double")
    got = distributions.histogram(df, "v", ["g"], bins=4, marks=marks).where("n_marks > 0").collect()
    assert sorted((r.g, r.bin, r.n_marks) for r in got) == [("two", 0, 1), ("two", 3, 1)]
    assert distributions.histogram(df.where("false"), "v", ["g"], bins=3).count() == 0


def test_share_cut(spark):
    h = frame(spark, [("a", i, float(i), i + 1.0, n) for i, n in enumerate([10, 20, 0, 30, 40])] + [("b", 0, 0.0, 2.0, 5)], "g string, bin int, left_edge double, right_edge double, n long")
    got = {r.g: tuple(r)[1:] for r in distributions.share_cut(h, 45, ["g"]).collect()}
    assert got["a"] == (3, 3, pytest.approx(3.5)) and got["b"] == (0, 0, pytest.approx(0.9))
    assert {r.g: tuple(r)[1:] for r in distributions.share_cut(h, 30, ["g"]).collect()}["a"] == (1, None, 2.0)  # reached on an edge


def test_quantiles_and_boxes_equal_numpy(uneven):
    rows, df = uneven
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r.g, r.share): r.q for r in distributions.quantiles(df, "v", shares, ["g"], bins=8).collect()}
    want = {(g, s): np.quantile(v, s) for g, v in groups(rows).items() for s in shares}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    box = {r.g: r for r in distributions.boxes(df, "v", ["g"]).collect()}
    beyond = Counter((r.g, r.v) for r in distributions.outliers(df, "v", ["g"]).collect())
    plain = Counter()
    for g, v in groups(rows).items():
        q1, m, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        reach = 1.5 * (q3 - q1)
        lo, hi = min(q1, min(x for x in v if x >= q1 - reach)), max(q3, max(x for x in v if x <= q3 + reach))
        assert tuple(box[g])[1:] == (len(v), *map(pytest.approx, (np.mean(v), q1, m, q3, lo, hi)))
        plain.update((g, x) for x in v if x < lo or x > hi)
    assert beyond == plain and plain
    quick = {r.g: r for r in distributions.quick_boxes(df, "v", ["g"]).collect()}
    assert quick["big"].median == pytest.approx(box["big"].median, abs=0.2) and quick["big"].n == 3000
    assert distributions.quantiles(df, "v", [0.5]).first().q == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_sparse_percentile_equals_dense(spark):
    r = random.Random(2)
    dense = {g: [r.choice([0, 0, 0, 1, 2, 5]) for _ in range(n)] for g, n in (("a", 40), ("b", 7), ("c", 1))} | {"quiet": [0] * 5}
    counts = [(g, x, n) for g, v in dense.items() for x, n in Counter(v).items() if x]
    totals = frame(spark, [(g, len(v)) for g, v in dense.items()], "g string, total long")
    for p in (5, 50, 95, 100):
        got = {x.g: x.threshold for x in distributions.sparse_percentile(frame(spark, counts, "g string, n long, times long"), "n", "times", totals, ["g"], p).collect()}
        assert got == {g: pytest.approx(np.percentile(v, p)) for g, v in dense.items()}


@pytest.mark.parametrize("window", [1, 4])
def test_thresholds_count_silent_windows(spark, window):
    """Percentiles over the stored and the silent windows equal those over all windows laid out."""
    r = random.Random(3)
    s = frame(spark, [("r", c, f) for c in range(6) for f in r.sample(range(200), 5)], "recording_id string, cell int, frame int")
    rec = frame(spark, [("r", 6, 200)], "recording_id string, n_cells int, n_frames int")
    laid = raster.window_activity(rolled(s, rec, 10, 0), rec, window, False, by=["surr"]).toPandas()
    assert sce.detection_threshold(s, rec, window, 10).first().threshold == pytest.approx(np.percentile(laid.n, 95))
    assert sce.detection_threshold(s, rec, window, 10, use_max=True).first().threshold == pytest.approx(np.percentile(laid.groupby("surr").n.max(), 95))
    assert sce.low_activity_threshold(s, rec, window, 10, 30, use_min=True).first().threshold == pytest.approx(np.percentile(laid.groupby("surr").n.min(), 30))
    assert sce.low_activity_threshold(s, rec, window, 10, 60).first().threshold == pytest.approx(np.percentile(laid.n, 60))
    plan = sce.detection_threshold(s, rec, window, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0, (n_frames" not in plan  # no row for every frame


def test_patterns(spark):
    active = frame(spark, [("r", e, c) for e, cs in enumerate([[2, 1], [1, 2, 2], [], [3], [1, 2]]) for c in cs], "recording_id string, sce_id int, cluster int")
    events = frame(spark, [("r", e) for e in range(5)] + [("s", 0)], "recording_id string, sce_id int")
    got = sorted((r.recording_id, r.pattern, r.n_clusters, r.n, r.percent) for r in distributions.pattern_frequency(active, events).collect())
    assert got == [("r", [], 0, 1, 20.0), ("r", [1, 2], 2, 3, 60.0), ("r", [3], 1, 1, 20.0), ("s", [], 0, 1, 100.0)]


@pytest.mark.parametrize("window", [None, 1, 7])
def test_open_share_equals_counting(spark, window):
    """Overlapping, touching, late and long activations over stretches that are shorter than they are; a silent and a short recording."""
    r = random.Random(4)
    n = {"a": 90, "b": 61, "silent": 30, "short": 5}
    rows = [(rec, r.randrange(5), t, t + r.choice([0, 3, 20])) for rec in ("a", "b") for t in (r.randrange(n[rec]) for _ in range(25))] + [("a", 9, 0, 2), ("b", 9, 58, 70), ("short", 1, 0, 4)]
    iv = frame(spark, rows, "recording_id string, cluster int, start_frame int, end_frame int")
    rec = frame(spark, list(n.items()), "recording_id string, n_frames int")
    got = {}
    for x in sweeps.open_share(iv, rec, rec.select("recording_id", F.lit(10).alias("n_items")), window=window, stretch=8).collect():
        for f in range(x.start_frame, x.end_frame + 1):
            assert (x.recording_id, f) not in got
            got[x.recording_id, f] = (x.n, x.percent)
    for k, frames in n.items():
        if window is not None and frames <= window:
            assert not any(a == k for a, _ in got)
            continue
        last = frames - 1 if window is None else frames - window - 1
        for f in range(frames):
            t, w = min(f, last), window or 1
            c = {x[1] for x in rows if x[0] == k and x[2] <= t + w - 1 and x[3] >= t}
            assert got[k, f] == (len(c), pytest.approx(10.0 * len(c)))


def test_movie_profiles_equal_plain_ones(spark):
    """Boxes that overlap, cross tiles and leave the frame, over one movie with dark pixels."""
    r = np.random.default_rng(5)
    T, H, Wd = 30, 40, 50
    m = np.where(r.random((T, H, Wd)) < 0.4, r.random((T, H, Wd)).round(3), 0)
    movie = frame(spark, [(int(t), int(x), int(y), float(m[t, y, x])) for t, y, x in zip(*np.nonzero(m), strict=True)], "frame int, x int, y int, v double")
    shapes = {0: [(2.7, 3.2), (9.1, 12.9)], 1: [(8.0, 10.0), (30.5, 33.0)], 2: [(44.0, 30.0), (49.0, 39.0)], 3: [(15.0, 15.0), (16.0, 16.0)]}
    cells = frame(spark, [(c, [{"x": x, "y": y} for x, y in p]) for c, p in shapes.items()], "cell int, contour array<struct<x: double, y: double>>")
    box = movies.boxes(cells, Wd, H, 2)
    want = {c: (max(0, int(min(x for x, _ in p)) - 2), max(0, int(min(y for _, y in p)) - 2), min(Wd - 1, int(max(x for x, _ in p)) + 2), min(H - 1, int(max(y for _, y in p)) + 2)) for c, p in shapes.items()}
    assert {b.cell: tuple(b)[1:] for b in box.collect()} == want
    tr = r.normal(size=(4, T)).round(3)
    traces = frame(spark, [(c, t, float(tr[c, t])) for c in range(4) for t in range(T)], "cell int, frame int, value double")
    spans = [(c, k, a, b) for c in range(4) for k, (a, b) in enumerate([(0, 4), (3, 11), (29, 29)])]
    up = tr + abs(tr.min())

    def picture(c, a, b):
        x0, y0, x1, y1 = want[c]
        return (m[a : b + 1, y0 : y1 + 1, x0 : x1 + 1] * up[c, a : b + 1, None, None]).sum(0) / up[c, a : b + 1].sum()

    got = {}
    prof = movies.span_profiles(movie, box, traces, frame(spark, spans, "cell int, transient int, start_frame int, end_frame int"))
    full = movies.boxed(prof, box, ["cell", "transient"])
    for p in full.collect():
        got.setdefault((p.cell, p.transient), {})[p.x, p.y] = p.v
    for c, k, a, b in spans:
        plain = picture(c, a, b)
        assert got[c, k] == {(x, y): pytest.approx(plain[y, x]) for y in range(plain.shape[0]) for x in range(plain.shape[1])}
    peaks = {0: [5, 9, 20], 1: list(range(2, 30, 2)), 2: [3], 3: [1, 7, 8, 15, 22, 27]}
    onsets = {0: [4, 8, 19], 1: [1, 10, 20], 2: [5], 3: [0, 6, 21]}
    rows = lambda d: frame(spark, [(c, f) for c, fs in d.items() for f in fs], "cell int, frame int")
    src = {}
    for p in movies.boxed(movies.movie_sources(movie, box, traces, rows(peaks), rows(onsets)), box, ["cell"]).collect():
        src.setdefault(p.cell, {})[p.x, p.y] = p.v
    for c, fs in peaks.items():
        v = tr[c, fs]
        t = np.percentile(v, 95)
        k = (v > t).sum()
        if k > 10:
            t = np.percentile(v, (1 - 10 / len(fs)) * 100)
        elif k < 5 < len(fs):
            t = np.percentile(v, (1 - 5 / len(fs)) * 100)
        chosen = [f for f in fs if tr[c, f] > t]
        pictures = [picture(c, max(o for o in onsets[c] if o <= f), f) for f in chosen if any(o <= f for o in onsets[c])]
        if pictures:
            plain = sum(pictures) / len(chosen)
            assert src[c] == {(x, y): pytest.approx(plain[y, x]) for y in range(plain.shape[0]) for x in range(plain.shape[1])}
        else:
            assert c not in src
    shifted = {c.cell: [(p.x, p.y) for p in c.contour] for c in movies.shifted_contours(cells, box).collect()}
    assert shifted[1] == [(pytest.approx(8.0 - want[1][0]), pytest.approx(10.0 - want[1][1])), (pytest.approx(30.5 - want[1][0]), pytest.approx(33.0 - want[1][1]))]


def test_best_trials_by_name_and_by_own_aggregate(spark):
    rows = [(2, 0, 0, 0.1), (2, 0, 1, 0.9), (2, 1, 0, 0.5), (2, 1, 1, 0.5), (3, 0, 0, float("nan")), (3, 0, 1, 0.2), (3, 1, 0, None), (3, 2, 0, 0.2), (3, 2, 1, 0.2)]
    s = frame(spark, rows, "k int, trial int, cluster int, silhouette double")
    best = lambda how: {r.k: (r.trial, r.score) for r in assemblies.best_trials(s, ["k"], how).collect()}
    assert best("mean") == {2: (0, 0.5), 3: (0, pytest.approx(0.2))} and best("max") == {2: (0, 0.9), 3: (0, 0.2)} and best("min") == {2: (1, 0.5), 3: (0, 0.2)}
    lowest = F.pandas_udf(lambda v: float(v.min()), "double")  # noqa: F841

    @F.pandas_udf("double")
    def least(v: pd.Series) -> float:
        return float(v.min())

    assert best(least) == best("min") and best(lambda c: F.sum(c) / F.count(c)) == best("mean")


def test_table_functions(spark):
    functions.register(spark)
    functions.register(spark)
    cells = frame(spark, [(1, [0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 3.0, 3.0]), (2, [], []), (3, None, None), (4, [2.0], [5.0]), (5, [0.0, 600.0, 0.0], [0.0, 600.0, 600.0])], "cell int, xs array<double>, ys array<double>")
    got = spark.sql("SELECT cell, p.x, p.y FROM {cells}, LATERAL mask_pixels(xs, ys) p", cells=cells)
    n = {r.cell: r.n for r in got.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    assert n == {1: 20, 4: 1, 5: 601 * 602 // 2}
    contours = frame(spark, [(1, [(0, 0), (4, 0), (4, 3), (0, 3)])], "cell int, contour array<struct<x: int, y: int>>")
    assert sorted(map(tuple, spatial.masks(contours).collect())) == sorted(map(tuple, got.where("cell = 1").collect()))
    rows = spark.sql("SELECT p.* FROM slope_ranges(0, 3, 10, CAST(-4.0 AS DOUBLE), 100, 2) p").collect()
    assert [tuple(r) for r in rows] == []  # leaves the recording
    assert [tuple(r) for r in spark.sql("SELECT p.* FROM slope_ranges(0, 2, 10, CAST(1.5 AS DOUBLE), 100, 2) p").collect()] == [(1, 10, 13), (2, 11, 14)]
    assert [r.frame for r in spark.sql("SELECT frame FROM frames_between(3, 5)").collect()] == [3, 4, 5]


@pytest.mark.parametrize("kind", graphs.KINDS)
def test_graphs_are_written_and_read_back(spark, tmp_path, kind):
    path = str(tmp_path / "g")
    rows = [("a&<\"'>", "b", 1.5), ("b", "c d", None), ("é", "a&<\"'>", -2.0)] + [(f"n{i}", f"n{i + 1}", float(i)) for i in range(40)]
    edges = frame(spark, rows, "src string, dst string, weight double").repartition(3)
    graphs.write_graph(edges, path, kind)
    assert sorted(map(repr, map(tuple, graphs.read_graph(spark, path, kind).collect()))) == sorted(map(repr, rows))
    assert os.path.exists(f"{path}/_SUCCESS") and not os.path.exists(f"{path}/_writing")
    import xml.etree.ElementTree as ET

    nodes = set()
    for f in os.listdir(path):
        if f.endswith(kind):
            nodes |= {x.get("id") for x in ET.parse(f"{path}/{f}").iter() if x.tag.endswith("}node")}
    assert nodes == {x for a, b, _ in rows for x in (a, b)}
    graphs.write_graph(edges.limit(1), path, kind)
    assert graphs.read_graph(spark, path, kind).count() == len(rows) + 1


def test_an_aborted_graph_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "g")

    @F.udf("string")
    def broken(x):
        if x == "n7":
            raise ValueError("lost")
        return x

    edges = frame(spark, [(f"n{i}", "m", 1.0) for i in range(20)], "src string, dst string, weight double").repartition(2).withColumn("src", broken("src"))
    with pytest.raises(Exception, match="lost"):
        graphs.write_graph(edges, path)
    assert not os.path.exists(f"{path}/_SUCCESS") and not [f for _, _, fs in os.walk(path) for f in fs]


def test_listings(spark, tmp_path):
    rec = frame(spark, [("r",), ("empty",)], "recording_id string")
    cells = frame(spark, [("r", 0, 4), ("r", 0, 2), ("r", 1, 7), ("r", 1, 9)], "recording_id string, assembly int, cell int")
    sce_ = frame(spark, [("r", i, 10 * i, 10 * i + 3) for i in range(5)], "recording_id string, sce_id int, start_frame int, end_frame int")
    sces = frame(spark, [("r", 0, 0), ("r", 0, 2), ("r", 1, 3), ("r", 0, 4), ("r", 1, 4)], "recording_id string, assembly int, sce_id int")
    active = frame(spark, [("r", 0, 2), ("r", 2, 2), ("r", 2, 4), ("r", 3, 7), ("r", 4, 9)], "recording_id string, sce_id int, cell int")
    path = str(tmp_path / "l")
    results.write_listing(results.assembly_lines({"n_clusters": 2}, rec, cells, sces, sce_, active), path)
    read = lambda r: [x for f in os.listdir(f"{path}/recording_id={r}") if f.endswith(".txt") for x in open(f"{path}/recording_id={r}/{f}").read().splitlines()]  # noqa: E731, SIM115
    assert read("r") == [
        "#PARAM#", "data_id r", "n_clusters 2", "#CELL_ASSEMBLIES#", "SCA_cluster:0:2 4", "SCA_cluster:1:7 9", "MCA_SCE:40 43:0 1", "single_sce_in_ca:0:0 3#20 23", "single_sce_in_ca:1:30 33",
        "multiple_sce_in_ca:40 43", "cell:2:0 3#20 23", "cell:4:20 23", "cell:7:30 33", "cell:9:",
    ]
    assert read("empty") == ["#PARAM#", "data_id empty", "n_clusters 2", "#CELL_ASSEMBLIES#", "NONE"]
    assert sorted(map(tuple, results.read_assemblies(spark, path).collect())) == sorted(map(tuple, cells.collect()))
    stats = frame(spark, [("r", 0, 3, 4, 2.5, 5), ("r", 1, 5, 6, 3.0, 7), ("r", 2, 4, 4, 4.0, 4)], "recording_id string, sce_id int, duration int, max_cells long, mean_cells double, n_cells long")
    labels = frame(spark, [("r", 0, 0), ("r", 1, 0), ("r", 2, 1)], "recording_id string, sce_id int, label int")
    owners = frame(spark, [("r", 1, 0), ("r", 2, 0), ("r", 3, -1)], "recording_id string, cell int, cluster int")
    lines = results.statistics_lines(["cells 3, events 3"], rec.limit(1), stats, labels, owners).orderBy("section", "place").collect()
    assert [x.value for x in lines][:4] == ["cells 3, events 3", "##########   cluster 0 / 2 events / 2 cells##########", "Duration: mean 4.0, std 1.0, median 4.0", "Overall participation: mean 6.0, std 1.0, median 6.0"]
    assert [x.value for x in lines][-5:] == ["SCE 2", "Duration_in_frames 4", "Overall participation 4.0", "Max participation 4.0", "Mean participation 4.0"]


def test_catalogue_of_fits(spark, tmp_path):
    parts = [(p, 0, 0, 1.0) for p in results.PARTS if p != "w"] + [("w", i, j, float(10 * i + j)) for i in range(2) for j in range(3)]
    values = frame(spark, parts, "part string, row int, column int, value double")
    for name, score in (("fit1", -20.5), ("fit2", -3.25), ("fit3", -3.25)):
        results.write_fit(values, score, str(tmp_path / "fits" / name))
    results.write_fit(values.where("part <> 'w'"), 99.0, str(tmp_path / "fits" / "torn"))
    folder = str(tmp_path / "fits")
    got = {r.fit: r.complete for r in results.fits(spark, folder).collect()}
    assert got == {"fit1": True, "fit2": True, "fit3": True, "torn": False}
    best = results.best_fit(spark, folder)
    assert (best.first().fit, best.first().score) == ("fit2", -3.25)
    back = results.fit_values(spark, folder, best)
    assert sorted((r.part, r.row, r.column, r.value) for r in back.collect()) == sorted(parts)


def test_durable_rows_are_read_back(spark):
    from pulsegrid.sources.durable import durable

    d = frame(spark, [("a", [1, 2], {"x": 1.5}), (None, None, None)], "k string, v array<int>, s struct<x: double>")
    out = durable(d)
    assert out.schema == d.schema and sorted(map(repr, out.collect())) == sorted(map(repr, d.collect()))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "pulsegrid-rows" in str(out.inputFiles()) and "LogicalRDD" not in plan
    assert durable(d.where("false")).count() == 0


def test_best_trials_of_equal_scores_but_for_rounding(spark):
    """Of the same silhouettes in another order the first trial is best, though its sum is the smaller by a last place."""
    silhouettes = [("a", 0, 0, 0.3), ("a", 1, 0, 0.1 + 0.2), ("a", 2, 0, 0.3 - 1e-9), ("b", 0, 0, 0.2), ("b", 1, 0, 0.2 + 1e-9)]
    s = spark.createDataFrame(silhouettes, "k string, trial int, cluster int, silhouette double")
    assert 0.1 + 0.2 > 0.3
    for score in ("mean", "median"):
        assert {r.k: r.trial for r in assemblies.best_trials(s, ["k"], score).collect()} == {"a": 0, "b": 1}
