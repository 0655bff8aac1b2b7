"""Operators that were changed so that what a task holds or is shuffled grows no faster than the input."""

import hashlib
import random

from pyspark.sql import functions as F

from pulsegrid.operators import assemblies, merging, raster, sce, spatial
from pulsegrid.sources import tables as S


def test_runs_across_words_and_of_repeated_spikes(spark):
    frames = [-2, -1, 0, 1, 62, 63, 64, 65, 127, 128, 200]
    s = spark.createDataFrame([("r", 1, f) for f in frames + [63, 64]], S.SPIKES)
    got = sorted((r.run_id, r.start_frame, r.end_frame, r.length) for r in raster.runs(s).collect())
    assert got == [(0, -2, 1, 4), (1, 62, 65, 4), (2, 127, 128, 2), (3, 200, 200, 1)]


def test_nearest_centres_near_far_and_equal(spark):
    rng = random.Random(3)
    point = lambda: (round(rng.uniform(0, 20), 1), round(rng.uniform(0, 20), 1))
    a, b = [point() for _ in range(60)], [point() for _ in range(60)]
    a, b = a + a, b + b
    table = lambda rows: spark.createDataFrame([(i, *p) for i, p in enumerate(rows)], "cell long, cx double, cy double")
    want = {}
    for i, (x, y) in enumerate(a):
        d, j = min((((x - u) ** 2 + (y - v) ** 2) ** 0.5, j) for j, (u, v) in enumerate(b))
        want[i] = j if d <= 2 else -1
    out = spatial.match_cells(table(a), table(b), 2.0)
    assert {r.cell: r.matched for r in out.collect()} == want
    assert "Sample" not in out._jdf.queryExecution().toString() and set(want.values()) - {-1}


def test_no_redundancy_hands_on_counts_and_not_spikes(spark):
    rng = random.Random(5)
    rows = sorted({(rng.randrange(30), int(rng.gauss(20, 6))) for _ in range(260)})
    rows = [r for r in rows if 0 <= r[1] < 40]
    s = spark.createDataFrame([("r", *x) for x in rows], S.SPIKES)
    r = spark.createDataFrame([("r", 30, 40)], "recording_id string, n_cells int, n_frames int")
    for w, thr in ((1, 9.0), (3, 12.0), (4, 8.0)):
        at, want, start, seen = {}, [], None, set()
        for c, f in rows:
            at.setdefault(f, set()).add(c)
        for t in range(40 - w):
            active = set().union(*(at.get(x, set()) for x in range(t, t + w)))
            if len(active if start is None else active - (seen - at.get(t + w - 1, set()))) >= thr:
                start = t if start is None else start
                seen |= at.get(t, set())
            elif start is not None:
                want.append((start, t + w - 2))
                start, seen = None, set()
        if start is not None:
            want.append((start, 38 if w > 1 else 39))
        out = sce.detect_no_redundancy(s, r, w, spark.createDataFrame([("r", thr)], "recording_id string, threshold double"))
        assert [(x.start_frame, x.end_frame) for x in out.orderBy("sce_id").collect()] == want and want


def test_trains_of_a_clustering_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    t = spark.createDataFrame([("r", c, float(5 * i + c)) for c in range(3) for i in range(4)], "recording_id string, cell int, t double")
    assert merging.cluster_trains(t.mapInPandas(passed, t.schema), 4, sigma=1.0, early_stop=False).count() == 2
    assert read.value == 12


def test_cosine_silhouette_shuffles_no_vectors(spark):
    rng = random.Random(7)
    p = spark.createDataFrame([(i, i % 3, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(40)], "id long, label int, v array<double>")
    out = assemblies.cosine_silhouette(p, "v", "label", "id")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1  # elements become rows for the sums of clusters only
    vs = {r.id: (r.label, r.v) for r in p.collect()}
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, (_, v) in vs.items()}
    far = lambda i, j: 1 - sum(x * y for x, y in zip(unit[i], unit[j], strict=True))
    for r in out.collect():
        mean = {c: [far(r.id, j) for j in vs if j != r.id and vs[j][0] == c] for c in range(3)}
        mean = {c: sum(d) / len(d) for c, d in mean.items()}
        a, b = mean[r.label], min(d for c, d in mean.items() if c != r.label)
        assert abs(r.silhouette - (b - a) / max(a, b)) < 1e-9


def test_dealt_counts_are_not_windowed_by_slot(spark):
    cells = spark.createDataFrame([("r", e, c) for e in range(8) for c in range(12) if (e < 4) == (c < 6)], "recording_id string, sce_id int, cell int")
    labels = spark.createDataFrame([("r", e, int(e >= 4)) for e in range(8)], "recording_id string, sce_id int, label int")
    n = cells.join(labels, ["recording_id", "sce_id"]).groupBy("recording_id", "cell", "label").agg(F.count("*").alias("n"))
    size = labels.groupBy("recording_id", "label").agg(F.count("*").cast("int").alias("size"))
    cut = assemblies._null_cut(n, size, "cell", "label", 50, 0, 0.05, F.lit(2))
    assert "Window" not in cut._jdf.queryExecution().optimizedPlan().toString()
    for r in cut.collect():
        draws = [sorted((int(hashlib.md5(f"0|{r.cell}|{u}|{x}|{p}".encode()).hexdigest()[:13], 16), x, p) for x in (0, 1) for p in range(1, 5))[:4] for u in range(50)]
        assert r.cut == sorted(sum(x == r.label for _, x, _ in d) for d in draws)[48]
