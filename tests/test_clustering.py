"""Blockwise k-means and silhouettes against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import assemblies, clustering


def plain_silhouettes(x, labels):
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    out = []
    for i, own in enumerate(labels):
        same = (labels == own) & (np.arange(len(x)) != i)
        others = [d[i][labels == c].mean() for c in set(labels.tolist()) - {own}]
        if not same.any() or not others:
            out.append(0.0)
            continue
        a, b = d[i][same].mean(), min(others)
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return out


@pytest.fixture(scope="module")
def sets():
    r = np.random.default_rng(1)
    clouds = np.concatenate([r.normal(c, 0.3, (20, 3)) for c in ((0, 0, 0), (4, 0, 0), (0, 5, 0))])
    return {"clouds": clouds, "few": r.normal(size=(3, 2)), "same": np.ones((6, 2)), "one": np.array([[1.0, 2.0]])}


def points(spark, sets):
    return spark.createDataFrame([(k, i, v.tolist()) for k, x in sets.items() for i, v in enumerate(x)], "set string, id long, vector array<double>")


@pytest.mark.parametrize("block", [7, 512])
def test_kmeans_ends_at_a_fixed_point(spark, sets, block, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", block)
    runs = spark.createDataFrame([(s, k, t) for s in sets for k in (1, 3) for t in range(4)], "set string, k int, trial int")
    got = {}
    for r in clustering.kmeans(points(spark, sets), runs, seed=5).collect():
        got.setdefault((r.set, r.k, r.trial), {})[r.id] = r.label
    assert len(got) == len(sets) * 2 * 4
    for (name, k, _), labels in got.items():
        x = sets[name]
        y = np.array([labels[i] for i in range(len(x))])
        assert set(labels) == set(range(len(x))) and y.max() < k
        c = {j: x[y == j].mean(0) for j in set(y.tolist())}
        own = ((x - np.array([c[j] for j in y])) ** 2).sum(1)
        assert all((own <= ((x - m) ** 2).sum(1) + 1e-9).all() for m in c.values())
    best = min(sum(((sets["clouds"][y == j] - sets["clouds"][y == j].mean(0)) ** 2).sum() for j in set(y.tolist())) for (n, k, _), lb in got.items() if (n, k) == ("clouds", 3) for y in [np.array([lb[i] for i in range(60)])])
    assert best < 0.3**2 * 3 * 60 * 1.5  # the three clouds


@pytest.mark.parametrize("block", [5, 512])
def test_silhouettes_equal_plain_ones(spark, sets, block, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", block)
    r = np.random.default_rng(2)
    labels = {(s, k, t): r.integers(0, k, len(x)) for s, x in sets.items() for k in (1, 3) for t in range(2)}
    rows = [(s, k, t, i, int(v)) for (s, k, t), y in labels.items() for i, v in enumerate(y)]
    got = {}
    for x in clustering.silhouettes(points(spark, sets), spark.createDataFrame(rows, "set string, k int, trial int, id long, label int")).collect():
        got.setdefault((x.set, x.k, x.trial), {})[x.id] = x.silhouette
    for key, y in labels.items():
        want = plain_silhouettes(sets[key[0]], y)
        assert [got[key][i] for i in range(len(want))] == pytest.approx(want, abs=1e-7)


def test_similarity_rows_and_surrogates(spark):
    """The matrix of the real events, and surrogates that keep a matrix's values but not its columns."""
    r = np.random.default_rng(3)
    x = r.random((12, 8)) < 0.4
    x[:, 0] = True  # all cells: no similarity
    cells = spark.createDataFrame([("r", int(e), int(c)) for c, e in zip(*np.nonzero(x), strict=True)], "recording_id string, sce_id int, cell int")
    rows = assemblies.similarity_rows(cells, 3, seed=1).collect()
    c = x - x.mean(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        want = np.where((x.T.astype(int) @ x > 0) & (np.outer(x.std(0), x.std(0)) > 0), c.T @ c / (np.outer(x.std(0), x.std(0)) * 8), 0)
    real = np.array([q.vector for q in sorted((q for q in rows if q.surr == -1), key=lambda q: q.sce_id)])
    assert np.allclose(real, want)
    for s in range(3):
        m = np.array([q.vector for q in sorted((q for q in rows if q.surr == s), key=lambda q: q.place)])
        assert np.allclose(np.sort(m.ravel()), np.sort(real.ravel())) and not np.allclose(np.sort(m.sum(0)), np.sort(real.sum(0)))


def test_events_of_two_kinds_are_significant(spark):
    r = np.random.default_rng(4)
    rows = []
    for e in range(16):
        own = range(0, 12) if e % 2 else range(12, 24)
        rows += [("r", e, c) for c in own if r.random() < 0.8] + [("r", e, int(c)) for c in r.integers(24, 40, 3)]
    cells = spark.createDataFrame(rows, "recording_id string, sce_id int, cell int").distinct()
    out = assemblies.cluster_events(cells, [2], n_surrogates=4, trials=5, score="median")
    labels = {x.sce_id: x.label for x in out.collect()}
    assert len({labels[e] for e in range(0, 16, 2)}) == 1 and len({labels[e] for e in range(1, 16, 2)}) == 1 and labels[0] != labels[1]
    assert out.where("significant").count() == 16
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, assemblies.cluster_events(cells.repartition(5), [2], n_surrogates=4, trials=5, score="median").collect()))
    assert out.agg(F.max("score")).first()[0] > 0.5


def test_silhouettes_by_tiles_of_near_points(spark, monkeypatch):
    """Points that lie much nearer to each other than to the origin, over several blocks and tiles."""
    for name, n in (("LEAST", 7), ("WIDE", 4), ("TILE", 3)):
        monkeypatch.setattr(clustering, name, n)
    rng = np.random.default_rng(5)
    x = 1000 + rng.integers(0, 64, (41, 6)) / 2.0**20
    x[7] = x[30]
    labels = rng.integers(0, 3, 41)
    rows = [("s", 1, 0, i, int(c)) for i, c in enumerate(labels)]
    held = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "set string, id long, vector array<double>")
    got = {r.id: r.silhouette for r in clustering.silhouettes(held, spark.createDataFrame(rows, "set string, k int, trial int, id long, label int")).collect()}
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    for i, c in enumerate(labels):
        mean = [d[i, labels == o].sum() / ((labels == o).sum() - (o == c)) for o in range(3)]
        a, b = mean[c], min(m for o, m in enumerate(mean) if o != c)
        assert abs(got[i] - (b - a) / max(a, b)) < 1e-9
    assert len(got) == 41
