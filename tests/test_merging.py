"""Functional clustering and its tree against a plain version that draws the same noise."""

import hashlib
import math
import random

import numpy as np
import pytest

from pulsegrid.operators import merging


def uniform(seed, *what):
    return int(hashlib.md5("|".join(map(str, (seed, *what))).encode()).hexdigest()[:13], 16) / 2**52


def normal(seed, *what):
    u, v = max(uniform(seed, *what), 1e-16), uniform(seed + 1_000_003, *what)
    return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)


def distance(a, b):
    a, b = np.array(a), np.array(b)
    near = np.abs(a[:, None] - b)
    return (near.min(1).sum() + near.min(0).sum()) / 2


def plain(trains, n, sigma, reach, early_stop, compat, rec="r"):
    """Merge history (node, left, right, scale) of lists of times."""
    real = {i: [(i, float(t)) for t in ts] for i, ts in enumerate(trains)}

    def drawn(node):
        out = []
        for s in range(n):
            if sigma is not None:
                out.append([t + sigma * normal(0, rec, s, node, o, t) for o, t in real[node]])
            else:
                order = sorted(real[node], key=lambda x: (uniform(0, rec, s, node, x[0], x[1]), x[0], x[1]))
                out.append([t - reach + (2 * reach * k / (len(order) - 1) if len(order) > 1 else 0) for k, (_, t) in enumerate(order)])
        return out

    surr = {i: drawn(i) for i in real}

    def scale(i, j, merged):
        d = distance([t for _, t in real[i]], [t for _, t in real[j]])
        below = sum(distance([t for _, t in real[i]] if compat and merged else surr[i][s], surr[j][s]) < d for s in range(n))
        return max(0.0, (n / 2 - below) / (n / 2 - n * 0.05))

    scales = {(i, j): scale(i, j, False) for i in real for j in real if i < j}
    out, new = [], len(trains)
    while len(real) > 1:
        (i, j), top = max(scales.items(), key=lambda x: (x[1], -x[0][0], -x[0][1]))
        if early_stop and top < 1:
            break
        out.append((new, i, j, top))
        real[new] = real.pop(i) + real.pop(j)
        surr[new] = drawn(new)
        scales = {k: v for k, v in scales.items() if i not in k and j not in k} | {(k, new): scale(k, new, True) for k in real if k != new}
        new += 1
    return out


def some_trains(seed, n_same, n_other, top=120):
    r = random.Random(seed)
    same = [sorted({k * 7 + r.choice([0, 0, 1]) for k in range(top // 7)}) for _ in range(n_same)]
    return same + [sorted(r.sample(range(top), 15)) for _ in range(n_other)]


def table(spark, recordings):
    rows = [(rec, 10 * c, float(t)) for rec, ts in recordings.items() for c, times in enumerate(ts) for t in times]
    return spark.createDataFrame(rows, "recording_id string, cell int, t double")


@pytest.mark.parametrize(("sigma", "early_stop", "compat"), [(2.0, False, False), (None, True, False), (2.0, True, True)])
def test_merges_equal_the_plain_algorithm(spark, sigma, early_stop, compat):
    recs = {"a": some_trains(1, 3, 2), "b": some_trains(2, 2, 1), "lone": [[1, 5, 9]]}
    got = merging.cluster_trains(table(spark, recs), 20, sigma, 3.0, early_stop, 0, compat).collect()
    want = {rec: plain(ts, 20, sigma, 3.0, early_stop, compat, rec) for rec, ts in recs.items()}
    for rec, h in want.items():
        mine = sorted((x for x in got if x.recording_id == rec), key=lambda x: x.step)
        assert [(x.node, x.left, x.right) for x in mine] == [x[:3] for x in h]
        assert [x.scale for x in mine] == pytest.approx([x[3] for x in h])
        assert [x.step for x in mine] == list(range(len(h)))


def test_periodic_trains_are_one_cluster(spark):
    """Periodic trains among random ones, as in the smoke script of the original method."""
    r = random.Random(3)
    same = [np.arange(0, 200, 3.5) + 0.02 * r.random() for _ in range(3)]
    other = [np.sort([r.random() * 200 for _ in range(55)]) for _ in range(3)]
    t = table(spark, {"r": [list(x) for x in (same[0], *other, same[1], same[2])]})
    m = merging.cluster_trains(t, 30, 0.1)
    c = {}
    for x in merging.named_leaves(merging.tree_clusters(m), t).collect():
        c.setdefault(x.cluster, set()).add(x.cell)
    assert {0, 40, 50} in c.values()


def test_no_merges_and_bad_ranges(spark):
    t = table(spark, {"r": [[0, 50, 99]], "s": [[5]]})
    assert merging.cluster_trains(t, 5, 1.0).count() == 0
    with pytest.raises(ValueError):
        merging.cluster_trains(t, 5, None)


def test_tree_nodes_and_clusters(spark):
    """A tree with a weak merge under a strong one, and two good branches."""
    h = [(0, 8, 0, 1, 1.2), (1, 9, 2, 3, 1.1), (2, 10, 8, 9, 0.8), (3, 11, 4, 5, 1.5), (4, 12, 6, 11, 1.0), (5, 13, 10, 12, 2.0)]
    m = spark.createDataFrame([("r", *x) for x in h] + [("s", 0, 2, 0, 1, 0.5)], "recording_id string, step int, node int, left int, right int, scale double")
    n = {x.node: (x.lowest, x.n_leaves, round(x.height, 6)) for x in merging.tree_nodes(m).where("recording_id = 'r'").collect()}
    assert n == {8: (1.2, 2, 0.8), 9: (1.1, 2, 0.9), 10: (0.8, 4, 1.2), 11: (1.5, 2, 0.5), 12: (1.0, 3, 1.0), 13: (0.8, 7, 0.0)}
    c = {}
    for x in merging.tree_clusters(m).collect():
        c.setdefault((x.recording_id, x.cluster, x.node), set()).add(x.leaf)
    assert c == {("r", 0, 8): {0, 1}, ("r", 1, 9): {2, 3}, ("r", 2, 12): {4, 5, 6}}
