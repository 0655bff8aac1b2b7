"""Cuts of the assembly tests: a unit's total dealt at random to groups of slots."""

import math

from pyspark.sql import functions as F

from pulsegrid.operators import assemblies


def test_cuts_are_those_of_the_hypergeometric_distribution(spark):
    """One unit of many: the cut is the quantile of how many of a group's slots are among those dealt."""
    sizes = {0: 12, 1: 30, 2: 8}
    counts = spark.createDataFrame([("a", c, 0, 10) for c in range(40)], "recording_id string, cell int, label int, n long")
    size = spark.createDataFrame([("a", g, s) for g, s in sizes.items()], "recording_id string, label int, size int")
    n = 2000
    got = assemblies._null_cut(counts, size, "cell", "label", n, 3, 0.2, F.lit(2)).collect()
    assert len(got) == 40 * 3
    every = sum(sizes.values())
    for g, s in sizes.items():
        below = lambda k, s=s: sum(math.comb(s, x) * math.comb(every - s, 10 - x) for x in range(k + 1)) / math.comb(every, 10)
        for r in got:
            if r.label == g:
                # the sorted draws' value at 0.9 of them lies where the distribution reaches 0.9, give or take four deviations
                assert below(r.cut) > 0.9 - 0.027 and below(r.cut - 1) < 0.9 + 0.027
    again = assemblies._null_cut(counts.repartition(3), size, "cell", "label", n, 3, 0.2, F.lit(2)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_units_are_dealt_until_no_cut_is_below_their_counts(spark):
    """The same counts are over their cuts as with all surrogates; units are dealt by all tasks, without rows or lists of draws."""
    rows = [("a", c, g, 1 + (c * 7 + g * 3) % 6) for c in range(60) for g in range(3) if (c + g) % 4] + [("a", 60, 0, 9), ("b", 7, 0, 4), ("b", 7, 1, 1)]
    counts = spark.createDataFrame(rows, "recording_id string, cell int, label int, n long")
    size = spark.createDataFrame([("a", 0, 12), ("a", 1, 30), ("a", 2, 8), ("b", 0, 5), ("b", 1, 9)], "recording_id string, label int, size int")
    cuts = {k: assemblies._null_cut(counts, size, "cell", "label", 100, 5, 0.1, F.lit(2), **o) for k, o in (("all", {}), ("least", {"least": True}))}
    for c in cuts.values():
        plan = c._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "transform(" not in plan and "md5" not in plan
        assert c.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    got = {k: {(r.recording_id, r.cell, r.label): r.cut for r in c.collect()} for k, c in cuts.items()}
    assert got["all"].keys() == got["least"].keys() and len(got["all"]) == 61 * 3 + 2
    over = lambda k: {x[:3] for x in rows if x[3] > got[k][x[:3]]}
    assert over("all") == over("least") and ("a", 60, 0) in over("all")
    assert all(got["least"][x] <= c for x, c in got["all"].items()) and sum(got["least"].values()) < sum(got["all"].values())
