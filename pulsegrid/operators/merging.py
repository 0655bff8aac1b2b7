"""Functional clustering of spike trains, merge by merge, all recordings side by side, and the tree it makes.

A merge is a round of Spark jobs over tables of spikes: the pair of highest scaled
significance of each recording is one grouped maximum, a merged train is its spikes under
a new node, its surrogates are drawn by hashes, and its distances to the other trains are
as-of joins. Every round's tables are cut from the plan before them. Only how many rounds
there are left is known to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.operators.surrogates import normal, uniform, with_surrogates
from pulsegrid.operators.trains import minimum_distances, scaled_significance
from pulsegrid.sources.durable import durable

R = "recording_id"


def _drawn(spikes: DataFrame, n: int, sigma: float | None, reach: float, seed: int) -> DataFrame:
    """(recording_id, surr, node, t): ``n`` surrogates of each train, by normal noise, or by the even steps of [-reach, reach] in drawn order."""
    s = with_surrogates(spikes, n)
    what = (R, "surr", "node", "origin", "t")
    if sigma is not None:
        moved = F.col("t") + sigma * normal(seed, *what)
    else:
        w = W.partitionBy(R, "surr", "node")
        place, many = F.row_number().over(w.orderBy(uniform(seed, *what), "origin", "t")) - 1, F.count("*").over(w)
        moved = F.col("t") - reach + F.when(many > 1, 2 * reach * place / (many - 1)).otherwise(0.0)
    return s.select(R, "surr", "node", moved.alias("t"))


def _distances(pairs: DataFrame, left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    key = [R, *by]
    side = lambda rows, c: pairs.join(rows.withColumnRenamed("node", c), [R, c]).select(*key, "i", "j", "t")
    return minimum_distances(side(left, "i"), side(right, "j"), [*key, "i", "j"])


def _scales(pairs: DataFrame, real: DataFrame, surr: DataFrame, n: int, others_real: bool) -> DataFrame:
    """(recording_id, i, j, scale) of pairs (i, j); ``others_real`` holds the surrogates of j against the train i itself."""
    own = real.select(R, "node", "t")
    d = _distances(pairs, own, own, [])
    left = with_surrogates(own, n) if others_real else surr
    key = [R, "surr"]
    a = pairs.join(left.withColumnRenamed("node", "i"), [R, "i"]).select(*key, "i", "j", "t")
    b = pairs.join(surr.withColumnRenamed("node", "j"), [R, "j"]).select(*key, "i", "j", "t")
    null = minimum_distances(a, b, [*key, "i", "j"])
    return scaled_significance(d, null, n).select(R, "i", "j", F.col("scaled").alias("scale"))


def cluster_trains(trains: DataFrame, n_surrogates: int = 300, sigma: float | None = 0.1, jitter_range: float = 0.0, early_stop: bool = True, seed: int = 0, compat: bool = False) -> DataFrame:
    """(recording_id, step, node, left, right, scale): the pair of highest scaled significance of each recording is merged, until none reaches 1 (or one train is left).

    ``trains(recording_id, cell, t)``. Nodes under n are the n cells in order, merged ones
    follow; of equal pairs the one of the lowest nodes is merged. Surrogates are normal
    jitters of ``sigma``, or without it even jitters of ``jitter_range``. ``compat`` compares
    a merged train's surrogates with the other trains themselves.
    """
    if sigma is None and jitter_range <= 0:
        raise ValueError("a jitter needs a range")
    trains = durable(trains.select(R, "cell", "t"))  # read once, not in every branch
    numbered = trains.select(R, "cell").distinct().withColumn("node", F.row_number().over(W.partitionBy(R).orderBy("cell")) - 1)
    size = durable(numbered.groupBy(R).agg(F.count("*").cast("int").alias("n")))
    real = durable(trains.join(numbered, [R, "cell"]).select(R, "node", F.col("node").alias("origin"), F.col("t").cast("double").alias("t")))
    surr = durable(_drawn(real, n_surrogates, sigma, jitter_range, seed))
    nodes = numbered.select(R, "node")
    pairs = nodes.withColumnRenamed("node", "i").join(nodes.withColumnRenamed("node", "j"), R).where("i < j")
    scales = durable(_scales(pairs, real, surr, n_surrogates, False))
    merges = None
    for step in range((size.agg(F.max("n")).first()[0] or 1) - 1):
        top = scales.groupBy(R).agg(F.max(F.struct("scale", (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))).alias("m")).where("m.scale >= 1" if early_stop else "true")
        pick = durable(top.join(size, R).select(R, (-F.col("m.i")).cast("int").alias("left"), (-F.col("m.j")).cast("int").alias("right"), (F.col("n") + step).alias("new"), F.col("m.scale").alias("scale")))
        if pick.isEmpty():
            break
        one = pick.select(R, F.lit(step).alias("step"), F.col("new").alias("node"), "left", "right", "scale")
        merges = one if merges is None else merges.union(one)
        gone = pick.select(R, F.explode(F.array("left", "right")).alias("node"), "new")
        renamed = real.join(gone, [R, "node"], "left")
        real = durable(renamed.select(R, F.coalesce("new", "node").alias("node"), "origin", "t"))
        fresh = real.join(pick.select(R, F.col("new").alias("node")), [R, "node"], "left_semi")
        drawn = _drawn(fresh, n_surrogates, sigma, jitter_range, seed)
        surr = durable(surr.join(gone.select(R, "node"), [R, "node"], "left_anti").unionByName(drawn))
        rest = real.select(R, F.col("node").alias("i")).distinct().join(pick.select(R, F.col("new").alias("j")), R).where("i <> j")
        more = _scales(rest, real, surr, n_surrogates, compat)
        left = scales
        for c in ("i", "j"):
            left = left.join(gone.select(R, F.col("node").alias(c)), [R, c], "left_anti")
        scales = durable(left.select(R, "i", "j", "scale").unionByName(more))
    if merges is None:
        return size.where("false").select(R, *[F.lit(0).alias(c) for c in ("step", "node", "left", "right")], F.lit(0.0).alias("scale"))
    return merges


def tree(merges: DataFrame) -> DataFrame:
    """(recording_id, above, below): every node under a merge, found by doubling the steps up the tree."""
    up = merges.select(R, F.explode(F.array("left", "right")).alias("below"), F.col("node").alias("above"))
    reach = durable(up)
    n = reach.count()
    while True:
        far = reach.select(R, F.col("below"), F.col("above").alias("via")).join(reach.select(R, F.col("below").alias("via"), "above"), [R, "via"]).select(R, "below", "above")
        reach = durable(reach.unionByName(far).distinct())
        m = reach.count()
        if m == n:
            return reach.select(R, "above", "below")
        n = m


def tree_nodes(merges: DataFrame) -> DataFrame:
    """(recording_id, node, left, right, scale, lowest, n_leaves, height): each merge with the lowest scale under and at it, its leaves and its height in a dendrogram, the recording's top scale less its own."""
    inner = merges.select(R, F.col("node").alias("below"), F.col("scale").alias("s"))
    closure = tree(merges)
    under = closure.join(inner, [R, "below"], "left").groupBy(R, F.col("above").alias("node")).agg(F.min("s").alias("s"), F.count(F.when(F.col("s").isNull(), 1)).cast("int").alias("n_leaves"))
    top = F.max("scale").over(W.partitionBy(R))
    out = merges.join(under, [R, "node"])
    return out.select(R, "node", "left", "right", "scale", F.least("scale", F.coalesce("s", "scale")).alias("lowest"), "n_leaves", (top - F.col("scale")).alias("height"))


def tree_clusters(merges: DataFrame) -> DataFrame:
    """(recording_id, cluster, node, leaf): the leaves of the topmost merges under and at which all scales reach 1, numbered by their lowest leaf."""
    closure = tree(merges)
    good = tree_nodes(merges).where("lowest >= 1").select(R, "node")
    topmost = good.join(closure.select(R, F.col("below").alias("node"), "above").join(good.withColumnRenamed("node", "above"), [R, "above"]), [R, "node"], "left_anti")
    leaves = closure.join(merges.select(R, F.col("node").alias("below")), [R, "below"], "left_anti").select(R, F.col("above").alias("node"), F.col("below").alias("leaf"))
    held = topmost.join(leaves, [R, "node"])
    first = held.groupBy(R, "node").agg(F.min("leaf").alias("first"))
    number = first.select(R, "node", (F.row_number().over(W.partitionBy(R).orderBy("first")) - 1).cast("int").alias("cluster"))
    return held.join(number, [R, "node"]).select(R, "cluster", "node", "leaf")


def named_leaves(clusters: DataFrame, trains: DataFrame) -> DataFrame:
    """(recording_id, cluster, cell): clusters by the cells that the leaves stand for."""
    numbered = trains.select(R, "cell").distinct().withColumn("leaf", F.row_number().over(W.partitionBy(R).orderBy("cell")) - 1)
    return clusters.join(numbered, [R, "leaf"]).select(R, "cluster", "cell")
