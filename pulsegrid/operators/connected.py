"""Connected components of an edge table, by grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.sources.durable import durable


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges(a, b)`` reaches.

    Every round joins each node to the smallest root among its neighbours and then to that
    root's own root, so long chains shrink by more than a step a round. Rounds end
    when no root changes; each is cut off from the plan before it.
    """
    both = durable(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct())
    roots = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    for _ in range(rounds):
        near = both.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("low"))
        hooked = roots.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("root", "low").alias("new"))
        # the old root follows where one of its nodes has moved to, then each node follows its root
        moved = hooked.groupBy(F.col("root").alias("old")).agg(F.min("new").alias("to"))
        own = hooked.join(moved, F.col("node") == F.col("old"), "left").select("node", "root", F.least("new", "to").alias("new"))
        up = own.select(F.col("node").alias("via"), F.col("new").alias("via_root"))
        after = durable(own.join(up, F.col("new") == F.col("via"), "left").select("node", F.col("root").alias("before"), F.least("new", "via_root").alias("root")))
        roots = after.select("node", "root")
        if after.where("before <> root").isEmpty():
            return roots
    raise RuntimeError("components did not settle")
