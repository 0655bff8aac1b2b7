"""Spike-train distances and their significance against surrogates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def minimum_distances(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """(*key, d): half the sum of distances from each time of one train to the nearest of the other, both ways.

    ``a`` and ``b`` hold ``t`` per pair key. Both sides are laid in one time order and the
    nearest time of the other side is carried from before and after: an as-of join.
    """
    both = a.select(*key, "t", F.lit(0).alias("side")).union(b.select(*key, "t", F.lit(1).alias("side")))
    w = W.partitionBy(*key)
    before = w.orderBy("t", "side").rowsBetween(W.unboundedPreceding, 0)
    after = w.orderBy(F.desc("t"), F.desc("side")).rowsBetween(W.unboundedPreceding, 0)  # a growing frame, so one pass
    other = lambda s: F.when(F.col("side") == 0, F.col(f"{s}1")).otherwise(F.col(f"{s}0"))
    seen = both
    for side in (0, 1):
        v = F.when(F.col("side") == side, F.col("t"))
        seen = seen.withColumn(f"p{side}", F.last(v, True).over(before))
    for side in (0, 1):
        v = F.when(F.col("side") == side, F.col("t"))
        seen = seen.withColumn(f"f{side}", F.last(v, True).over(after))
    near = F.least(F.col("t") - other("p"), other("f") - F.col("t"))
    return seen.groupBy(*key).agg((F.coalesce(F.sum(near), F.lit(0.0)) / 2).alias("d"))


def train_distances(trains: DataFrame, by: list[str] = ()) -> DataFrame:
    """(.., i, j, d) for all pairs of cells i < j of a recording (or surrogate): a pair table is the result."""
    key = ["recording_id", *by]
    cells = trains.select(*key, "cell").distinct()
    pairs = cells.withColumnRenamed("cell", "i").join(cells.withColumnRenamed("cell", "j"), key).where("i < j")
    a = pairs.join(trains.withColumnRenamed("cell", "i"), [*key, "i"]).select(*key, "i", "j", "t")
    b = pairs.join(trains.withColumnRenamed("cell", "j"), [*key, "j"]).select(*key, "i", "j", "t")
    return minimum_distances(a, b, [*key, "i", "j"])


def scaled(n_below: Column, n: int, ci: float = 0.05) -> Column:
    """max(0, (n/2 - #{surrogate < d}) / (n/2 - n ci)): 1 at the level ``ci``."""
    return F.greatest(F.lit(0.0), (n / 2 - n_below) / (n / 2 - n * ci))


def scaled_significance(real: DataFrame, surrogate: DataFrame, n: int, ci: float = 0.05) -> DataFrame:
    """(recording_id, i, j, d, scaled) from real distances and those of ``n`` surrogates."""
    s = surrogate.select("recording_id", "i", "j", F.col("d").alias("ds"))
    below = real.join(s, ["recording_id", "i", "j"], "left").groupBy("recording_id", "i", "j", "d").agg(F.count_if(F.col("ds") < F.col("d")).alias("below"))
    return below.select("recording_id", "i", "j", "d", scaled(F.col("below"), n, ci).alias("scaled"))
