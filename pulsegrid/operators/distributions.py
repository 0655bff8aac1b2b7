"""Distributions: equi-width histograms in percent, cut-offs by cumulative share, pattern frequencies, exact quantiles, boxes with outliers.

Groups may be large and unequal: counts are summed before they are shuffled, a group's
bins are few, and an exact quantile looks at the values of one bin only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bins by which quantiles are found.
FINE = 4096


def bin_count(most: Column, factor: int) -> Column:
    """Bins of a histogram: ``factor`` for each unit up to the largest value if that is over 1, ``factor`` in all if not."""
    return F.when(most > 1, F.floor(most * factor)).otherwise(factor).cast("int")


def _extent(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(*by, total, lo, hi, most) of the values that are numbers; a single value gets half a unit on either side."""
    e = values.groupBy(*by).agg(F.count(value).alias("total"), F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).where("total > 0")
    half = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    return e.select(*by, "total", (F.col("lo") - half).alias("lo"), (F.col("hi") + half).alias("hi"), F.col("hi").alias("most"))


def _edge(i: Column) -> Column:
    """The left edge of bin i; the last edge is the largest value itself."""
    return F.when(i == F.col("bins"), F.col("hi")).otherwise(F.col("lo") + i * ((F.col("hi") - F.col("lo")) / F.col("bins")))


def _bin_of(v: Column) -> Column:
    """The bin whose edges hold v (the last one is closed); rounding of the quotient is set right by the edges themselves."""
    i = F.least(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")), F.col("bins") - 1)
    down = v < _edge(i)
    up = (v >= _edge(i + 1)) & (i < F.col("bins") - 1)
    return F.when(down, i - 1).when(up, i + 1).otherwise(i).cast("int")


def _meet(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their group's columns; nulls are a group as well."""
    if not by:
        return rows.crossJoin(groups)  # one row
    g = groups.withColumnsRenamed({c: f"__g_{c}" for c in by})
    same = reduce(lambda a, b: a & b, (rows[c].eqNullSafe(g[f"__g_{c}"]) for c in by))
    return rows.join(g, same).drop(*[f"__g_{c}" for c in by])


def histogram(values: DataFrame, value: str, by: list[str] = (), bins: int | None = None, factor: int = 1, marks: DataFrame | None = None) -> DataFrame:
    """(*by, bin, left_edge, right_edge, n, percent): equal bins from the smallest to the largest value of each group, empty ones too.

    ``bins`` is a number for all groups; without it ``bin_count`` gives it by group from
    ``factor``. Two passes: the extents, then the bins. ``marks(*by, mark)`` adds the
    column ``n_marks``, the marked values that lie in a bin.
    """
    by = list(by)
    groups = _extent(values, value, by).withColumn("bins", F.lit(bins) if bins else bin_count(F.col("most"), factor)).where("bins > 0").drop("most")

    def counted(rows: DataFrame, c: str, name: str) -> DataFrame:
        placed = _meet(rows.where(F.col(c).isNotNull()).select(*by, F.col(c).cast("double").alias("__v")), groups, by).where("__v between lo and hi")
        return placed.groupBy(*by, _bin_of(F.col("__v")).alias("bin")).agg(F.count("*").alias(name))

    spine = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    out = _left(spine, counted(values, value, "n"), [*by, "bin"], ["n"])
    if marks is not None:
        out = _left(out, counted(marks, "mark", "n_marks"), [*by, "bin"], ["n_marks"])
    return out.select(*by, "bin", _edge(F.col("bin")).alias("left_edge"), _edge(F.col("bin") + 1).alias("right_edge"), "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"), *(["n_marks"] if marks is not None else []))


def _left(rows: DataFrame, more: DataFrame, on: list[str], zero: list[str]) -> DataFrame:
    r = more.withColumnsRenamed({c: f"__r_{c}" for c in on})
    same = reduce(lambda a, b: a & b, (rows[c].eqNullSafe(r[f"__r_{c}"]) for c in on))
    return rows.join(r, same, "left").drop(*[f"__r_{c}" for c in on]).fillna(0, zero)


def share_cut(bins: DataFrame, percent: float, by: list[str] = ()) -> DataFrame:
    """(*by, full_bins, cut_bin, cut_value): where the running share of a histogram reaches ``percent``.

    ``full_bins`` is the number of bins below the cut whose share counts whole, ``cut_bin``
    the bin the cut lies within (null where it falls on an edge), and ``cut_value`` the
    place itself, with the share of the cut bin spread evenly over its width.
    """
    by = list(by)
    order = W.partitionBy(*by).orderBy("bin")
    total = F.sum("n").over(W.partitionBy(*by))
    run = bins.withColumn("after", F.sum("n").over(order)).withColumn("before", F.col("after") - F.col("n")).withColumn("want", total * percent / 100.0)
    inside = (F.col("before") < F.col("want")) & (F.col("after") > F.col("want"))
    part = F.col("left_edge") + (F.col("right_edge") - F.col("left_edge")) * (F.col("want") - F.col("before")) / F.col("n")
    return run.groupBy(*by).agg(
        F.count(F.when(F.col("after") < F.col("want"), 1)).cast("int").alias("full_bins"),
        F.max(F.when(inside, F.col("bin"))).alias("cut_bin"),
        F.coalesce(F.max(F.when(inside, part)), F.min(F.when(F.col("after") >= F.col("want"), F.col("right_edge")))).alias("cut_value"),
    )


def participation(event_cells: DataFrame, clusters: DataFrame, least: int = 1) -> DataFrame:
    """(recording_id, sce_id, cluster): the clusters of which ``least`` cells or more are active in an event."""
    n = event_cells.join(clusters.select("recording_id", "cell", "cluster"), ["recording_id", "cell"]).groupBy("recording_id", "sce_id", "cluster").agg(F.count_distinct("cell").alias("n"))
    return n.where(F.col("n") >= least).select("recording_id", "sce_id", "cluster")


def pattern_frequency(active: DataFrame, events: DataFrame) -> DataFrame:
    """(recording_id, pattern, n_clusters, n, percent): how often each set of clusters is active in an event, of all events.

    ``active(recording_id, sce_id, cluster)``, repeats allowed; a pattern is the sorted
    list of the set, and an event without clusters has the empty one. A set has at most
    the number of clusters, so gathering it by event is bounded.
    """
    key = ["recording_id", "sce_id"]
    sets = active.groupBy(*key).agg(F.array_sort(F.collect_set("cluster")).alias("set"))
    kind = active.schema["cluster"].dataType.simpleString()
    each = events.select(*key).distinct().join(sets, key, "left").withColumn("pattern", F.coalesce("set", F.array().cast(f"array<{kind}>")))
    n = each.groupBy("recording_id", "pattern").agg(F.count("*").alias("n"))
    total = events.select(*key).distinct().groupBy("recording_id").agg(F.count("*").alias("total"))
    return n.join(total, "recording_id").select("recording_id", "pattern", F.size("pattern").alias("n_clusters"), "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"))


def quantiles(values: DataFrame, value: str, shares: list[float], by: list[str] = (), bins: int = FINE) -> DataFrame:
    """(*by, share, q): exact quantiles, linear between neighbours, of each group.

    A histogram shows which bin holds a wanted rank; only the values of those bins, equal
    ones summed, are ordered. No group is sorted or held whole.
    """
    by = list(by)
    groups = _extent(values, value, by).withColumn("bins", F.lit(bins)).drop("most")
    placed = _meet(values.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v")), groups, by)
    placed = placed.select(*by, "v", _bin_of(F.col("v")).alias("bin"))
    counts = placed.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(W.partitionBy(*by).orderBy("bin")) - F.col("n"))
    at = groups.select(*by, "total", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")).withColumn("h", (F.col("total") - 1) * F.col("share"))
    ranks = at.select(*by, "share", (F.col("h") - F.floor("h")).alias("part"), F.explode(F.array(F.floor("h"), F.ceil("h"))).alias("rank")).distinct()
    wanted = _meet(ranks, counts, by).where("rank >= before and rank < before + n").select(*by, "bin", "share", "part", (F.col("rank") - F.col("before")).alias("rank"), F.col("rank").alias("place"))
    bins_wanted = wanted.select(*by, "bin").distinct()
    inside = _meet(placed, bins_wanted, [*by, "bin"]).groupBy(*by, "bin", "v").agg(F.count("*").alias("n"))
    inside = inside.withColumn("before", F.sum("n").over(W.partitionBy(*by, "bin").orderBy("v")) - F.col("n"))
    hit = _meet(wanted, inside, [*by, "bin"]).where("rank >= before and rank < before + n")
    ends = hit.groupBy(*by, "share", "part").agg(F.min_by("v", "place").alias("a"), F.max_by("v", "place").alias("b"))
    return ends.select(*by, "share", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("q"))


def boxes(values: DataFrame, value: str, by: list[str] = (), reach: float = 1.5) -> DataFrame:
    """(*by, n, mean, q1, median, q3, whisker_low, whisker_high): the figures of a box plot.

    A whisker ends at the last value within ``reach`` quartile ranges of the box, or at
    the box where there is none.
    """
    by = list(by)
    q = quantiles(values, value, [0.25, 0.5, 0.75], by).groupBy(*by).agg(*[F.max(F.when(F.col("share") == s, F.col("q"))).alias(c) for s, c in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    v = F.col("__v")
    rows = _meet(values.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v")), q, by)
    span = reach * (F.col("q3") - F.col("q1"))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(v).alias("mean"),
        *[F.first(c).alias(c) for c in ("q1", "median", "q3")],
        F.min(F.when(v >= F.col("q1") - span, v)).alias("low"),
        F.max(F.when(v <= F.col("q3") + span, v)).alias("high"),
    )
    low, high = F.least(F.coalesce("low", "q1"), "q1"), F.greatest(F.coalesce("high", "q3"), "q3")
    return out.select(*by, "n", "mean", "q1", "median", "q3", low.alias("whisker_low"), high.alias("whisker_high"))


def outliers(values: DataFrame, value: str, by: list[str] = (), reach: float = 1.5) -> DataFrame:
    """The rows of ``values`` that lie beyond the whiskers of their group."""
    by = list(by)
    ends = boxes(values, value, by, reach).select(*by, "whisker_low", "whisker_high")
    return _meet(values, ends, by).where((F.col(value) < F.col("whisker_low")) | (F.col(value) > F.col("whisker_high"))).drop("whisker_low", "whisker_high")


def quick_boxes(values: DataFrame, value: str, by: list[str] = (), accuracy: int = 10_000) -> DataFrame:
    """(*by, n, mean, q1, median, q3) from mergeable sketches: one pass, a rank error of 1 / ``accuracy``."""
    q = F.percentile_approx(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(accuracy))
    out = values.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), q.alias("q"))
    return out.select(*by, "n", "mean", *[F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])


def sparse_percentile(counts: DataFrame, n: str, times: str, totals: DataFrame, by: list[str], percent: float) -> DataFrame:
    """(*by, threshold): a percentile of counts of which the zeros are not stored.

    ``counts(*by, n, times)`` says how often each count over zero stands, ``totals(*by,
    total)`` how many there are with the zeros; groups without counts are all zeros.
    """
    held = counts.groupBy(*by, n).agg(F.sum(times).alias(times))
    some = held.groupBy(*by).agg(F.sum(times).alias("__some"))
    zeros = totals.join(some, by, "left").select(*by, F.lit(0).cast(held.schema[n].dataType).alias(n), (F.col("total") - F.coalesce("__some", F.lit(0))).alias(times))
    every = held.select(*by, n, times).union(zeros.where(F.col(times) > 0))
    return every.groupBy(*by).agg(F.percentile(n, F.lit(percent / 100), F.col(times)).alias("threshold"))
