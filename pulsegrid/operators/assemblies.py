"""Cell assemblies: similarity of events, k-means with surrogates, assembly tests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulsegrid.operators import clustering
from pulsegrid.operators.raster import islands, window_activity
from pulsegrid.operators.surrogates import uniform, with_surrogates
from pulsegrid.sources.durable import durable

def event_similarity(sce_cells: DataFrame, recordings: DataFrame) -> DataFrame:
    """(recording_id, a, b, n_both, similarity) for pairs of events a < b that share a cell.

    The centred product over both deviations, divided by the number of events; pairs
    that share no cell have 0 and no row.
    """
    n = sce_cells.groupBy("recording_id", "sce_id").agg(F.count("*").alias("n"))
    m = n.groupBy("recording_id").agg(F.count("*").alias("n_sce"))
    x, y = sce_cells.withColumnRenamed("sce_id", "a"), sce_cells.withColumnRenamed("sce_id", "b")
    both = x.join(y, ["recording_id", "cell"]).where("a < b").groupBy("recording_id", "a", "b").agg(F.count("*").alias("n_both"))
    both = both.join(n.select("recording_id", F.col("sce_id").alias("a"), F.col("n").alias("na")), ["recording_id", "a"])
    both = both.join(n.select("recording_id", F.col("sce_id").alias("b"), F.col("n").alias("nb")), ["recording_id", "b"])
    both = both.join(recordings.select("recording_id", "n_cells"), "recording_id").join(m, "recording_id")
    c = F.col("n_cells")
    sd = lambda k: F.sqrt(k / c * (1 - k / c))
    top = F.col("n_both") - F.col("na") * F.col("nb") / c
    bottom = sd(F.col("na")) * sd(F.col("nb")) * F.col("n_sce")
    return both.select("recording_id", "a", "b", "n_both", F.when(bottom > 0, top / bottom).otherwise(0.0).alias("similarity"))


def similarity_rows(sce_cells: DataFrame, n_surrogates: int, seed: int = 0) -> DataFrame:
    """(recording_id, surr, place, sce_id, vector): each event's similarities with all events of its recording, itself among them, in order of event.

    Surrogates 0 .. n - 1 permute every column for itself and then every row (``sce_id`` is
    null there); -1 is the recording itself. Cells are those that take part in any event.
    """
    r = "recording_id"
    cells = sce_cells.select(r, "sce_id", "cell").distinct()
    n_cells = cells.groupBy(r).agg(F.count_distinct("cell").alias("n_cells"))
    n = cells.groupBy(r, "sce_id").agg(F.count("*").alias("n")).join(n_cells, r)
    events = n.withColumn("place", F.row_number().over(W.partitionBy(r).orderBy("sce_id")) - 1).withColumn("n_sce", F.count("*").over(W.partitionBy(r)))
    near = event_similarity(cells, n_cells).select(r, "a", "b", "similarity")
    near = near.union(near.select(r, "b", "a", "similarity")).union(events.select(r, "sce_id", "sce_id", F.when(F.col("n") < F.col("n_cells"), F.col("n_cells") / F.col("n_sce")).otherwise(0.0)))
    at = lambda c, p: events.select(r, F.col("sce_id").alias(c), F.col("place").alias(p))
    spine = at("a", "i").join(at("b", "j"), r)  # the matrix itself
    matrix = durable(spine.join(near, [r, "a", "b"], "left").select(r, F.col("a").alias("sce_id"), "i", "j", F.coalesce("similarity", F.lit(0.0)).alias("v")))
    drawn = with_surrogates(matrix.drop("sce_id"), n_surrogates) if n_surrogates else matrix.drop("sce_id").withColumn("surr", F.lit(0)).where("false")
    down = W.partitionBy(r, "surr", "j").orderBy(uniform(seed, r, "surr", "j", "i"), "i")
    drawn = drawn.withColumn("i", F.row_number().over(down) - 1)
    along = W.partitionBy(r, "surr", "i").orderBy(uniform(seed + 1, r, "surr", "i", "j"), "j")
    drawn = drawn.withColumn("j", F.row_number().over(along) - 1)
    both = matrix.withColumn("surr", F.lit(-1)).unionByName(drawn, allowMissingColumns=True)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"])
    return both.groupBy(r, "surr", F.col("i").alias("place")).agg(F.max("sce_id").alias("sce_id"), rows.alias("vector"))


#: Aggregates by which a trial's cluster silhouettes may be scored, beside any function of a column.
SCORES: dict[str, Callable[[Column], Column]] = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max}

#: Scores of trials that differ by no more are equal.
EQUAL = 1e-12


def best_trials(silhouettes: DataFrame, by: list[str], score: str | Callable[[Column], Column] = "mean") -> DataFrame:
    """(*by, trial, score): the trial of best score of each group; of equals the first.

    Scores within ``EQUAL`` of the best are equal to it: two labellings that are the same
    differ by the order in which Spark adds up what they are scored by.

    ``silhouettes(*by, trial, cluster, silhouette)`` has a row for each cluster of a trial;
    ``score`` is the name of an aggregate in ``SCORES``, or what makes one of a column, such
    as a grouped-aggregate ``pandas_udf``. Missing silhouettes don't count, a trial without
    any has no score.
    """
    f = SCORES[score] if isinstance(score, str) else score
    known = silhouettes.where(F.col("silhouette").isNotNull() & ~F.isnan("silhouette"))
    scored = known.groupBy(*by, "trial").agg(f(F.col("silhouette")).cast("double").alias("score")).where("score is not null")
    held = scored.groupBy(*by).agg(F.max("score").alias("best"), F.collect_list(F.struct("trial", "score")).alias("trials"))  # as many as trials
    first = F.array_min(F.filter("trials", lambda t: (t["score"] == F.col("best")) | (t["score"] >= F.col("best") - EQUAL)))
    return held.withColumn("m", first).select(*by, F.col("m.trial").alias("trial"), F.col("m.score").alias("score"))


def cluster_events(sce_cells: DataFrame, ks: list[int], n_surrogates: int = 100, trials: int = 100, percentile: float = 95, seed: int = 0, score: str | Callable[[Column], Column] = "mean") -> DataFrame:
    """(recording_id, k, sce_id, label, cluster_silhouette, score, surrogate, significant).

    For each k the trial of best ``score`` over its clusters' silhouettes (see ``best_trials``)
    on the rows of event similarity, compared with the percentile of cluster silhouettes
    over the best trials of surrogates (see ``similarity_rows``). All recordings,
    surrogates, numbers of clusters and trials go side by side.
    """
    sce_cells = durable(sce_cells)
    rows = durable(similarity_rows(sce_cells, n_surrogates, seed).withColumn("set", F.concat_ws("|", "recording_id", F.col("surr").cast("string"))))
    points = rows.select("set", F.col("place").alias("id"), "vector")
    runs = rows.select("set").distinct().withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    labels = durable(clustering.kmeans(points, runs, seed))
    shape = clustering.silhouettes(points, labels).groupBy("set", "k", "trial", F.col("label").alias("cluster")).agg(F.avg("silhouette").alias("silhouette"))
    shape = durable(shape)
    best = durable(best_trials(shape, ["set", "k"], score))
    named = rows.select("set", "recording_id", "surr").distinct()
    won = shape.join(best, ["set", "k", "trial"]).join(named, "set")
    null = won.where("surr >= 0").groupBy("recording_id", "k").agg(F.percentile("silhouette", F.lit(percentile / 100)).alias("surrogate"))
    real = won.where("surr = -1").select("set", "k", "trial", F.col("cluster").alias("label"), F.col("silhouette").alias("cluster_silhouette"), "score")
    each = labels.join(real, ["set", "k", "trial", "label"]).join(rows.where("surr = -1").select("set", "recording_id", F.col("place").cast("long").alias("id"), "sce_id"), ["set", "id"])
    out = each.join(null, ["recording_id", "k"], "left").withColumn("significant", F.col("cluster_silhouette") > F.coalesce("surrogate", F.lit(-1.0)))
    return out.select("recording_id", "k", "sce_id", "label", "cluster_silhouette", "score", "surrogate", "significant")


def best_k(clusters: DataFrame) -> DataFrame:
    """The k of best score; the smallest of equals."""
    return clusters.groupBy("recording_id").agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("m")).select("recording_id", (-F.col("m.k")).alias("k"), F.col("m.score").alias("score"))


def silhouette(points: DataFrame, vector: str, label: str, key: str) -> DataFrame:
    """(key, label, silhouette) with Euclidean distances, summed block by block."""
    p = points.select(F.lit("all").alias("set"), F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    labels = points.select(F.lit("all").alias("set"), F.lit(0).alias("k"), F.lit(0).alias("trial"), F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    return clustering.silhouettes(p, labels).select(F.col("id").alias(key), F.col("label").alias(label), "silhouette")


def cosine_silhouette(points: DataFrame, vector: str, label: str, key: str, by: list[str] = ()) -> DataFrame:
    """(*by, key, label, silhouette) with cosine distance, from sums per cluster: no pairs are made.

    The mean cosine distance of a point to a cluster is one less its product with the
    cluster's mean of unit vectors. ``by`` names labellings that stand side by side.
    """
    by = list(by)
    plain = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda t, x: t + x)
    norm = F.sqrt(total(F.transform("v", lambda x: x * x)))
    p = points.where(F.size(vector) > 0).select(*by, F.col(key), F.col(label), F.transform(vector, plain).alias("v"))
    # the norm stands outside of the lambda, and the vectors are made once: both would be made again for every element
    p = durable(p.select(*by, key, label, F.zip_with("v", F.array_repeat(norm, F.size("v")), lambda x, n: x / n).alias("u")))
    sums = p.select(*by, F.col(label).alias("c"), F.posexplode("u").alias("i", "x")).groupBy(*by, "c", "i").agg(F.sum("x").alias("s"))
    sums = sums.groupBy(*by, "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("s"))
    size = points.groupBy(*by, F.col(label).alias("c")).agg(F.count("*").alias("m"))
    means = sums.join(size, [*by, "c"]).groupBy(*by).agg(F.collect_list(F.struct("c", "m", "s")).alias("clusters"))  # a vector for each cluster
    met = p.join(F.broadcast(means), by, "left") if by else p.crossJoin(F.broadcast(means))
    dot = lambda c: total(F.zip_with("u", c["s"], lambda x, y: F.coalesce(x * y, F.lit(0.0))))
    own = lambda c: c["c"] == F.col(label)
    mine = F.array_max(F.transform(F.filter("clusters", lambda c: own(c) & (c["m"] > 1)), lambda c: (c["m"] - dot(c)) / (c["m"] - 1)))
    others = F.array_min(F.transform(F.filter("clusters", lambda c: ~own(c)), lambda c: 1 - dot(c) / c["m"]))
    ab = met.select(*by, key, label, mine.alias("a"), others.alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return ab.select(*by, key, label, s.alias("silhouette"))


def cluster_cells(sce_cells: DataFrame, labels: DataFrame, cells: DataFrame, least: int = 2) -> DataFrame:
    """(recording_id, cell, cluster): the cluster of ``labels(recording_id, sce_id, label)`` in most of whose events a cell takes part, else -1."""
    size = labels.groupBy("recording_id", "label").agg(F.count("*").alias("size"))
    n = sce_cells.join(labels, ["recording_id", "sce_id"]).groupBy("recording_id", "cell", "label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    n = n.join(size, ["recording_id", "label"]).withColumn("share", F.col("n") / F.col("size"))
    best = F.row_number().over(W.partitionBy("recording_id", "cell").orderBy(F.desc("share"), F.desc("n"), "label"))
    top = n.withColumn("r", best).where("r = 1").select("recording_id", "cell", "label")
    return cells.join(top, ["recording_id", "cell"], "left").select("recording_id", "cell", F.coalesce("label", F.lit(-1)).alias("cluster"))


def _null_cut(counts: DataFrame, sizes: DataFrame, unit: str, group: str, n_surrogates: int, seed: int, alpha: float, tests: Column, least: bool = False) -> DataFrame:
    """(unit, group, cut): the (1 - alpha / tests) value of a unit's count in each group when its total is dealt at random.

    Slots get ``uniform`` numbers of (seed, unit, surrogate, group, slot), and the lowest are dealt. With ``least``
    a unit is dealt no further once so many surrogates reach its counts that no cut is below them; such cuts are lower bounds.
    """
    own = F.struct(F.col(group).alias("group"), "n")
    total = counts.groupBy("recording_id", unit).agg(F.sum("n").alias("total"), F.collect_list(own).alias("own"))  # as many as groups
    at = F.floor(n_surrogates * (1 - alpha / tests)).cast("int")
    each = F.struct(F.col(group).alias("group"), F.col("size").cast("long").alias("size"), at.alias("at"))
    groups = sizes.groupBy("recording_id").agg(F.array_sort(F.collect_list(each)).alias("groups"))
    held = total.join(F.broadcast(groups), "recording_id")
    schema = T.StructType([*[held.schema[c] for c in ("recording_id", unit)], T.StructField(group, sizes.schema[group].dataType), T.StructField("cut", T.LongType())])
    types = to_arrow_schema(schema)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_slots, slots = None, []
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("recording_id", unit, "total", "own", "groups")}
                names = [g["group"] for g in r["groups"]]
                size, at = (np.array([g[c] for g in r["groups"]]) for c in ("size", "at"))
                if r["recording_id"] != of_slots:
                    of_slots, slots = r["recording_id"], [f"|{g}|{k}".encode() for g, n in zip(names, size, strict=True) for k in range(1, n + 1)]
                of = np.repeat(np.arange(len(size)), size)
                seen = {x["group"]: x["n"] for x in r["own"]}
                n = np.array([seen.get(g, 0) for g in names])
                dealt = np.zeros((n_surrogates, len(size)), int)
                for surr in range(n_surrogates):
                    first = _lowest(f"{seed}|{r[unit]}|{surr}".encode(), slots, r["total"])
                    dealt[surr] = np.bincount(of[first], minlength=len(size))
                    if least and ((dealt[: surr + 1] >= n).sum(0) >= n_surrogates - at).all():
                        break
                cut = np.sort(dealt, axis=0)[at, np.arange(len(size))]
                rows += [{"recording_id": r["recording_id"], unit: r[unit], group: g, "cut": int(c)} for g, c in zip(names, cut, strict=True)]
            yield pa.RecordBatch.from_pylist(rows, types)

    tasks = 4 * counts.sparkSession.sparkContext.defaultParallelism  # few bytes, much to do
    return held.repartition(tasks, "recording_id", unit).sortWithinPartitions("recording_id").mapInArrow(deal, schema)


def _lowest(drawn: bytes, slots: list[bytes], many: int) -> np.ndarray:
    """The places of the lowest ``many`` of the ``uniform`` numbers of ``drawn`` and each slot, of equals the first."""
    u = np.frombuffer(b"".join([hashlib.md5(drawn + s, usedforsecurity=False).digest()[:8] for s in slots]), ">u8") >> 12  # 13 digits
    return np.argsort(u, kind="stable")[:many]


def assemblies(sce_cells: DataFrame, labels: DataFrame, n_surrogates: int = 1000, alpha: float = 0.05, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(assembly_cells, assembly_sces): cells that take part in a cluster's events, and events that recruit an assembly, beyond chance.

    A cell in several clusters belongs to that of its highest share; an assembly has two
    cells at least. Levels are divided by the number of clusters or assemblies.
    """
    sce_cells, labels = durable(sce_cells), durable(labels)
    size = labels.groupBy("recording_id", "label").agg(F.count("*").cast("int").alias("size"))
    k = size.groupBy("recording_id").agg(F.count("*").alias("k"))
    n = sce_cells.join(labels, ["recording_id", "sce_id"]).groupBy("recording_id", "cell", "label").agg(F.count("*").alias("n"))
    cut = _null_cut(n, size.join(k, "recording_id"), "cell", "label", n_surrogates, seed, alpha, F.col("k"), least=True)
    over = n.join(cut, ["recording_id", "cell", "label"]).where("n > cut").join(size, ["recording_id", "label"])
    rank = F.row_number().over(W.partitionBy("recording_id", "cell").orderBy(F.desc(F.col("n") / F.col("size")), "label"))
    one = over.withColumn("r", rank).where("r = 1")
    m = F.count("*").over(W.partitionBy("recording_id", "label"))
    cells = one.withColumn("m", m).where("m > 1").select("recording_id", F.col("label").alias("assembly"), "cell")
    asize = cells.groupBy("recording_id", "assembly").agg(F.count("*").cast("int").alias("size"))
    ak = asize.groupBy("recording_id").agg(F.count("*").alias("k"))
    na = sce_cells.join(cells, ["recording_id", "cell"]).groupBy("recording_id", "sce_id", "assembly").agg(F.count("*").alias("n"))
    acut = _null_cut(na, asize.join(ak, "recording_id"), "sce_id", "assembly", n_surrogates, seed + 1, alpha, F.col("k"), least=True)
    sces = na.join(acut, ["recording_id", "sce_id", "assembly"]).where("n > cut").select("recording_id", "assembly", "sce_id", "n")
    return cells, sces


def group_events(assembly_sces: DataFrame, sce: DataFrame) -> DataFrame:
    """Events by the number of assemblies they recruit: none, single or multiple."""
    n = assembly_sces.groupBy("recording_id", "sce_id").agg(F.count_distinct("assembly").alias("n"))
    g = sce.select("recording_id", "sce_id").join(n, ["recording_id", "sce_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return g.withColumn("kind", F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "single").otherwise("multiple"))


def activations(spikes: DataFrame, recordings: DataFrame, clusters: DataFrame, window: int, share: float = 0.5) -> DataFrame:
    """(recording_id, cluster, activation_id, start_frame, end_frame): windows in which a share of a cluster's cells is active."""
    size = clusters.where("cluster >= 0").groupBy("recording_id", "cluster").agg(F.count("*").alias("size"))
    s = spikes.join(clusters.where("cluster >= 0"), ["recording_id", "cell"])
    a = window_activity(s, recordings, window, True, by=["cluster"])
    over = a.join(size, ["recording_id", "cluster"]).where(F.col("n") >= share * F.col("size"))
    runs = islands(over, ["recording_id", "cluster"])
    return runs.select("recording_id", "cluster", F.col("run_id").alias("activation_id"), "start_frame", (F.col("end_frame") + window - 1).cast("int").alias("end_frame"))


def activations_in_events(acts: DataFrame, sce: DataFrame) -> DataFrame:
    """(recording_id, cluster, sce_id): activations that share a frame with an event."""
    a = acts.select("recording_id", "cluster", F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))
    e = sce.select("recording_id", "sce_id", F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))
    return a.join(e, ["recording_id", "frame"]).select("recording_id", "cluster", "sce_id").distinct()


def cluster_statistics(sce_stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean, deviation and median of duration and participation of each cluster's events."""
    s = sce_stats.join(labels, ["recording_id", "sce_id"])
    f = lambda c: [F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}"), F.percentile(c, F.lit(0.5)).alias(f"median_{c}")]
    return s.groupBy("recording_id", "label").agg(F.count("*").alias("n"), *f("duration"), *f("n_cells"))
