"""k-means and silhouettes of many labellings at once, block by block.

Points of a set (a recording, or one of its surrogates) are dealt to blocks of ``BLOCK``
rows; a block, or a pair of blocks, is a task's work and a matrix product. A set's runs
(number of clusters, trial) share its blocks and go side by side: every round is one job
for all runs that still move. Distances of pairs are summed by cluster where they are
made and never become rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.sources.durable import durable

BLOCK = 512
#: Silhouettes: points of a block at most and at least, blocks of a set unless they are full, points of a tile, tasks of one job at most.
MOST, LEAST, WIDE, TILE, TASKS = 32_768, 512, 12, 256, 8192
#: Squares of distances under this share of a point's own square are made from differences.
NEAR = 1e-6
RUN = ["set", "k", "trial"]
RUNS = "set string, k int, trial int"


def blocks(points: DataFrame) -> DataFrame:
    """(set, block, ids, vectors) of ``points(set, id, vector)``, dealt in order of id."""
    at = F.floor((F.row_number().over(W.partitionBy("set").orderBy("id")) - 1) / BLOCK).cast("int")
    held = points.select("set", F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).withColumn("block", at)
    rows = F.array_sort(F.collect_list(F.struct("id", "vector")))
    return durable(held.groupBy("set", "block").agg(rows.alias("rows")).select("set", "block", F.transform("rows", lambda r: r["id"]).alias("ids"), F.transform("rows", lambda r: r["vector"]).alias("vectors")))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1), 0)


def _per_block(held: DataFrame, runs: DataFrame, each, schema: str) -> DataFrame:
    """``each(set, block, ids, x, run)`` to rows, for every block of a set and every run of ``runs(set, k, trial, ...)``."""
    names = [c for c in runs.columns if c != "set"]
    listed = runs.groupBy("set").agg(F.collect_list(F.struct(*names)).alias("runs"))  # as many as parameters ask for
    columns = [f.split(" ", 1)[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                x = np.array(list(r.vectors), float).reshape(len(r.ids), -1)
                out = [(r.set, s["k"], s["trial"], *row) for s in r.runs for row in each(r.set, r.block, r.ids, x, s)]
                yield pd.DataFrame(out, columns=columns)

    return held.join(listed, "set").mapInPandas(run, schema)


def _centres(run) -> np.ndarray | None:
    c = run["centres"]
    return None if c is None or not len(c) else np.array(list(c), float)


def starts(held: DataFrame, runs: DataFrame, seed: int) -> DataFrame:
    """(set, k, trial, centres): spread-out starting points; each further one is drawn with the square of its distance as weight.

    A draw is the largest of log weight and Gumbel noise, so blocks draw for themselves.
    """

    def draw(name, block, ids, x, run) -> Iterator[tuple]:
        c = _centres(run)
        if c is not None and len(c) >= run["k"]:
            return
        n = 0 if c is None else len(c)
        rng = np.random.default_rng([seed, zlib.crc32(name.encode()), run["k"], run["trial"], n, block])
        weight = np.ones(len(x)) if c is None else _squares(x, c).min(1)
        noise = -np.log(-np.log(rng.random(len(x))))
        with np.errstate(divide="ignore"):
            best = int(np.argmax(np.log(weight) + noise if (weight > 0).any() else noise - 1e9))
        yield float(np.log(max(weight[best], 1e-300)) + noise[best]), x[best].tolist()

    state = runs.withColumn("centres", F.array().cast("array<array<double>>"))
    most = runs.agg(F.max("k")).first()[0] or 0
    for _ in range(most):
        drawn = _per_block(held, state, draw, f"{RUNS}, weight double, vector array<double>").groupBy(*RUN).agg(F.max_by("vector", "weight").alias("more"))
        joined = state.join(drawn, RUN, "left")
        state = durable(joined.select(*RUN, F.when(F.col("more").isNull(), F.col("centres")).otherwise(F.concat("centres", F.array("more"))).alias("centres")))
    return state


def kmeans(points: DataFrame, runs: DataFrame, seed: int = 0, rounds: int = 100) -> DataFrame:
    """(set, k, trial, id, label) of ``points(set, id, vector)`` for each of ``runs(set, k, trial)``.

    A cluster that loses all its points keeps its centre. Of equal distances the first
    centre has the point.
    """
    held = blocks(points)

    def summed(name, block, ids, x, run) -> Iterator[tuple]:
        c = _centres(run)
        one = np.eye(len(c))[_squares(x, c).argmin(1)]
        for j, (n, total) in enumerate(zip(one.sum(0), one.T @ x, strict=True)):
            if n:
                yield j, int(n), total.tolist()

    moving, still = starts(held, runs, seed), None
    for _ in range(rounds):
        parts = _per_block(held, moving, summed, f"{RUNS}, cluster int, n long, total array<double>")
        whole = parts.select(*RUN, "cluster", "n", F.posexplode("total").alias("i", "v")).groupBy(*RUN, "cluster", "i").agg((F.sum("v") / F.sum("n")).alias("v"))
        new = whole.groupBy(*RUN, "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("centre"))
        old = moving.select(*RUN, F.posexplode("centres").alias("cluster", "before"))
        both = old.join(new, [*RUN, "cluster"], "left").withColumn("centre", F.coalesce("centre", "before"))
        state = both.groupBy(*RUN).agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "centre"))), lambda s: s["centre"]).alias("centres"), F.every(F.col("centre") == F.col("before")).alias("settled"))
        state = durable(state)
        done = state.where("settled").drop("settled")
        still = done if still is None else still.union(done)
        moving = state.where("not settled").drop("settled")
        if moving.isEmpty():
            break
    final = still.union(moving)

    def labelled(name, block, ids, x, run) -> Iterator[tuple]:
        yield from zip(map(int, ids), _squares(x, _centres(run)).argmin(1).tolist(), strict=True)

    return _per_block(held, final, labelled, f"{RUNS}, id long, label int")


def silhouettes(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(set, k, trial, id, label, silhouette) with Euclidean distances, for ``labels(set, k, trial, id, label)``.

    A pair of blocks gives each point of both its sums of distances to every cluster within
    the other; each pair is met once. The only member of a cluster, and all points of a
    single one, have 0.
    """
    runs = labels.groupBy("set", "id").agg(F.collect_list(F.struct("k", "trial", "label")).alias("runs"))
    held = points.select("set", F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    held = durable(held.join(runs, ["set", "id"]))
    count = held.groupBy("set").agg(F.count("*").alias("n"))
    many = durable(count.select("set", F.greatest(F.ceil(F.col("n") / MOST), F.least(F.lit(WIDE), F.ceil(F.col("n") / LEAST))).cast("int").alias("many")))
    pairs = many.agg(F.sum(F.col("many") * (F.col("many") + 1) / 2)).first()[0] or 1
    dealt = held.join(F.broadcast(many), "set").withColumn("block", F.pmod(F.xxhash64("id"), F.col("many")).cast("int"))
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    sent = sent.select("set", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "id", "vector", "runs")
    met = sent.repartition(int(min(4 * pairs, TASKS)), "set", "a", "b").groupBy("set", "a", "b")
    sums = met.applyInArrow(_sums, f"{RUNS}, id long, cluster int, total double").groupBy(*RUN, "id", "cluster").agg(F.sum("total").alias("total"))
    size = labels.groupBy(*RUN, F.col("label").alias("cluster")).agg(F.count("*").alias("n"))
    each = sums.join(size, [*RUN, "cluster"]).join(labels, [*RUN, "id"])
    own = F.col("cluster") == F.col("label")
    ab = each.groupBy(*RUN, "id", "label").agg(
        F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b")
    )
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).when(F.greatest("a", "b") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return ab.select(*RUN, "id", "label", s.alias("silhouette"))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows; those of near rows by their differences, since the product loses them."""
    norm = (x**2).sum(1)
    d = (-2 * x) @ y.T
    d += norm[:, None]
    d += (y**2).sum(1)
    rows = np.flatnonzero(d.min(1) <= NEAR * norm)
    i, j = np.nonzero(d[rows] <= NEAR * norm[rows, None])
    for at in range(0, len(i), TILE * 16):
        u, v = rows[i[at : at + TILE * 16]], j[at : at + TILE * 16]
        d[u, v] = ((x[u] - y[v]) ** 2).sum(1)
    return np.sqrt(d, out=d)


def _sums(table: pa.Table) -> pa.Table:
    """Sums of distances of the points of a pair of blocks (or of one with itself) to the clusters of the other, tile by tile."""
    table = table.combine_chunks().sort_by("block")
    ids, block = (table.column(c).to_numpy() for c in ("id", "block"))
    x = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    lists = table.column("runs").combine_chunks()
    at = np.repeat(np.arange(len(ids)), np.asarray(pc.list_value_length(lists)))
    flat = lists.flatten()
    codes, of = np.unique(np.stack([flat.field(c).to_numpy() for c in ("k", "trial", "label")], 1), axis=0, return_inverse=True)
    member = np.zeros((len(ids), len(codes)))
    member[at, of.ravel()] = 1
    total = np.zeros_like(member)
    same = block[0] == block[-1]
    first = len(ids) if same else int(np.searchsorted(block, block[-1]))
    for top in range(0, first, TILE):
        a = slice(top, min(top + TILE, first))
        for left in range(top if same else first, len(ids), TILE):
            b = slice(left, left + TILE)
            d = _distances(x[a], x[b])
            total[a] += d @ member[b]
            if a.start != b.start:
                total[b] += d.T @ member[a]
    return _rows(table, ids, codes, member, total, same, first)


def _rows(table: pa.Table, ids: np.ndarray, codes: np.ndarray, member: np.ndarray, total: np.ndarray, same: bool, first: int) -> pa.Table:
    """A row for each point and each cluster that the other block has a member of."""
    seen = member.any(0) if same else None
    i, j = [], []
    for own, other in [(slice(0, len(ids)), seen)] if same else [(slice(0, first), member[first:].any(0)), (slice(first, len(ids)), member[:first].any(0))]:
        at, to = np.meshgrid(np.arange(len(ids))[own], np.flatnonzero(other), indexing="ij")
        i.append(at.ravel())
        j.append(to.ravel())
    i, j = np.concatenate(i), np.concatenate(j)
    k, trial, label = (pa.array(codes[j, c].astype(np.int32)) for c in range(3))
    return pa.table({"set": pa.repeat(table.column("set")[0], len(i)), "k": k, "trial": trial, "id": pa.array(ids[i]), "cluster": label, "total": pa.array(total[i, j])})
