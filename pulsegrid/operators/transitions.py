"""Transition tables between cells, their surrogate filter and the follower graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulsegrid.operators import follow_blocks as B
from pulsegrid.operators.surrogates import roll_offset


def transitions(spikes: DataFrame, recordings: DataFrame, low: int, high: int, rates: DataFrame | None = None, no_reverse: bool = False, by: list[str] = (), skip: DataFrame | None = None, lags: bool = True) -> DataFrame:
    """(.., src, dst, weight[, mean_lag]): how often dst follows src in ``[t + low, t + high)``, once per source spike.

    ``rates(recording_id, cell, rate)`` weighs a follower by one less its rate;
    ``no_reverse`` takes off what the pair gains the other way round. Weights of 0 or less
    have no row. ``skip(recording_id, frame)`` frames are not searched; without ``lags`` none are counted. All pairs are
    counted by products of blocks (see ``follow_blocks``).
    """
    key = ["recording_id", *by]
    fields = [spikes.schema[c] for c in key] + [T.StructField(c, spikes.schema["cell"].dataType) for c in ("src", "dst")]
    schema = T.StructType([*fields, *[T.StructField(c, T.DoubleType()) for c in ("weight", "mean_lag")[: 1 + lags]]])
    types = to_arrow_schema(schema)
    weighed = rates is not None

    def each(first: B.Side, second: B.Side, names: dict) -> Iterator[pa.RecordBatch]:
        if no_reverse and not lags:
            yield from net(first, second, names)
            return
        for src, dst, same in B.strips(first, second):
            left = np.nan_to_num(1 - dst.column("rate"), nan=0.0) if weighed else None  # a follower without a rate has no row
            back = _reverse(dst, src, low, high, same) if no_reverse else None
            gone = np.nan_to_num(1 - src.column("rate"), nan=0.0) if weighed else None
            for top, n, lag in B.products(src, dst, low, high, same, lags):
                gain = n.astype(float) if left is None else n * left
                if back is not None:
                    other = back(top, len(n)).astype(float)
                    gain = gain - (other if gone is None else other * gone[top : top + len(n), None])
                i, j = np.nonzero((gain > 0) & (n > 0))
                if len(i):
                    late = [lag[i, j] / n[i, j].astype(float)] if lags else []
                    yield _edges(types, names, src.cells.take(pa.array(top + i)), dst.cells.take(pa.array(j)), gain[i, j], *late)

    def net(first: B.Side, second: B.Side, names: dict) -> Iterator[pa.RecordBatch]:
        """Both directions of each pair of cells at once: what the one gains the other loses."""
        same = first is second
        back = _reverse(second, first, low, high, same)
        for top, n, _ in B.products(first, second, low, high, same, lags=False):
            n, other = n.astype(np.float32, copy=False) if n.dtype == np.uint8 else n, back(top, len(n))
            if weighed:
                kept, gone = (np.nan_to_num(1 - side.column("rate"), nan=0.0) for side in (second, first))
                gain = n * kept - other * gone[top : top + len(n), None]
            else:
                gain = n - other
            for found, (src, dst), way in [((gain > 0) & (n > 0), (0, 1), 1)] + [((gain < 0) & (other > 0), (1, 0), -1)] * (not same):
                at = np.flatnonzero(found)
                if len(at):
                    i, j = np.divmod(at, n.shape[1])
                    cells = first.cells.take(pa.array(top + i)), second.cells.take(pa.array(j))
                    yield _edges(types, names, cells[src], cells[dst], (way * gain.ravel()[at]).astype(float))

    return B.pair_blocks(spikes, recordings, key, each, schema, skip, rates)


def _edges(types: pa.Schema, names: dict, src: pa.Array, dst: pa.Array, *values: np.ndarray) -> pa.RecordBatch:
    n = len(src)
    ids = [pa.repeat(pa.scalar(v, types.field(c).type), n) for c, v in names.items()]
    return pa.RecordBatch.from_arrays([*ids, src, dst, *[pa.array(v, f.type) for v, f in zip(values, list(types)[len(ids) + 2 :], strict=True)]], schema=types)


def _reverse(dst: B.Side, src: B.Side, low: int, high: int, same: bool) -> Callable[[int, int], np.ndarray]:
    """Counts of the other direction, for a strip of the source's cells: how often they follow all of ``dst``."""
    if dst.thin:
        whole = np.empty((len(dst), len(src)), np.uint8)
        for top, n, _ in B.products(dst, src, low, high, same, lags=False):
            whole[top : top + len(n)] = n
        return lambda top, many: whole[:, top : top + many].T

    t, x = dst.sources()
    hit, _ = B.follows(src.raster(), t, low, high, False)
    kind = B.exact(src.n_frames, low, high)
    x, hit = x.astype(kind, copy=False).T, hit.astype(kind, copy=False)

    def part(top: int, many: int) -> np.ndarray:
        n = hit[top : top + many] @ x
        if same:
            n[np.arange(many), np.arange(top, top + many)] = 0
        return n

    return part


def top_transitions(spikes: DataFrame, recordings: DataFrame, low: int, high: int, k: int) -> DataFrame:
    """``top_followers(transitions(..), k)``, of which no more than ``k`` followers of a cell leave a pair of blocks."""
    schema = T.StructType([spikes.schema["recording_id"], *[T.StructField(c, spikes.schema["cell"].dataType) for c in ("src", "dst")], T.StructField("weight", T.DoubleType()), T.StructField("mean_lag", T.DoubleType())])
    types = to_arrow_schema(schema)

    def each(first: B.Side, second: B.Side, names: dict) -> Iterator[pa.RecordBatch]:
        for src, dst, same in B.strips(first, second):
            for top, n, lag in B.products(src, dst, low, high, same):
                rows = np.arange(len(n))
                left = n.copy()
                for _ in range(min(k, n.shape[1])):
                    j = left.argmax(1)  # of equals the lowest cell: cells are in order
                    on = left[rows, j] > 0
                    left[rows, j] = 0
                    if not on.any():
                        break
                    i, j = rows[on], j[on]
                    yield _edges(types, names, src.cells.take(pa.array(top + i)), dst.cells.take(pa.array(j)), n[i, j].astype(float), lag[i, j] / n[i, j].astype(float))

    return top_followers(B.pair_blocks(spikes, recordings, ["recording_id"], each, schema), k)


def transition_degrees(spikes: DataFrame, recordings: DataFrame, low: int, high: int) -> DataFrame:
    """(recording_id, node, degree): how many other cells follow a cell or are followed by it, counted where the products are made."""
    schema = T.StructType([spikes.schema["recording_id"], T.StructField("node", spikes.schema["cell"].dataType), T.StructField("n", T.LongType())])
    types = to_arrow_schema(schema)

    def each(first: B.Side, second: B.Side, names: dict) -> Iterator[pa.RecordBatch]:
        same = first is second
        back = _reverse(second, first, low, high, same)
        rows, columns = np.zeros(len(first), int), np.zeros(len(second), int)
        for top, n, _ in B.products(first, second, low, high, same, lags=False):
            tied = (n > 0) | (back(top, len(n)) > 0)
            rows[top : top + len(n)] = tied.sum(1)
            columns += tied.sum(0)
        for side, counts in [(first, rows)] if same else [(first, rows), (second, columns)]:
            ids = [pa.repeat(pa.scalar(v, types.field(c).type), len(side)) for c, v in names.items()]
            yield pa.RecordBatch.from_arrays([*ids, side.cells, pa.array(counts, pa.int64())], schema=types)

    parts = B.pair_blocks(spikes, recordings, ["recording_id"], each, schema)
    return parts.groupBy("recording_id", "node").agg(F.sum("n").alias("degree")).where("degree > 0")


def run_transitions(runs: DataFrame, run_frames: DataFrame, recordings: DataFrame, low: int, high: int) -> DataFrame:
    """Transitions between runs: +1 per source run for each cell active in the union of its frames' look-ahead windows."""
    lo, hi = F.greatest(F.lit(0), F.col("start_frame") + low), F.least(F.col("end_frame") + high, F.col("n_frames")) - 1
    src = runs.join(recordings.select("recording_id", "n_frames"), "recording_id").where(lo <= hi)
    src = src.select("recording_id", F.col("cell").alias("src"), "run_id", "start_frame", F.explode(F.sequence(lo, hi.cast("int"))).alias("frame"))
    met = src.join(run_frames.withColumnRenamed("cell", "dst"), ["recording_id", "frame"]).where("src <> dst")
    first = met.groupBy("recording_id", "src", "run_id", "dst").agg(F.min(F.col("frame") - F.col("start_frame")).alias("lag"))
    return first.groupBy("recording_id", "src", "dst").agg(F.count("*").cast("double").alias("weight"), F.avg("lag").alias("mean_lag"))


def significant_transitions(spikes: DataFrame, recordings: DataFrame, low: int, high: int, n_surrogates: int, percentile: float = 95, seed: int = 0) -> DataFrame:
    """Transitions over the percentile of the same pair's weight in rolled surrogates (0 where a surrogate has none).

    A pair of blocks is counted in all surrogates where its real counts are; of each pair of
    cells the largest weights that the percentile lies among are kept.
    """
    schema = T.StructType([spikes.schema["recording_id"], *[T.StructField(c, spikes.schema["cell"].dataType) for c in ("src", "dst")], *[T.StructField(c, T.DoubleType()) for c in ("weight", "mean_lag", "cut")]])
    types = to_arrow_schema(schema)
    at = percentile / 100 * (n_surrogates - 1)
    most = n_surrogates - int(at)  # the largest of them, down to the one below the percentile

    def each(first: B.Side, second: B.Side, names: dict) -> Iterator[pa.RecordBatch]:
        for src, dst, same in B.strips(first, second):
            own, other = (np.array(s.rows.field("offsets").to_pylist(), np.int64).reshape(len(s), -1) for s in (src, dst))
            high_w = np.zeros((min(most, n_surrogates), len(src), len(dst)), np.uint8 if src.thin else np.float32)  # largest first
            for k in range(n_surrogates):
                for top, n, _ in B.products(src, dst, low, high, same, lags=False, own=own[:, k], other=other[:, k]):
                    keep_largest(high_w[:, top : top + len(n)], n)
            for top, n, lag in B.products(src, dst, low, high, same):
                held = high_w[:, top : top + len(n)].astype(float)
                below, above = held[-1], held[max(len(held) - 2, 0)]
                cut = below + (above - below) * (at - int(at))
                i, j = np.divmod(np.flatnonzero(n > cut), n.shape[1])
                if len(i):
                    yield _edges(types, names, src.cells.take(pa.array(top + i)), dst.cells.take(pa.array(j)), n[i, j].astype(float), lag[i, j] / n[i, j].astype(float), cut[i, j])

    rolls = F.array(*[roll_offset(F.col("n_frames"), seed, F.lit(s)) for s in range(n_surrogates)])
    return B.pair_blocks(spikes, recordings, ["recording_id"], each, schema, offsets=rolls)


def keep_largest(held: np.ndarray, new: np.ndarray) -> None:
    """``held``, the largest values of each place from the largest down, with ``new`` among them; in place."""
    for rank in held[:-1]:
        less = np.minimum(rank, new)
        np.maximum(rank, new, out=rank)
        new = less
    np.maximum(held[-1], new, out=held[-1])


def top_followers(edges: DataFrame, k: int, min_weight: float | None = None, second: DataFrame | None = None, by_lag: bool = False) -> DataFrame:
    """(recording_id, src, dst, weight, rank): the best ``k`` followers of each cell.

    Ties go to the larger second-order weight, then (or before) the shorter lag, then the lowest cell.
    """
    e = edges if min_weight is None else edges.where(F.col("weight") >= min_weight)
    order = [F.desc("weight")]
    if second is not None:
        e = e.join(second.select("recording_id", "src", "dst", F.col("weight").alias("second")), ["recording_id", "src", "dst"], "left")
        order.append(F.coalesce("second", F.lit(0.0)).desc())
    if by_lag:
        order.append(F.asc("mean_lag"))
    rank = F.row_number().over(W.partitionBy("recording_id", "src").orderBy(*order, F.asc("dst")))
    return e.withColumn("rank", rank).where(F.col("rank") <= k).select("recording_id", "src", "dst", "weight", "mean_lag", "rank")


def tied_chains(edges: DataFrame) -> DataFrame:
    """Followers that tie for a cell's best score, chained in lag order instead: src to the first, each to the next."""
    best = F.max("weight").over(W.partitionBy("recording_id", "src"))
    tied = edges.withColumn("best", best).where("weight = best").withColumn("m", F.count("*").over(W.partitionBy("recording_id", "src"))).where("m > 1")
    before = F.lag("dst").over(W.partitionBy("recording_id", "src").orderBy("mean_lag", "dst"))
    return tied.select("recording_id", F.coalesce(before, F.col("src")).alias("src"), "dst", "weight", "mean_lag").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Degree of each node of an undirected edge list (repeats and loops don't count)."""
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    return e.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def path_weight(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(path_id, weight): sum of edge weights along ``paths(path_id, path ARRAY)``."""
    pairs = paths.where("size(path) > 1").select("path_id", F.explode(F.expr("transform(sequence(1, size(path) - 1), i -> named_struct('src', path[i - 1], 'dst', path[i]))")).alias("e")).select("path_id", "e.src", "e.dst")
    s = pairs.join(edges.select("src", "dst", "weight"), ["src", "dst"]).groupBy("path_id").agg(F.sum("weight").alias("weight"))
    return paths.join(s, "path_id", "left").select("path_id", F.coalesce("weight", F.lit(0.0)).alias("weight"))
