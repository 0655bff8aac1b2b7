"""Ordering cells by principal components of their traces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.operators import kernels as K
from pulsegrid.sources.durable import durable


def cross_covariance(a: np.ndarray, b: np.ndarray, lags: int, normalised: bool = False) -> np.ndarray:
    """Mean-removed products summed at each lag within ``lags`` (the middle alone for 0)."""
    full = np.correlate(a - a.mean(), b - b.mean(), "full")
    mid = len(b) - 1
    out = full[mid : mid + 1] if lags <= 0 else full[max(0, mid - lags) : mid + lags + 1]
    return out / (a.std() * b.std() * len(a)) if normalised else out


def lagged_components(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(components, time courses) of the symmetrised lag-1 covariance of a cells x frames matrix, centred both ways."""
    if x.shape[1] < x.shape[0]:
        raise ValueError("fewer frames than cells")
    x = x - x.mean(1, keepdims=True)
    x = x - x.mean(0, keepdims=True)
    c = x[:, :-1] @ x[:, 1:].T / (x.shape[1] - 1)
    value, vector = np.linalg.eigh((c + c.T) / 2)
    v = vector[:, np.argsort(value)[::-1][:n]]
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1, 1)  # a fixed sign
    return v, np.linalg.lstsq(v, x, rcond=None)[0]


def otsu(values: np.ndarray) -> int:
    """The level from 0 to 255 that best parts the values in two classes."""
    h = np.bincount(np.clip(values.astype(int), 0, 255), minlength=256).astype(float)
    p, m = np.cumsum(h), np.cumsum(h * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * p - m * p[-1]) ** 2 / (p * (p[-1] - p))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


#: Frames of a stretch over which products of cells are summed in one task.
STRETCH = 2048


def smoothed_rows(traces: DataFrame) -> DataFrame:
    """(recording_id, cell, frames, y): each cell's trace over all frames of its recording (0 where it has none), blurred twice over a twentieth of them."""
    r = "recording_id"
    every = traces.select(r, "frame").distinct().groupBy(r).agg(F.sort_array(F.collect_list("frame")).alias("frames"))
    own = traces.groupBy(r, "cell").agg(F.collect_list(F.struct("frame", "value")).alias("samples")).join(every, r)

    def blur(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p in pdf.itertuples():
                y = np.zeros(len(p.frames))
                y[np.searchsorted(p.frames, [s["frame"] for s in p.samples])] = [s["value"] for s in p.samples]
                width = len(y) / 20
                rows.append((p.recording_id, p.cell, K.gauss_blur_1d(K.gauss_blur_1d(y, width), width).tolist()))
            yield pd.DataFrame(rows, columns=[r, "cell", "y"])

    return own.mapInPandas(blur, "recording_id string, cell int, y array<double>")


def lagged_covariance(centred: DataFrame) -> DataFrame:
    """(recording_id, a, b, v): products of one cell at a frame and another at the next, summed over frames.

    ``centred(recording_id, cell, t, x)``, t counted from 0 without gaps. A stretch of frames,
    and the frame after it, is a task's work; stretches are summed.
    """
    at = F.floor(F.col("t") / STRETCH)
    # the first frame of a stretch also ends the one before
    dealt = centred.withColumn("stretch", F.explode(F.when((F.col("t") % STRETCH == 0) & (F.col("t") > 0), F.array(at, at - 1)).otherwise(F.array(at))))

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="cell", columns="t", values="x").sort_index(axis=1)
        x, ids = m.to_numpy(float), m.index.to_numpy()
        c = x[:, :-1] @ x[:, 1:].T
        return pd.DataFrame({"recording_id": pdf.recording_id.iloc[0], "a": np.repeat(ids, len(ids)), "b": np.tile(ids, len(ids)), "v": c.ravel()})

    parts = dealt.groupBy("recording_id", "stretch").applyInPandas(products, "recording_id string, a int, b int, v double")
    return parts.groupBy("recording_id", "a", "b").agg(F.sum("v").alias("v"))


def principal(covariance: DataFrame, n: int) -> DataFrame:
    """(recording_id, component, cell, weight): the first eigenvectors of the symmetrised covariance, each with its largest weight positive.

    The numbers of one recording's pairs of cells, whatever its length, fit a task.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="a", columns="b", values="v").sort_index().sort_index(axis=1)
        c = m.to_numpy(float)
        value, vector = np.linalg.eigh((c + c.T) / 2)
        v = vector[:, np.argsort(value)[::-1][:n]]
        v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1, 1)
        k, i = np.indices(v.T.shape)
        return pd.DataFrame({"recording_id": pdf.recording_id.iloc[0], "component": k.ravel(), "cell": m.index.to_numpy()[i.ravel()], "weight": v.T.ravel()})

    return covariance.groupBy("recording_id").applyInPandas(solve, "recording_id string, component int, cell int, weight double")


def order_by_components(traces: DataFrame, n_components: int = 10, lags: int = 200) -> DataFrame:
    """(recording_id, component, place, cell, correlation, lag) of ``traces(recording_id, cell, frame, value)``.

    Traces are blurred and centred by cell and by frame. A component's course is the sum of
    all cells by its weights; a cell's best correlation with the course's slope, within
    ``lags``, counts if it stands over the level that best parts a component's cells, and
    such cells are placed by lag. A recording with fewer frames than cells is refused.
    """
    r = "recording_id"
    t = traces.select(r, F.col("cell").cast("int").alias("cell"), "frame", F.col("value").cast("double").alias("value"))
    rows = durable(smoothed_rows(t))
    size = rows.groupBy(r).agg(F.count("*").alias("cells"), F.max(F.size("y")).alias("frames"))
    if not size.where("frames < cells").isEmpty():
        raise ValueError("fewer frames than cells")
    long = rows.select(r, "cell", F.posexplode("y").alias("t", "y"))
    by_cell = long.groupBy(r, "cell").agg(F.avg("y").alias("m"))
    x = long.join(by_cell, [r, "cell"]).select(r, "cell", "t", (F.col("y") - F.col("m")).alias("x"))
    by_frame = x.groupBy(r, "t").agg(F.avg("x").alias("m"))
    x = durable(x.join(by_frame, [r, "t"]).select(r, "cell", "t", (F.col("x") - F.col("m")).alias("x")))
    weights = durable(principal(lagged_covariance(x), n_components))
    course = x.join(weights, [r, "cell"]).groupBy(r, "component", "t").agg(F.sum(F.col("x") * F.col("weight")).alias("v"))
    slope = course.select(r, "component", "t", (F.coalesce(F.lead("v").over(W.partitionBy(r, "component").orderBy("t")), F.col("v")) - F.col("v")).alias("v"))
    slopes = slope.groupBy(r, "component").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda e: e["v"]).alias("slope"))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p in pdf.itertuples():
                y, s = np.asarray(p.y, float), np.asarray(p.slope, float)
                if y.std() and s.std():
                    c = cross_covariance(y, s, lags, True)
                    at = int(np.argmax(c))
                    out.append((p.recording_id, p.component, p.cell, float(c[at]), at - (len(c) - 1) // 2))
            yield pd.DataFrame(out, columns=[r, "component", "cell", "correlation", "lag"])

    found = durable(rows.join(slopes, r).mapInPandas(best, "recording_id string, component int, cell int, correlation double, lag int"))
    w = W.partitionBy(r, "component")
    lo, hi = F.min("correlation").over(w), F.max("correlation").over(w)
    # half to even, as the levels of a picture are rounded
    level = found.withColumn("level", F.bround(F.when(hi > lo, (F.col("correlation") - lo) / (hi - lo)).otherwise(0.0) * 255).cast("int"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({r: pdf[r].iloc[:1], "component": pdf.component.iloc[:1], "cut": [otsu(np.repeat(pdf.level.to_numpy(), pdf.n.to_numpy()))]})

    cuts = level.groupBy(r, "component", "level").agg(F.count("*").alias("n")).groupBy(r, "component").applyInPandas(cut, "recording_id string, component int, cut int")
    over = level.join(cuts, [r, "component"]).where("level > cut")
    place = F.row_number().over(w.orderBy("lag", "cell")) - 1
    return over.select(r, "component", place.cast("int").alias("place"), "cell", "correlation", "lag")
