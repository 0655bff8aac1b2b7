"""Signal operators on long series ``(recording_id, cell, frame, value)``; kernels run per series."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.operators import kernels as K
from pulsegrid.operators.raster import KEY

SERIES = "recording_id string, cell int, frame int, value double"


def per_series(samples: DataFrame, f: Callable[[np.ndarray], np.ndarray], by: list[str] = KEY, schema: str = SERIES) -> DataFrame:
    """``f`` on each series in frame order; its values get frames from 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        y = f(pdf["value"].to_numpy(float))
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in by}, "frame": np.arange(len(y)), "value": y})

    return samples.select(*by, "frame", "value").groupBy(*by).applyInPandas(run, schema)


def min_max(samples: DataFrame, by: list[str] = KEY) -> DataFrame:
    """Min-max scaling; a constant series is 0."""
    w = W.partitionBy(*by)
    span = F.max("value").over(w) - F.min("value").over(w)
    return samples.withColumn("value", F.when(span > 0, (F.col("value") - F.min("value").over(w)) / span).otherwise(0.0))


def median_normalised(samples: DataFrame, by: list[str] = KEY) -> DataFrame:
    """Values over their series' median; null where that is 0."""
    m = F.percentile("value", F.lit(0.5)).over(W.partitionBy(*by))
    return samples.withColumn("value", F.when(m != 0, F.col("value") / m))


def moving_mean(samples: DataFrame, width: int, by: list[str] = KEY) -> DataFrame:
    """Mean of each value and the ``width`` - 1 after it, as far as there are any."""
    return samples.withColumn("value", F.avg("value").over(W.partitionBy(*by).orderBy("frame").rowsBetween(0, width - 1)))


def exponential_smooth(samples: DataFrame, factor: float = 0.8) -> DataFrame:
    return per_series(samples, lambda x: K.exponential_smooth(x, factor))


def smooth(samples: DataFrame, length: int = 11, window: str = "hanning") -> DataFrame:
    return per_series(samples, lambda x: K.smooth(x, length, window))


def gauss_blur(samples: DataFrame, width: float) -> DataFrame:
    return per_series(samples, lambda x: K.gauss_blur_1d(x, width))


def gauss_blur_matrix(samples: DataFrame, width: float) -> DataFrame:
    """Blur over cells and frames of each recording, which must fit a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="cell", columns="frame", values="value").fillna(0.0)
        out = pd.DataFrame(K.gauss_blur_2d(m.to_numpy(float), width), index=m.index, columns=m.columns).stack().reset_index()
        out.columns = ["cell", "frame", "value"]
        out.insert(0, "recording_id", pdf.recording_id.iloc[0])
        return out

    return samples.groupBy("recording_id").applyInPandas(run, SERIES)


def savitzky_golay(samples: DataFrame, width: int = 5, order: int = 3) -> DataFrame:
    return per_series(samples, lambda x: K.savitzky_golay(x, width, order))


def bleaching_correction(samples: DataFrame) -> DataFrame:
    """Each series over its own cubic fit by place.

    The fit is a sum of the four polynomials that are orthogonal on places 0 .. n - 1, so it
    takes four sums a series. A series of under four samples fits itself with what degrees it has.
    """
    order, whole = W.partitionBy(*KEY).orderBy("frame"), W.partitionBy(*KEY)
    s = samples.select(*KEY, "frame", "value", (F.row_number().over(order) - 1).alias("__i"), F.count("*").over(whole).cast("double").alias("__n"))
    u, n = F.col("__i") - (F.col("__n") - 1) / 2, F.col("__n")
    parts = [F.lit(1.0), u, u * u - (n * n - 1) / 12, u * u * u - u * (3 * n * n - 7) / 20]
    s = s.select("*", *[p.alias(f"__p{k}") for k, p in enumerate(parts)])
    sums = s.groupBy(*KEY).agg(*[f.alias(f"__{c}{k}") for k in range(4) for c, f in (("v", F.sum(F.col("value") * F.col(f"__p{k}"))), ("s", F.sum(F.col(f"__p{k}") ** 2)))])
    fit = sum((F.when(F.col("__n") > k, F.col(f"__p{k}") * F.col(f"__v{k}") / F.col(f"__s{k}")).otherwise(0.0) for k in range(4)), F.lit(0.0))
    return s.join(sums, KEY).select(*KEY, "frame", (F.col("value") / fit).alias("value"))


def band_pass(samples: DataFrame, low: float, high: float, rate: float, order: int = 5) -> DataFrame:
    b, a = K.butter_bandpass(low, high, rate, order)
    return per_series(samples, lambda x: K.lfilter(b, a, x))


def cross_covariance(samples: DataFrame, pairs: DataFrame, lags: int, normalised: bool = False) -> DataFrame:
    """(recording_id, a, b, lag, value) for ``pairs(recording_id, a, b)`` of cells.

    Sum of the mean-removed products at each lag in [-lags, lags]; ``normalised`` divides
    by both deviations and the length.
    """
    w = W.partitionBy(*KEY)
    c = samples.select(*KEY, "frame", (F.col("value") - F.avg("value").over(w)).alias("v"), F.stddev_pop("value").over(w).alias("sd"), F.count("*").over(w).alias("n"))
    a = c.select("recording_id", F.col("cell").alias("a"), "frame", "v", "sd", "n").join(pairs, ["recording_id", "a"])
    a = a.withColumn("lag", F.explode(F.sequence(F.lit(-lags), F.lit(lags)))).withColumn("at", F.col("frame") - F.col("lag"))
    b = c.select("recording_id", F.col("cell").alias("b"), F.col("frame").alias("at"), F.col("v").alias("v2"), F.col("sd").alias("sd2"))
    g = a.join(b, ["recording_id", "b", "at"]).groupBy("recording_id", "a", "b", "lag")
    total = F.sum(F.col("v") * F.col("v2"))
    return g.agg((total / (F.first("sd") * F.first("sd2") * F.first("n")) if normalised else total).alias("value"))
