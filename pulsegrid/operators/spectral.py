"""Spectral analysis: Morlet power, background fit, episodes, spikes, Welch spectra.

Signals are ``(segment, sample, value)``; power tables ``(segment, freq, t, power)``.
A segment is the unit of parallel work.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.operators import kernels as K
from pulsegrid.operators.connected import components
from pulsegrid.sources.durable import durable


@dataclass(frozen=True)
class Band:
    """A named band of frequencies; its width is three cycles of its mean frequency."""

    name: str
    low: float
    high: float

    @property
    def min_duration(self) -> float:
        return 3 / ((self.low + self.high) / 2)


#: The bands explored by default.
BANDS = (Band("delta", 1, 5), Band("theta", 5, 12))


@dataclass
class WaveletOptions:
    """Options of a spectral analysis."""

    min_freq: float = 1.0
    max_freq: float = 40.0
    n_freqs: int = 40
    log_freqs: bool = False
    cycles: float = 6.0
    max_cycles: float | None = None
    #: half the length of the wavelets, or None for as long as they need to fade
    wavelet_seconds: float | None = 2.0
    derivative: bool = False
    baseline: str | None = None
    median_threshold: bool = False
    spike_share: float = 0.7
    spike_ratio: float = 1.2
    percentile: float = 0.95
    n_cycles: float = 3.0
    bands: tuple = field(default_factory=lambda: BANDS)

    def freqs(self) -> np.ndarray:
        if self.log_freqs:
            return np.logspace(np.log10(self.min_freq), np.log10(self.max_freq), self.n_freqs)
        return np.linspace(self.min_freq, self.max_freq, self.n_freqs)

    def cycle_counts(self) -> np.ndarray:
        """Fixed cycles, or ones that grow up to ``max_cycles`` the way the frequencies do."""
        if self.max_cycles is None:
            return np.full(self.n_freqs, self.cycles)
        if self.log_freqs:
            return np.logspace(np.log10(self.cycles), np.log10(self.max_cycles), self.n_freqs)
        return np.linspace(self.cycles, self.max_cycles, self.n_freqs)

    def bands_in_range(self) -> list[Band]:
        return [b for b in self.bands if b.low >= self.min_freq and b.high <= self.max_freq]


def segments(signal: DataFrame, rate: float, seconds: float) -> DataFrame:
    """Cuts ``(sample, value)`` into windows: (segment, sample from 0, value)."""
    n = int(seconds * rate)
    return signal.select(F.floor(F.col("sample") / n).cast("int").alias("segment"), (F.col("sample") % n).cast("int").alias("sample"), "value")


def morlet_power(signal: DataFrame, rate: float, options: WaveletOptions) -> DataFrame:
    """(segment, freq_idx, freq, t, power)."""
    freqs, cycles = options.freqs(), options.cycle_counts()
    kind = signal.schema["segment"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("sample")["value"].to_numpy(float)
        p = K.morlet_power(np.diff(x, prepend=x[:1]) if options.derivative else x, rate, freqs, cycles, options.wavelet_seconds)
        i, t = np.indices(p.shape)
        return pd.DataFrame({"segment": pdf.segment.iloc[0], "freq_idx": i.ravel(), "freq": freqs[i.ravel()], "t": t.ravel(), "power": p.ravel()})

    return signal.groupBy("segment").applyInPandas(run, f"segment {kind}, freq_idx int, freq double, t int, power double")


def normalise(power: DataFrame, baseline: DataFrame | None = None, mode: str | None = None) -> DataFrame:
    """Power against a baseline ``(freq, mean, std)``: ``zscore``, ``decibel`` or ``percent``; else ten times its logarithm, or raw for ``raw``."""
    p = F.col("power")
    if mode == "raw":
        return power
    if baseline is None:
        return power.withColumn("power", 10 * F.log10(p))
    m = power.join(F.broadcast(baseline), "freq")  # one row a frequency
    out = {"zscore": (p - F.col("mean")) / F.col("std"), "decibel": 10 * F.log10(p / F.col("mean")), "percent": 100 * (p - F.col("mean")) / F.col("mean")}[mode or "decibel"]
    return m.withColumn("power", out).drop("mean", "std")


def baseline_of(power: DataFrame) -> DataFrame:
    return power.groupBy("freq").agg(F.avg("power").alias("mean"), F.stddev_pop("power").alias("std"))


def power_spectrum(power: DataFrame) -> DataFrame:
    """Mean over time per (segment, freq)."""
    return power.groupBy("segment", "freq").agg(F.avg("power").alias("power"))


def welch_change(signal: DataFrame, rate: float, baseline: DataFrame | None = None) -> DataFrame:
    """(segment, freq, power): Welch density, as percent change against ``baseline(freq, power)`` where given."""
    kind = signal.schema["segment"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f, p = K.welch(pdf.sort_values("sample")["value"].to_numpy(float), rate)
        return pd.DataFrame({"segment": pdf.segment.iloc[0], "freq": f, "power": p})

    out = signal.groupBy("segment").applyInPandas(run, f"segment {kind}, freq double, power double")
    if baseline is None:
        return out
    b = baseline.select("freq", F.col("power").alias("base"))
    return out.join(b, "freq").select("segment", "freq", (100 * (F.col("power") - F.col("base")) / F.col("base")).alias("power"))


def background_fit(power: DataFrame) -> DataFrame:
    """(segment, freq, mean_power): the line through mean log power over log frequency, evaluated back."""
    m = power.groupBy("segment", "freq").agg(F.avg(F.log10("power")).alias("y")).withColumn("x", F.log10("freq"))
    f = m.groupBy("segment").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    return m.join(f, "segment").select("segment", "freq", F.pow(F.lit(10.0), F.col("slope") * F.col("x") + F.col("intercept")).alias("mean_power"))


def thresholds(background: DataFrame, rate: float, percentile: float = 0.95, cycles: float = 3.0) -> DataFrame:
    """Power threshold (chi-square of 2 degrees: -ln(1 - p) times the mean) and least duration in samples."""
    return background.select("segment", "freq", (-F.log(F.lit(1 - percentile)) * F.col("mean_power")).alias("power_threshold"), (F.lit(cycles * rate) / F.col("freq")).alias("duration_threshold"))


def episodes(power: DataFrame, limits: DataFrame) -> DataFrame:
    """(segment, freq, start_t, end_t): runs over the power threshold that last long enough; ``end_t`` is the first sample after."""
    over = power.join(limits, ["segment", "freq"]).where("power > power_threshold")
    w = W.partitionBy("segment", "freq").orderBy("t")
    runs = over.withColumn("g", F.col("t") - F.row_number().over(w)).groupBy("segment", "freq", "g").agg(F.min("t").alias("start_t"), (F.max("t") + 1).cast("int").alias("end_t"), F.first("duration_threshold").alias("least"))
    return runs.where(F.col("end_t") - F.col("start_t") >= F.col("least")).select("segment", "freq", "start_t", "end_t")


def episode_share(found: DataFrame, power: DataFrame, band: Band | None = None) -> DataFrame:
    """(segment, freq, share): part of the time in episodes, for each frequency of a band."""
    n = power.groupBy("segment", "freq").agg(F.count_distinct("t").alias("n"))
    t = found.groupBy("segment", "freq").agg(F.sum(F.col("end_t") - F.col("start_t")).alias("inside"))
    out = n.join(t, ["segment", "freq"], "left").select("segment", "freq", (F.coalesce("inside", F.lit(0)) / F.col("n")).alias("share"))
    return out if band is None else out.where(F.col("freq").between(band.low, band.high))


def power_threshold(power: DataFrame, median: bool = False) -> DataFrame:
    """(segment, threshold): the median, or the mean and one deviation."""
    t = F.percentile("power", F.lit(0.5)) if median else F.avg("power") + F.stddev_pop("power")
    return power.groupBy("segment").agg(t.alias("threshold"))


def band_episodes(power: DataFrame, limits: DataFrame, band: Band, rate: float, step: float = 1.0) -> DataFrame:
    """(segment, low, high, start_t, end_t): per ``step``-wide slice of a band, runs in which any frequency exceeds the threshold."""
    p = power.where((F.col("freq") >= band.low) & (F.col("freq") < band.high)).join(limits, "segment")
    s = p.withColumn("slice", F.floor((F.col("freq") - band.low) / step)).groupBy("segment", "slice", "t").agg(F.max(F.col("power") > F.col("threshold")).alias("on")).where("on")
    w = W.partitionBy("segment", "slice").orderBy("t")
    r = s.withColumn("g", F.col("t") - F.row_number().over(w)).groupBy("segment", "slice", "g").agg(F.min("t").alias("start_t"), (F.max("t") + 1).cast("int").alias("end_t"))
    low = band.low + F.col("slice") * step
    return r.where(F.col("end_t") - F.col("start_t") > band.min_duration * rate).select("segment", low.alias("low"), (low + step).alias("high"), "start_t", "end_t")


#: Samples of a stretch by which runs of neighbouring frequencies find each other.
STRETCH = 256


def regions(on: DataFrame) -> DataFrame:
    """(segment, region, first_row, last_row, start_t, end_t, size): the 8-connected regions of ``on(segment, row, t)``.

    Runs along time are the nodes; runs of neighbouring rows that touch, corners included,
    are the edges, found by stretches of time that both reach; a region is a component.
    ``region`` numbers a segment's regions by their first sample and row; ``end_t`` is the
    first sample after. No map of a segment is laid out.
    """
    key = ["segment", "row"]
    order = W.partitionBy(*key).orderBy("t")
    runs = on.select(*key, "t").distinct().withColumn("g", F.col("t") - F.row_number().over(order)).groupBy(*key, "g").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    runs = durable(runs.select(F.struct("segment", "a", "row").alias("run"), *key, "a", "z"))
    at = lambda lo, hi: F.explode(F.sequence(F.floor(lo / STRETCH), F.floor(hi / STRETCH)))
    low = runs.select("segment", (F.col("row") + 1).alias("row"), F.col("run").alias("u"), F.col("a").alias("ua"), F.col("z").alias("uz"), at(F.col("a") - 1, F.col("z") + 1).alias("stretch"))
    high = runs.select(*key, F.col("run").alias("v"), F.col("a").alias("va"), F.col("z").alias("vz"), at(F.col("a"), F.col("z")).alias("stretch"))
    touch = low.join(high, [*key, "stretch"]).where("va <= uz + 1 and vz >= ua - 1").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()
    joined = runs.join(components(touch), F.col("run") == F.col("node"), "left").withColumn("root", F.coalesce("root", "run"))
    out = joined.groupBy("segment", "root").agg(
        F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.min("a").alias("start_t"), (F.max("z") + 1).cast("int").alias("end_t"), F.sum(F.col("z") - F.col("a") + 1).alias("size")
    )
    number = F.row_number().over(W.partitionBy("segment").orderBy("root")) - 1
    return out.select("segment", number.cast("int").alias("region"), "first_row", "last_row", "start_t", "end_t", "size")


def region_episodes(power: DataFrame, limits: DataFrame, band: Band, rate: float) -> DataFrame:
    """(segment, low, high, start_t, end_t): connected regions of the spectrogram over the threshold that last long enough."""
    p = power.where(F.col("freq").between(band.low, band.high))
    freqs = p.select("segment", "freq").distinct().withColumn("row", F.row_number().over(W.partitionBy("segment").orderBy("freq")))
    over = p.join(limits, "segment").where("power > threshold").join(freqs, ["segment", "freq"]).select("segment", "row", "t")
    r = regions(over).where(F.col("end_t") - F.col("start_t") > band.min_duration * rate)
    name = lambda row, f: freqs.select("segment", F.col("row").alias(row), F.col("freq").alias(f))
    return r.join(name("first_row", "low"), ["segment", "first_row"]).join(name("last_row", "high"), ["segment", "last_row"]).select("segment", "low", "high", "start_t", "end_t")


def keep_larger(found: DataFrame, overlap: float = 0.5, gap: float = 2.0) -> DataFrame:
    """Of episodes of near mean frequency that contain each other or overlap by a share of either, the longer stays (then the earlier, then the lower)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(d=pdf.end_t - pdf.start_t).sort_values(["d", "start_t", "low"], ascending=[False, True, True])
        kept: list = []
        for r in pdf.itertuples():
            mid = (r.low + r.high) / 2
            clash = False
            for k in kept:
                both = min(r.end_t, k.end_t) - max(r.start_t, k.start_t)
                if both > 0 and abs(mid - (k.low + k.high) / 2) < gap and (both >= min(r.d, k.d) or both > overlap * min(r.d, k.d)):
                    clash = True
                    break
            if not clash:
                kept.append(r)
        return pdf.loc[[k.Index for k in kept]].drop(columns="d")

    return found.groupBy("segment").applyInPandas(run, found.schema)


def spikes(power: DataFrame, limits: DataFrame, rate: float, share: float = 0.7, ratio: float = 1.2) -> DataFrame:
    """(segment, t): moments at which more than a share of frequencies exceeds the threshold within a hundredth of a second.

    Time is stepped through by 1/500 s; after a spike 1/5 s is skipped.
    """
    kind = power.schema["segment"].dataType.simpleString()
    n = power.groupBy("segment").agg(F.count_distinct("freq").alias("n_freqs"), (F.max("t") + 1).alias("n_t"))
    near = max(1, int(rate / 100))
    over = power.join(limits, "segment").where(F.col("power") > F.col("threshold") * ratio).select("segment", "freq", F.explode(F.sequence(F.greatest(F.lit(0), F.col("t") - near + 1), F.col("t"))).alias("t")).distinct()
    hot = over.groupBy("segment", "t").agg(F.count("*").alias("k")).join(n, "segment").where(F.col("k") > share * F.col("n_freqs"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(int(pdf.n_t.iloc[0]), bool)
        on[pdf.t.to_numpy()] = True
        out, t = [], 0
        while t < len(on):
            if on[t]:
                out.append(t)
            t += max(1, int(rate / 5)) if on[t] else max(1, int(rate / 500))
        return pd.DataFrame({"segment": pdf.segment.iloc[0], "t": out})

    return hot.select("segment", "t", "n_t").groupBy("segment").applyInPandas(run, f"segment {kind}, t int")


def analyse(signal: DataFrame, rate: float, seconds: float, options: WaveletOptions | None = None) -> dict[str, DataFrame]:
    """All tables of an analysis of ``(sample, value)``: power, spectrum, spikes, episodes by band and by background fit."""
    options = options or WaveletOptions()
    raw = morlet_power(segments(signal, rate, seconds), rate, options)
    power = normalise(raw, baseline_of(raw) if options.baseline else None, options.baseline)
    limits = power_threshold(power, options.median_threshold)
    back = thresholds(background_fit(raw), rate, options.percentile, options.n_cycles)
    out = {"power": power, "spectrum": power_spectrum(power), "spikes": spikes(power, limits, rate, options.spike_share, options.spike_ratio), "oscillations": episodes(raw, back)}
    for b in options.bands_in_range():
        out[f"episodes_{b.name}"] = band_episodes(power, limits, b, rate)
    return out


def frequency_correlation(power: DataFrame) -> DataFrame:
    """(segment, a, b, r): Pearson correlation of the power of two frequencies over time."""
    a, b = (power.select("segment", "t", F.col("freq").alias(k), F.col("power").alias(f"p{k}")) for k in "ab")
    return a.join(b, ["segment", "t"]).where("a <= b").groupBy("segment", "a", "b").agg(F.corr("pa", "pb").alias("r"))
