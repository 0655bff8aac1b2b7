"""Surrogate data sets: rolls, shifts, dithers and jitters, all seeded.

Roll offsets come from integer arithmetic on (seed, surrogate, cell), so they do not
depend on partitioning and any SQL engine can repeat them. Random draws come from a
hash of (seed, surrogate, cell, row), for the same reason.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def roll_offset(n_frames: Column, seed: int, surr: str | Column = "surr", cell: str = "cell") -> Column:
    """1 .. n_frames - 1 (0 where there is one frame)."""
    s, c = (F.col(surr) if isinstance(surr, str) else surr).cast("long"), F.col(cell).cast("long")
    mixed = F.lit(seed).cast("long") * 1000003 + s * 7919 + c * 104729 + s * c * 31 + c * c * 17
    return F.when(n_frames > 1, F.pmod(mixed, n_frames - 1) + 1).otherwise(0).cast("int")


def with_surrogates(rows: DataFrame, n: int) -> DataFrame:
    """``n`` numbered copies of the rows (``n`` is a parameter, not data)."""
    return rows.withColumn("surr", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def rolled(spikes: DataFrame, recordings: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` surrogates in which each cell is rolled by an offset of its own."""
    s = with_surrogates(spikes.join(recordings, "recording_id"), n)
    k = roll_offset(F.col("n_frames"), seed)
    return s.select("recording_id", "surr", "cell", F.pmod(F.col("frame") + k, F.col("n_frames")).cast("int").alias("frame"))


def uniform(seed: int, *cols: str | Column) -> Column:
    """A number in [0, 1) drawn by a hash of the columns, one that any SQL engine has."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def normal(seed: int, *cols: str) -> Column:
    """A standard normal number drawn by a hash of the columns."""
    u, v = F.greatest(uniform(seed, *cols), F.lit(1e-16)), uniform(seed + 1_000_003, *cols)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * v)


def _surr(rows: DataFrame, extra: tuple[str, ...] = ()) -> list[str]:
    return ["recording_id", *(["surr"] if "surr" in rows.columns else []), "cell", *extra]


def shifted(trains: DataFrame, shift: int = 20, lo: float = 0, hi: float = 1000, seed: int = 0) -> DataFrame:
    """Each train moved round the range by one offset in [-shift, shift]."""
    key = _surr(trains)
    off = F.floor(uniform(seed, *key) * (2 * shift + 1)) - shift
    return trains.withColumn("t", F.pmod(F.col("t") + off - lo, F.lit(hi - lo)) + lo)


def dithered_fast(trains: DataFrame, dither: int = 20, lo: float = 0, hi: float = 1000, seed: int = 0) -> DataFrame:
    """Each spike moved by up to ``dither``, clipped to [lo, hi); collisions merge."""
    off = F.floor(uniform(seed, *_surr(trains, ("t",))) * (2 * dither + 1)) - dither
    return trains.withColumn("t", F.greatest(F.lit(lo), F.least(F.lit(hi - 1), F.col("t") + off))).distinct()


def randomized(trains: DataFrame, lo: int = 0, hi: int = 1000, seed: int = 0) -> DataFrame:
    """Each train replaced by as many distinct whole-number times of the range, those of smallest draw."""
    key = _surr(trains)
    n = trains.groupBy(*key).agg(F.count("*").alias("__n"))
    every = n.withColumn("__at", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))))
    place = F.row_number().over(W.partitionBy(*key).orderBy(uniform(seed, *key, "__at"), "__at"))
    kept = every.withColumn("__place", place).where("__place <= __n")
    return kept.withColumn("t", F.col("__at").cast(trains.schema["t"].dataType)).select(*[c for c in trains.columns if c in (*key, "t")])


def _rng(pdf: pd.DataFrame, key: list[str], seed: int) -> np.random.Generator:
    return np.random.default_rng([seed, *(int.from_bytes(str(pdf[k].iloc[0]).encode(), "little") % (1 << 63) for k in key)])


def dithered(trains: DataFrame, dither: int = 20, lo: int = 0, hi: int = 1000, seed: int = 0) -> DataFrame:
    """Dither in which a collision draws again among the free bins of the spike's window, and goes only if none is free."""
    key = _surr(trains)

    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        rng, taken = _rng(pdf, key, seed), set()
        for t in np.sort(pdf.t.to_numpy()):
            a, b = max(lo, int(t) - dither), min(hi - 1, int(t) + dither)
            x = int(rng.integers(a, b + 1)) if b >= a else None
            if x is None or x in taken:
                free = [y for y in range(a, b + 1) if y not in taken]
                if not free:
                    continue
                x = int(rng.choice(free))
            taken.add(x)
        out = pdf.head(len(taken)).copy()
        return out.assign(t=np.array(sorted(taken)).astype(pdf.t.dtype))

    return trains.groupBy(*key).applyInPandas(move, trains.schema)


def isi_dithered(trains: DataFrame, cdfs: list[list[float]], isid: int = 20, lo: int = 0, hi: int = 1000, seed: int = 0) -> DataFrame:
    """Dither of each spike between its neighbours by the distribution for the sum of both intervals.

    ``cdfs[k]`` is the cumulative distribution of the first of two intervals that sum to
    k (a parameter table); sums outside it are drawn evenly. Up to 2 * isid draws avoid
    a taken bin.
    """
    key = _surr(trains)

    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        rng, t = _rng(pdf, key, seed), np.sort(pdf.t.to_numpy()).astype(int)
        out: set[int] = set()
        for i, x in enumerate(t):
            a = int(t[i - 1]) if i else lo - 1
            b = int(t[i + 1]) if i + 1 < len(t) else hi
            for _ in range(2 * isid + 1):
                total = b - a
                if 0 < total < len(cdfs) and len(cdfs[total]):
                    y = a + int(np.searchsorted(cdfs[total], rng.random(), "left"))
                else:
                    y = int(rng.integers(x - isid, x + isid + 1))
                y = min(max(y, max(lo, x - isid)), min(hi - 1, x + isid))
                if y not in out:
                    out.add(y)
                    break
        return pdf.head(len(out)).copy().assign(t=np.array(sorted(out)).astype(pdf.t.dtype))

    return trains.groupBy(*key).applyInPandas(move, trains.schema)


def gaussian_jitter(trains: DataFrame, sigma: float, seed: int = 0) -> DataFrame:
    """Normal noise on every spike time."""
    return trains.withColumn("t", F.col("t") + sigma * normal(seed, *_surr(trains, ("t",))))


def uniform_jitter(trains: DataFrame, jitter_range: float, seed: int = 0) -> DataFrame:
    """Adds the n even quantiles of [-r, r] to a train's n spikes, in shuffled order."""
    key = _surr(trains)
    w = W.partitionBy(*key)
    place = F.row_number().over(w.orderBy(uniform(seed, *key, "t"), "t")) - 1
    n = F.count("*").over(w)
    step = F.when(n > 1, 2 * jitter_range * place / (n - 1)).otherwise(0.0)
    return trains.withColumn("t", F.col("t") - jitter_range + step)


def surrogate_trains(trains: DataFrame, n: int, kind: str = "shift", amount: float = 20, lo: float = 0, hi: float = 1000, seed: int = 0) -> DataFrame:
    """``n`` surrogate data sets by shift, normal or uniform jitter."""
    s = with_surrogates(trains, n)
    if kind == "shift":
        return shifted(s, int(amount), lo, hi, seed)
    return gaussian_jitter(s, amount, seed) if kind == "normal" else uniform_jitter(s, amount, seed)
