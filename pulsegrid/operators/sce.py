"""Synchronous network events: thresholds from surrogates, detectors, statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.operators import kernels as K
from pulsegrid.operators.distributions import sparse_percentile
from pulsegrid.operators.raster import activity_sum, busy_windows, islands, window_activity
from pulsegrid.operators.surrogates import rolled


def surrogate_activity(spikes: DataFrame, recordings: DataFrame, window: int, n_surrogates: int, seed: int = 0, distinct: bool = False) -> DataFrame:
    """(recording_id, surr, frame, n): windowed activity of rolled surrogates, silent windows included.

    The threshold counts spikes, the detector distinct cells; ``distinct`` makes both alike.
    """
    return window_activity(rolled(spikes, recordings, n_surrogates, seed), recordings, window, distinct, by=["surr"])


def _threshold(spikes: DataFrame, recordings: DataFrame, window: int, n_surrogates: int, percentile: float, distinct: bool, extreme: str | None = None) -> DataFrame:
    """A percentile of the activity of surrogate windows, or of each surrogate's largest or smallest.

    ``spikes(recording_id, surr, cell, frame)``. Silent windows are counted, not stored: what
    is left of all windows takes part as that many zeros.
    """
    last = F.col("n_frames") - (0 if window == 1 else window)
    rec = recordings.select("recording_id", last.cast("long").alias("windows")).where("windows > 0")
    held = busy_windows(spikes, window, distinct, ["surr"]).join(rec, "recording_id").where("t < windows")
    if extreme is None:
        counts = held.groupBy("recording_id", "n").agg(F.count("*").alias("times"))
        totals = rec.select("recording_id", (F.col("windows") * n_surrogates).alias("total"))
    else:
        per = held.groupBy("recording_id", "surr").agg(F.max("n").alias("most"), F.min("n").alias("least"), F.count("*").alias("busy"), F.first("windows").alias("windows"))
        n = F.col("most") if extreme == "max" else F.when(F.col("busy") < F.col("windows"), 0).otherwise(F.col("least"))
        counts = per.select("recording_id", n.cast("long").alias("n")).where("n > 0").groupBy("recording_id", "n").agg(F.count("*").alias("times"))
        totals = rec.select("recording_id", F.lit(n_surrogates).cast("long").alias("total"))
    # a recording without any spike has no surrogates
    totals = totals.join(spikes.select("recording_id").distinct(), "recording_id", "left_semi")
    return sparse_percentile(counts, "n", "times", totals, ["recording_id"], percentile)


def detection_threshold(spikes: DataFrame, recordings: DataFrame, window: int = 1, n_surrogates: int = 100, percentile: float = 95, use_max: bool = False, seed: int = 0, distinct: bool = False) -> DataFrame:
    """(recording_id, threshold): exact percentile of surrogate activity, or of each surrogate's largest."""
    return _threshold(rolled(spikes, recordings, n_surrogates, seed), recordings, window, n_surrogates, percentile, distinct, "max" if use_max else None)


def low_activity_threshold(spikes: DataFrame, recordings: DataFrame, window: int = 1, n_surrogates: int = 100, percentile: float = 5, use_min: bool = False, seed: int = 0) -> DataFrame:
    """The mirror: a low percentile, or that of each surrogate's smallest activity."""
    return _threshold(rolled(spikes, recordings, n_surrogates, seed), recordings, window, n_surrogates, percentile, False, "min" if use_min else None)


def train_threshold(trains: DataFrame, window: float, n_surrogates: int = 100, percentile: float = 95, shift: int = 20, lo: float = 0, hi: float = 1000, seed: int = 0, low: bool = False, extreme: bool = False) -> DataFrame:
    """Threshold on shifted spike trains: distinct cells in the whole-number windows [s, s + window)."""
    from pulsegrid.operators.surrogates import surrogate_trains

    s = surrogate_trains(trains, n_surrogates, "shift", shift, lo, hi, seed)
    spikes = s.select("recording_id", "surr", "cell", F.floor(F.col("t") - lo).cast("int").alias("frame")).distinct()
    rec = trains.select("recording_id").distinct().withColumn("n_frames", F.lit(int(hi - lo)))
    return _threshold(spikes, rec, int(window), n_surrogates, percentile, True, ("min" if low else "max") if extreme else None)


def run_raster_threshold(run_frames: DataFrame, recordings: DataFrame, n_surrogates: int = 1000, percentile: float = 95, seed: int = 0) -> DataFrame:
    """The same threshold on a run-filled raster (frames of whole transients), window 1."""
    return detection_threshold(run_frames, recordings, 1, n_surrogates, percentile, seed=seed)


def detect(spikes: DataFrame, recordings: DataFrame, window: int, thresholds: DataFrame, only_peak: bool = False, keep_open: bool = True, distinct: bool = True) -> DataFrame:
    """(recording_id, sce_id, start_frame, end_frame, peak): windows at or over the threshold.

    A window counts its cells, or without ``distinct`` the sum of its spikes. An event of windows s .. e spans frames s .. e + window - 1. ``only_peak`` reduces it to
    the first frame of largest activity; ``keep_open`` keeps an event open at the last window.
    """
    a = activity_sum(spikes, recordings).withColumnRenamed("n_cells_active", "n") if window == 1 and distinct else window_activity(spikes, recordings, window, distinct)
    over = a.join(F.broadcast(thresholds), "recording_id").where("n >= threshold")  # one row a recording
    runs = islands(over, ["recording_id"])
    if not keep_open:
        last = recordings.select("recording_id", (F.col("n_frames") - 1 - (window if window > 1 else 0)).alias("last"))
        runs = runs.join(last, "recording_id").where("end_frame < last").drop("last")
    inside = _within(over, runs)
    peaks = inside.groupBy("recording_id", "run_id").agg(F.max(F.struct("n", (-F.col("frame")).alias("f"))).alias("p"))
    out = runs.join(peaks, ["recording_id", "run_id"])
    at = -F.col("p.f")
    return out.select(
        "recording_id",
        F.col("run_id").alias("sce_id"),
        (at if only_peak else F.col("start_frame")).cast("int").alias("start_frame"),
        (at if only_peak else F.col("end_frame") + window - 1).cast("int").alias("end_frame"),
        F.col("p.n").alias("peak"),
    )


def _within(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of the frames of runs, by an equi-join."""
    each = runs.select("recording_id", "run_id", F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))
    return rows.join(each, ["recording_id", "frame"])


def detect_no_redundancy(spikes: DataFrame, recordings: DataFrame, window: int, thresholds: DataFrame) -> DataFrame:
    """Like ``detect``, but a cell counts towards the open event only once: windows continue it while cells not seen in it before its last window reach the threshold."""
    # a cell of a window counts if it spikes in the last frame, or if its last spike before the
    # window lies ahead of the event: cells are counted by that spike's frame, and the counts scanned
    held = spikes.where("cell is not null and frame >= 0").select("recording_id", "cell", "frame").distinct()
    order = W.partitionBy("recording_id", "cell").orderBy("frame")
    seen = held.withColumn("prev", F.coalesce(F.lag("frame").over(order), F.lit(-1)))
    for k in range(1, window):
        seen = seen.withColumn(f"next{k}", F.lead("frame", k).over(order))
    starts = F.sequence(F.greatest(F.lit(0), F.col("prev") + 1, F.col("frame") - window + 1), F.col("frame"))
    each = seen.withColumn("t", F.explode(starts))
    newest = F.coalesce(F.col("t") + window - 1 == F.col("frame"), F.lit(False))
    for k in range(1, window):
        newest = newest | F.coalesce(F.col("t") + window - 1 == F.col(f"next{k}"), F.lit(False))
    counts = each.select("recording_id", "t", F.when(newest, -1).otherwise(F.col("prev")).alias("prev")).groupBy("recording_id", "t", "prev").agg(F.count("*").alias("n"))
    rec = recordings.join(thresholds, "recording_id").select("recording_id", "n_frames", "threshold")
    rows = spikes.select("recording_id").distinct().join(F.broadcast(rec), "recording_id").join(counts, "recording_id", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, thr = int(pdf.n_frames.iloc[0]), float(pdf.threshold.iloc[0])
        at = {int(t): (g.prev.to_numpy(), g.n.to_numpy()) for t, g in pdf.dropna(subset=["t"]).groupby("t")}
        out, start = [], None
        for t in range(max(n - window, 1)):
            prev, many = at.get(t, (np.zeros(0), np.zeros(0)))
            count = int(many.sum() if start is None else many[prev < start].sum())
            if count >= thr:
                start = t if start is None else start
            elif start is not None:
                out.append((start, t + window - 2))
                start = None
        if start is not None:
            out.append((start, n - 2 if window > 1 else n - 1))
        return pd.DataFrame({"recording_id": pdf.recording_id.iloc[0], "sce_id": range(len(out)), "start_frame": [a for a, _ in out], "end_frame": [b for _, b in out]})

    return rows.groupBy("recording_id").applyInPandas(run, "recording_id string, sce_id int, start_frame int, end_frame int")


def sce_frames(sce: DataFrame) -> DataFrame:
    """The event of every frame inside one."""
    return sce.select("recording_id", "sce_id", F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))


def sce_cells(spikes: DataFrame, sce: DataFrame) -> DataFrame:
    """(recording_id, sce_id, cell): the cells active in each event."""
    return sce_frames(sce).join(spikes, ["recording_id", "frame"]).select("recording_id", "sce_id", "cell").distinct()


def sce_mask(sce: DataFrame, recordings: DataFrame) -> DataFrame:
    """(recording_id, frame, sce_id): the event of every frame, -1 outside."""
    from pulsegrid.operators.raster import frames

    return frames(recordings).join(sce_frames(sce), ["recording_id", "frame"], "left").select("recording_id", "frame", F.coalesce("sce_id", F.lit(-1)).alias("sce_id"))


def sce_statistics(spikes: DataFrame, sce: DataFrame, window: int) -> DataFrame:
    """Duration, largest and mean distinct cells over the event's windows, and all its cells; an event shorter than the window is one window."""
    key = ["recording_id", "sce_id"]
    span = sce.withColumn("w", F.least(F.lit(window), F.col("end_frame") - F.col("start_frame") + 1))
    inside = span.select(*key, "w", "start_frame", "end_frame", F.explode(F.sequence("start_frame", "end_frame")).alias("frame")).join(spikes, ["recording_id", "frame"])
    lo, hi = F.greatest(F.col("start_frame"), F.col("frame") - F.col("w") + 1), F.least(F.col("frame"), F.col("end_frame") - F.col("w") + 1)
    n = inside.where(lo <= hi).select(*key, "cell", F.explode(F.sequence(lo, hi)).alias("t")).distinct().groupBy(*key, "t").agg(F.count("*").alias("n"))
    spine = span.select(*key, F.explode(F.sequence(F.col("start_frame"), F.col("end_frame") - F.col("w") + 1)).alias("t"))
    per = spine.join(n, [*key, "t"], "left").groupBy(*key).agg(F.max(F.coalesce("n", F.lit(0))).alias("max_cells"), F.avg(F.coalesce("n", F.lit(0))).alias("mean_cells"))
    cells = inside.groupBy(*key).agg(F.count_distinct("cell").alias("n_cells"))
    out = sce.select(*key, (F.col("end_frame") - F.col("start_frame") + 1).alias("duration")).join(per, key).join(cells, key, "left")
    return out.withColumn("n_cells", F.coalesce("n_cells", F.lit(0)))


def detect_peaks(spikes: DataFrame, recordings: DataFrame) -> DataFrame:
    """Peak-based events: smoothed activity, forward mean of 100 frames, peaks 100 frames apart over the mean."""
    a = activity_sum(spikes, recordings)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = pdf.sort_values("frame").n_cells_active.to_numpy(float)
        events = K.peak_events(raw)
        return pd.DataFrame({"recording_id": pdf.recording_id.iloc[0], "sce_id": range(len(events)), "start_frame": [e[0] for e in events], "end_frame": [e[1] for e in events], "peak_frame": [e[2] for e in events]})

    return a.groupBy("recording_id").applyInPandas(run, "recording_id string, sce_id int, start_frame int, end_frame int, peak_frame int")


def trace_transients(traces: DataFrame, half: int = 40, factor: float = 3.0, refractory: int = 10, speed: DataFrame | None = None, speed_threshold: float | None = None, step: int = 5) -> DataFrame:
    """(recording_id, cell, frame): frames whose value stands out of the running median by ``factor`` interquartile ranges.

    A frame is judged if its whole window, ``half`` frames before it and ``half - 1`` after,
    lies inside the trace: from frame ``half + 1`` on every ``step``-th one (with ``speed``, all
    of low speed). The running median must lie near the trace's own, and no transient may
    have come in the last ``refractory`` frames.
    """
    from pyspark.sql import Window as W

    key = ["recording_id", "cell"]
    around = W.partitionBy(*key).orderBy("frame").rowsBetween(-half, half - 1)
    q = lambda p, w=None: F.percentile("value", F.lit(p)).over(w) if w is not None else F.percentile("value", F.lit(p))
    own = traces.groupBy(*key).agg(q(0.5).alias("m_all"), (q(0.75) - q(0.25)).alias("iqr_all"), F.max("frame").alias("last"))
    local = traces.withColumn("m", q(0.5, around)).withColumn("iqr", q(0.75, around) - q(0.25, around)).join(own, key)
    whole = F.col("frame").between(half + 1, F.col("last") - half)
    hit = local.where(whole).where("value - m > %r * iqr and m < m_all + iqr_all / 2" % factor)
    if speed is not None:
        slow = speed.where(F.col("speed") < F.lit(speed_threshold if speed_threshold is not None else 1.0)).select("recording_id", "frame")
        hit = hit.join(slow, ["recording_id", "frame"])
    else:
        hit = hit.where((F.col("frame") - half - 1) % step == 0)

    def spaced(pdf: pd.DataFrame) -> pd.DataFrame:
        keep, frames = [], np.sort(pdf.frame.to_numpy())
        taken: list[int] = []
        for f in frames:
            if not any(f - refractory <= t <= f - 2 for t in taken[-refractory:]):
                taken.append(int(f))
                keep.append(int(f))
        return pd.DataFrame({"recording_id": pdf.recording_id.iloc[0], "cell": pdf.cell.iloc[0], "frame": keep})

    return hit.select(*key, "frame").groupBy(*key).applyInPandas(spaced, "recording_id string, cell int, frame int")


def detect_on_traces(traces: DataFrame, recordings: DataFrame, n_cells: int = 5, distance: int = 4, **options) -> DataFrame:
    """(recording_id, sce_id, frame, cell): peaks of the number of cells with a transient, and the cells within one frame."""
    t = trace_transients(traces, **options)
    a = activity_sum(t, recordings)

    def peaks(pdf: pd.DataFrame) -> pd.DataFrame:
        p = K.find_peaks(pdf.sort_values("frame").n_cells_active.to_numpy(float), distance, n_cells)
        return pd.DataFrame({"recording_id": pdf.recording_id.iloc[0], "sce_id": range(len(p)), "peak": p})

    p = a.groupBy("recording_id").applyInPandas(peaks, "recording_id string, sce_id int, peak int")
    near = p.select("recording_id", "sce_id", "peak", F.explode(F.sequence(F.col("peak") - 1, F.col("peak") + 1)).alias("frame"))
    return near.join(t, ["recording_id", "frame"]).select("recording_id", "sce_id", F.col("peak").alias("frame"), "cell").distinct()
