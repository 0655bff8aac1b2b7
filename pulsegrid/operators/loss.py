"""How well an order of cells agrees with firing in sequence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEXT = 3


def order_loss(rows: list[np.ndarray], n_frames: int, low: int, high: int, compat: bool = False) -> float:
    """Loss of spike-time rows (last row fires first), 0 for perfect chains, about 1 at worst.

    Each spike of a row is followed through its ``NEXT`` rows to the first spike there, in
    a window of ``NEXT`` times the span ``high - low``. A row costs the deviation of its
    lags, at most the span, and the span for each spike not used. ``compat`` looks for each
    next spike from the last lag alone and not from the place reached.
    """
    m = len(rows)
    if m <= NEXT:
        raise ValueError(f"more than {NEXT} cells are needed")
    span = high - low
    weight = np.full(m, 2 * NEXT)
    for i in range(NEXT):
        weight[i] = weight[m - 1 - i] = i + 1
    worst = span * sum(int(w) * len(r) for w, r in zip(weight, rows, strict=True))
    if worst <= 0:
        return 0.0
    back, loss = rows[::-1], 0.0
    for i in range(m - NEXT):
        lags: list[list[int]] = [[] for _ in range(NEXT)]
        for t in back[i]:
            start = max(0, t + low)
            stop = min(start + span * NEXT, n_frames)
            own = back[i][(back[i] >= start) & (back[i] < stop)]
            zero = own[0] if len(own) else start
            reach = start
            for j in range(NEXT):
                r = back[i + 1 + j]
                at = np.searchsorted(r, reach)
                if at < len(r) and r[at] < stop:
                    lags[j].append(int(r[at] - zero))
                    step = int(r[at] - reach)
                    reach = max(start, start + step + low) if compat else max(start, int(r[at]) + low)
        for j in range(NEXT):
            if lags[j]:
                loss += min(float(np.std(lags[j])), span)
            loss += span * max(0, len(back[i + 1 + j]) - len(lags[j]))
    return loss / worst


def score_orders(spikes: DataFrame, recordings: DataFrame, orders: DataFrame, low: int, high: int, compat: bool = False) -> DataFrame:
    """(recording_id, order_id, loss) of ``orders(recording_id, order_id, cells ARRAY)``, all candidates at once; null for recordings of ``NEXT`` cells or fewer."""
    places = orders.select("recording_id", "order_id", F.posexplode("cells").alias("place", "cell"))
    lists = spikes.groupBy("recording_id", "cell").agg(F.sort_array(F.collect_list("frame")).alias("times"))
    rows = places.join(lists, ["recording_id", "cell"], "left").join(recordings.select("recording_id", "n_frames"), "recording_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        times = [np.array([] if t is None else t, int) for t in pdf.times]
        value = order_loss(times, int(pdf.n_frames.iloc[0]), low, high, compat) if len(times) > NEXT else None
        return pd.DataFrame({"recording_id": pdf.recording_id.iloc[:1], "order_id": pdf.order_id.iloc[:1], "loss": pd.array([value], "Float64")})

    return rows.groupBy("recording_id", "order_id").applyInPandas(run, "recording_id string, order_id int, loss double")


def best_order(orders: DataFrame, scores: DataFrame) -> DataFrame:
    """The order of least loss, the first of equals."""
    s = orders.join(scores, ["recording_id", "order_id"])
    return s.groupBy("recording_id").agg(F.min(F.struct("loss", "order_id", "cells")).alias("m")).select("recording_id", "m.order_id", "m.loss", "m.cells")
