"""Sequences by graph paths and by constant slopes."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.sequences import _times, spike_lists
from pulsegrid.operators.transitions import significant_transitions, tied_chains, top_followers, transitions
from pulsegrid.sources.durable import durable


def longest_chain(rows: list[np.ndarray], start: int, low: int, high: int, budget: int, in_row: int) -> list[int]:
    """From a spike of row 0, times in the following rows (-1 for a miss) with most spikes.

    All spikes of the next row within ``[last + low, last + high)`` are tried; a miss widens
    the window by a fifth; ``budget`` misses in all, ``in_row`` together.
    """
    best: list[int] = [start]
    score = 1
    stack = [([start], start, 0, 0, float(high))]
    seen: dict[tuple, int] = {}
    while stack:
        times, last, missed, row, wide = stack.pop()
        n = sum(t >= 0 for t in times)
        if n > score:
            best, score = times, n
        j = len(times)
        if j == len(rows):
            continue
        state = (j, last, missed, row)
        if seen.get(state, -1) >= n:
            continue
        seen[state] = n
        if missed < budget and row < in_row:
            stack.append(([*times, -1], last, missed + 1, row + 1, wide * 1.2))
        r = rows[j]
        for t in r[np.searchsorted(r, last + low) : np.searchsorted(r, last + wide)][::-1]:
            stack.append(([*times, int(t)], int(t), missed, 0, float(high)))
    while best[-1] == -1:
        best.pop()
    return best


def repetitions(rows: list[np.ndarray], low: int, high: int, error_rate: float, in_row: int = 2, min_ratio: float = 0.4) -> list[list[int]]:
    """Repetitions of a fixed order of rows; the spikes of one are not used again."""
    least = max(min(2 if len(rows) < 5 else 3, len(rows)), int(np.ceil(min_ratio * len(rows))))
    left = [r.copy() for r in rows]
    budget, out = int(len(rows) * error_rate), []
    for first in range(budget + 1):
        if first >= len(rows):
            break
        for t in list(left[first]):
            if t not in left[first]:
                continue
            chain = longest_chain(left[first:], int(t), low, high, budget - first, in_row)
            if sum(x >= 0 for x in chain) < least:
                continue
            out.append([-1] * first + chain + [-1] * (len(rows) - first - len(chain)))
            for k, x in enumerate(chain):
                if x >= 0:
                    left[first + k] = left[first + k][left[first + k] != x]
    return out


def slope_ranges(first: int, last: int, t: int, slope: float, n_frames: int, around: int) -> list[tuple[int, int]] | None:
    """Expected frames ``[lo, hi)`` of rows first + 1 .. last; none where one leaves the recording."""
    out = []
    for c in range(first + 1, last + 1):
        mid = int(round(t + slope * (c - first)))
        if mid - around < 0 or mid + around > n_frames:
            return None
        out.append((mid - around, mid + around))
    return out


def slope_waves(rows: list[np.ndarray], n_frames: int, slopes: Iterable[float], around: int, error_rate: float) -> list[tuple[float, list[int]]]:
    """(slope, times) of waves that pass the rows at a constant slope; spikes are claimed in order of slope, start and time."""
    n = len(rows)
    budget = int(n * error_rate)
    left = [set(r.tolist()) for r in rows]
    out = []
    for slope in slopes:
        for first in range(budget + 1):
            if first >= n:
                break
            for t in sorted(left[first]):
                spans = slope_ranges(first, n - 1, t, slope, n_frames, around)
                if spans is None or t not in left[first]:
                    continue
                times = [-1] * first + [t]
                for c, (lo, hi) in enumerate(spans, first + 1):
                    times.append(next((x for x in range(lo, hi) if x in left[c]), -1))
                if times.count(-1) <= budget and n - times.count(-1) >= 2:
                    out.append((float(slope), times))
                    for c, x in enumerate(times):
                        left[c].discard(x)
    return out


def find_waves(spikes: DataFrame, recordings: DataFrame, orders: DataFrame, slopes: list[float], around: int = 2, error_rate: float = 0.3) -> DataFrame:
    """(recording_id, path_id, slope, times) for ``orders(recording_id, path_id, cells)``; each order is a task's work."""
    places = orders.select("recording_id", "path_id", F.posexplode("cells").alias("place", "cell"))
    lists = spikes.groupBy("recording_id", "cell").agg(F.sort_array(F.collect_list("frame")).alias("times"))
    rows = places.join(lists, ["recording_id", "cell"], "left").join(recordings.select("recording_id", "n_frames"), "recording_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        found = slope_waves([np.array([] if t is None else t, int) for t in pdf.times], int(pdf.n_frames.iloc[0]), slopes, around, error_rate)
        return pd.DataFrame({"recording_id": pdf.recording_id.iloc[0], "path_id": pdf.path_id.iloc[0], "slope": [s for s, _ in found], "times": [t for _, t in found]})

    return rows.groupBy("recording_id", "path_id").applyInPandas(run, "recording_id string, path_id int, slope double, times array<int>")


def follower_graph(edges: DataFrame, k: int, min_weight: float | None = None, second: DataFrame | None = None, chain_ties: bool = True) -> DataFrame:
    """(recording_id, src, dst, weight): the best followers, ties for the best chained in lag order instead."""
    best = top_followers(edges, k, min_weight, second).select("recording_id", "src", "dst", "weight")
    if not chain_ties:
        return best
    ties = tied_chains(edges if min_weight is None else edges.where(F.col("weight") >= min_weight)).select("recording_id", "src", "dst", "weight")
    w = edges.groupBy("recording_id", "src").agg(F.max("weight").alias("m"))
    tied = edges.join(w, ["recording_id", "src"]).where("weight = m").groupBy("recording_id", "src").count().where("count > 1").select("recording_id", "src")
    return best.join(tied, ["recording_id", "src"], "left_anti").unionByName(ties).distinct()


def longest_paths(edges: list[tuple[int, int, float]], weighted: bool = True) -> list[list[int]]:
    """Repeatedly the longest of all shortest paths (of equal length the one of least weight, then the lowest cells), its cells removed, until none is left."""
    out, left = [], {(a, b): w for a, b, w in edges if a != b}
    while left:
        nxt: dict[int, list[tuple[int, float]]] = {}
        for (a, b), w in left.items():
            nxt.setdefault(a, []).append((b, w))
        best: tuple | None = None
        for s in sorted(nxt):
            paths, front = {s: (0.0, [s])}, [s]
            while front:  # level by level: fewest steps, then least weight
                level: dict[int, tuple[float, list[int]]] = {}
                for a in front:
                    cost, p = paths[a]
                    for b, w in nxt.get(a, ()):
                        if b not in paths:
                            cand = (cost + (w if weighted else 0.0), [*p, b])
                            if b not in level or cand < level[b]:
                                level[b] = cand
                paths |= level
                front = sorted(level)
            for cost, p in paths.values():
                key = (-len(p), cost, p)
                if len(p) > 1 and (best is None or key < best):
                    best = key
        if best is None:
            break
        out.append(best[2])
        gone = set(best[2])
        left = {(a, b): w for (a, b), w in left.items() if a not in gone and b not in gone}
    return out


def graph_paths(graph: DataFrame, weighted: bool = True) -> DataFrame:
    """(recording_id, path_id, cells) of each recording's follower graph (``k`` edges a cell, so it fits a task)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = longest_paths(list(zip(pdf.src, pdf.dst, pdf.weight, strict=True)), weighted)
        return pd.DataFrame({"recording_id": pdf.recording_id.iloc[0], "path_id": range(len(p)), "cells": p})

    return graph.groupBy("recording_id").applyInPandas(run, "recording_id string, path_id int, cells array<int>")


def join_paths(paths: list[list[int]], weight: dict[tuple[int, int], float]) -> list[int]:
    """One order of all paths: a graph of paths from last two to first two cells, its longest paths laid end to end."""
    edges = []
    for i, p in enumerate(paths):
        for j, q in enumerate(paths):
            w = sum(weight.get((a, b), 0.0) for a in p[-2:] for b in q[:2]) if i != j else 0.0
            if w > 0:
                edges.append((i, j, -w))
    order = [i for chain in longest_paths(edges) for i in chain]
    order += [i for i in sorted(range(len(paths)), key=lambda i: (-len(paths[i]), i)) if i not in set(order)]
    return [c for i in order for c in paths[i]]


def find_graph_sequences(spikes: DataFrame, recordings: DataFrame, low: int, high: int, n_surrogates: int, k: int = 2, slopes: tuple[float, ...] = (0.0, 1.0, 2.0), error_rate: float = 0.3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(paths, waves): significant transitions, follower graph with second-order tie-break, paths, waves along each path."""
    edges = significant_transitions(spikes, recordings, low, high, n_surrogates, seed=seed)
    second = transitions(spikes, recordings, low, 2 * high)
    paths = durable(graph_paths(follower_graph(edges, k, second=second)))
    return paths, find_waves(spikes, recordings, paths, list(slopes), error_rate=error_rate)


def order_repetitions(spikes: DataFrame, orders: DataFrame, low: int, high: int, error_rate: float = 0.3) -> DataFrame:
    """(recording_id, times) of the repetitions of one order per recording."""
    r = spike_lists(spikes).join(orders.select("recording_id", "cells"), "recording_id")

    def run(batches: Iterable[pd.DataFrame]):
        for pdf in batches:
            out = []
            for x in pdf.itertuples():
                times = _times(x.raster)
                out += [(x.recording_id, t) for t in repetitions([times.get(int(c), np.zeros(0, int)) for c in x.cells], low, high, error_rate)]
            yield pd.DataFrame(out, columns=["recording_id", "times"])

    return r.mapInPandas(run, "recording_id string, times array<int>")
