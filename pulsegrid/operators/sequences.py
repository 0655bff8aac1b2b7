"""Repeating firing sequences: beam search over transitions, replay, ordering, significance."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.operators.surrogates import rolled
from pulsegrid.operators.transitions import transitions
from pulsegrid.sources.durable import durable


@dataclass(frozen=True)
class SequenceOptions:
    """Options of the search; ``low`` and ``high`` bound the lag between neighbours."""

    low: int = 1
    high: int = 3
    min_len: int = 4
    min_reps: int = 2
    branches: int = 3
    max_depth: int = 12
    stop_if_twin: bool = False
    error_rate: float = 0.2
    min_errors: int = 1
    no_reverse: bool = False
    rate_weight: bool = False
    n_std: float = 0.0


def beam_paths(edges: DataFrame, options: SequenceOptions, n_cells: int) -> DataFrame:
    """(recording_id, start, path, cost): per start cell the best paths by summed -log(weight), lower first.

    A level is one join of the frontier with the transitions over a floor (mean and
    ``n_std`` deviations of the full matrix); the ``branches`` best children of a node and
    then the ``branches`` best nodes of a start stay. Ties (costs
    alike to nine digits) go to the lower cell.
    """
    o = options
    total = edges.groupBy("recording_id").agg(F.sum("weight").alias("s"), F.sum(F.col("weight") ** 2).alias("q"))
    size = float(n_cells * n_cells)
    mean = F.col("s") / size
    floor = total.select("recording_id", F.greatest(F.lit(0.0), mean + o.n_std * F.sqrt(F.greatest(F.lit(0.0), F.col("q") / size - mean * mean))).alias("floor"))
    step = edges.join(F.broadcast(floor), "recording_id").where("weight > floor").select("recording_id", F.col("src").alias("at"), "dst", "weight")
    order = F.row_number().over(W.partitionBy("recording_id", "at").orderBy(F.desc("weight"), "dst"))
    if not o.stop_if_twin:  # children on the path are passed over, so as many more may be needed
        step = step.withColumn("r", order).where(F.col("r") <= o.branches + o.max_depth).drop("r")
    front = edges.select("recording_id", F.explode(F.array("src", "dst")).alias("at")).distinct().select("recording_id", F.col("at").alias("start"), F.array("at").alias("path"), F.lit(0.0).alias("cost"), "at")
    done = None
    for _ in range(min(o.max_depth, n_cells) - 1):
        grown = front.join(step, ["recording_id", "at"])
        twin = F.array_contains("path", F.col("dst"))
        if o.stop_if_twin:
            grown = grown.withColumn("r", F.row_number().over(W.partitionBy("recording_id", "path").orderBy(F.desc("weight"), "dst"))).where(F.col("r") <= o.branches)
            first = F.min(F.when(twin, F.col("r"))).over(W.partitionBy("recording_id", "path"))
            grown = grown.withColumn("cut", first).where("cut is null or r < cut").drop("r", "cut")
        else:
            grown = grown.where(~twin)
            grown = grown.withColumn("r", F.row_number().over(W.partitionBy("recording_id", "path").orderBy(F.desc("weight"), "dst"))).where(F.col("r") <= o.branches).drop("r")
        nxt = grown.select("recording_id", "start", F.concat("path", F.array("dst")).alias("path"), (F.col("cost") - F.log("weight")).alias("cost"), F.col("dst").alias("at"))
        best = F.row_number().over(W.partitionBy("recording_id", "start").orderBy(F.round("cost", 9), "path"))
        nxt = durable(nxt.withColumn("r", best).where(F.col("r") <= o.branches).drop("r"))
        if not nxt.take(1):
            break
        parents = nxt.select("recording_id", F.expr("slice(path, 1, size(path) - 1)").alias("path")).distinct()
        ended = front.join(parents, ["recording_id", "path"], "left_anti")
        # a path that ends counts only if no deeper path of its start is left
        done = ended if done is None else done.unionByName(ended)
        front = nxt
    every = front if done is None else done.unionByName(front)
    return every.select("recording_id", "start", "path", "cost")


def replay(path: list[int], times: dict[int, np.ndarray], options: SequenceOptions) -> list[list[int]]:
    """Occurrences of a path, one time per cell and -1 for a miss.

    From each spike of the first cell the earliest spike of the next one is taken within
    the lag; a miss widens the window twofold, two in a row fourfold, a third ends the
    walk; misses at the end are cut; an occurrence that shares over a fifth of its times
    with a kept one is dropped.
    """
    o, kept = options, []
    budget = int(len(path) * o.error_rate) + o.min_errors
    used: set[tuple[int, int]] = set()
    for t in times.get(path[0], ()):
        found, at, missed, row = [int(t)], int(t), 0, 0
        for c in path[1:]:
            r = times.get(c, np.zeros(0, int))
            k = np.searchsorted(r, at + min(o.low, 0) if o.low < 0 else at + o.low)
            if k < len(r) and r[k] < at + o.high * 2**row:
                at, row = int(r[k]), 0
                found.append(at)
                continue
            missed, row = missed + 1, row + 1
            found.append(-1)
            if row > 2 or missed > budget:
                break
        while found and found[-1] == -1:
            found.pop()
        if len(found) < o.min_len:
            continue
        own = {(c, x) for c, x in zip(path, found, strict=False) if x >= 0}
        if len(own & used) <= 0.2 * len(own):
            used |= own
            kept.append(found)
    return kept


def spike_lists(spikes: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row per recording: all cells and their sorted frames (a raster for one task)."""
    per = spikes.groupBy("recording_id", *by, "cell").agg(F.sort_array(F.collect_list("frame")).alias("times"))
    return per.groupBy("recording_id", *by).agg(F.sort_array(F.collect_list(F.struct("cell", "times"))).alias("raster"))


def _times(raster) -> dict[int, np.ndarray]:
    return {int(r["cell"]): np.array(r["times"], int) for r in raster}


def find_sequences(spikes: DataFrame, paths: DataFrame, options: SequenceOptions) -> DataFrame:
    """(recording_id, start, cells, times): the longest prefix of each path that repeats, per start cell."""
    rows = paths.groupBy("recording_id", "start").agg(F.sort_array(F.collect_list(F.struct("cost", "path"))).alias("paths"))
    # only the cells of the paths are needed by a start
    need = paths.select("recording_id", "start", F.explode("path").alias("cell")).distinct()
    lists = spikes.groupBy("recording_id", "cell").agg(F.sort_array(F.collect_list("frame")).alias("times"))
    own = need.join(lists, ["recording_id", "cell"]).groupBy("recording_id", "start").agg(F.collect_list(F.struct("cell", "times")).alias("raster"))

    def run(batches: Iterable[pd.DataFrame]):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                times, seen = _times(r.raster), set()
                for p in r.paths:
                    path = [int(x) for x in p["path"]]
                    by_len: dict[int, list] = {}
                    for occ in replay(path, times, options):
                        by_len.setdefault(len(occ), []).append(occ)
                    for n, occ in by_len.items():
                        cells = tuple(path[:n])
                        if cells not in seen and len(occ) >= options.min_reps:
                            seen.add(cells)
                            out.append((r.recording_id, r.start, list(cells), occ))
            yield pd.DataFrame(out, columns=["recording_id", "start", "cells", "times"])

    return rows.join(own, ["recording_id", "start"]).mapInPandas(run, "recording_id string, start int, cells array<int>, times array<array<int>>")


def without_contained(seqs: DataFrame, options: SequenceOptions) -> DataFrame:
    """Drops sequences that repeat too seldom, and prefixes whose occurrences are those of a longer sequence cut short."""
    s = seqs.where(F.size("times") >= options.min_reps).dropDuplicates(["recording_id", "cells"])
    longer = s.select("recording_id", F.col("cells").alias("c"), F.col("times").alias("t")).where("size(c) > 1")
    cut = longer.select("recording_id", F.explode(F.expr("transform(sequence(1, size(c) - 1), n -> named_struct('cells', slice(c, 1, n), 'times', array_sort(transform(t, x -> slice(x, 1, n)))))")).alias("p"))
    cut = cut.select("recording_id", "p.cells", F.col("p.times").alias("sorted")).distinct()
    return s.withColumn("sorted", F.array_sort("times")).join(cut, ["recording_id", "cells", "sorted"], "left_anti").drop("sorted")


def is_independent(short: list[list[int]], long: list[list[int]]) -> bool:
    """Whether some short occurrence shares no time with, and does not lie within, any long one."""
    spans = [(min(x for x in t if x >= 0), max(t), {x for x in t if x >= 0}) for t in long]
    for t in short:
        own = {x for x in t if x >= 0}
        if own and not any((lo <= min(own) and max(own) <= hi) or own & s for lo, hi, s in spans):
            return True
    return False


def complete_order(start: list[int], known: list[tuple[tuple[int, ...], int]], cells: list[int], min_len: int) -> list[int]:
    """An order of all cells: repeatedly the sequence that covers most cells not placed yet (whole ones first, then more repetitions), the rest by number."""
    order, left = list(start), [c for c in cells if c not in set(start)]
    while len(left) >= min_len:
        free = set(left)
        ranked = [(len(free & set(s)) == len(s), len(free & set(s)), reps, tuple(-c for c in s), s) for s, reps in known if len(free & set(s)) >= min_len]
        if not ranked:
            break
        s = max(ranked)[4]
        order += [c for c in s if c in free]
        left = [c for c in left if c not in set(s)]
    return order + sorted(left)


def candidate_orders(seqs: DataFrame, cells: DataFrame, options: SequenceOptions, longest: bool = False) -> DataFrame:
    """(recording_id, order_id, cells): one full order per start cell, or one from the longest most repeated sequence."""
    s = seqs.groupBy("recording_id").agg(F.collect_list(F.struct("start", "cells", F.size("times").alias("reps"))).alias("seqs"))
    c = cells.groupBy("recording_id").agg(F.sort_array(F.collect_set("cell")).alias("all"))

    def run(batches: Iterable[pd.DataFrame]):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                rows = [(int(x["start"]), tuple(int(v) for v in x["cells"]), int(x["reps"])) for x in (r.seqs if r.seqs is not None else ())]
                known = sorted({(c, n) for _, c, n in rows})
                every = [int(v) for v in r.all]
                best: dict[int, tuple] = {}
                for st, c, n in rows:
                    best[st] = max(best.get(st, (0, 0, ())), (len(c), n, c))
                starts = [max(best.values())] if longest and best else [best[k] for k in sorted(best)]
                for i, (_, _, c) in enumerate(starts or [(0, 0, ())]):
                    out.append((r.recording_id, i, complete_order(list(c), known, every, options.min_len)))
            yield pd.DataFrame(out, columns=["recording_id", "order_id", "cells"])

    return c.join(s, "recording_id", "left").mapInPandas(run, "recording_id string, order_id int, cells array<int>")


def walk_ordered(rows: list[np.ndarray], options: SequenceOptions, tolerance: float = 0.2) -> dict[tuple[int, ...], list[list[int]]]:
    """Sequences through consecutive rows of an ordered raster, keyed by row numbers.

    From every spike the next rows' first spikes within ``[last + low, last + high)`` are
    taken; a miss widens the window by half, and misses are budgeted as in ``replay``.
    Sequences that differ in at most a fifth of their cells are merged into the longer,
    times padded with -1; those contained in a longer one with no occurrence of their own
    go.
    """
    o = options
    found: dict[tuple[int, ...], list[list[int]]] = {}
    for i in range(len(rows)):
        for t in rows[i]:
            times, at, missed, row, width = [int(t)], int(t), 0, 0, o.high - o.low
            for j in range(i + 1, len(rows)):
                k = np.searchsorted(rows[j], at + o.low)
                if k < len(rows[j]) and rows[j][k] < at + o.low + width:
                    at, row, width = int(rows[j][k]), 0, o.high - o.low
                    times.append(at)
                    continue
                missed, row, width = missed + 1, row + 1, width + width / 2
                times.append(-1)
                if row > 2 or missed > int(len(times) * o.error_rate) + o.min_errors:
                    break
            while times and times[-1] == -1:
                times.pop()
            if len(times) >= o.min_len:
                found.setdefault(tuple(range(i, i + len(times))), []).append(times)
    merged: dict[tuple[int, ...], list[list[int]]] = {}
    for cells in sorted(found, key=lambda c: (-len(c), c)):
        home = next((m for m in merged if len(set(cells) ^ set(m)) <= tolerance * len(m)), None)
        if home is None:
            long = [x for m, ts in merged.items() if set(cells) <= set(m) for x in ts]
            if not long or is_independent(found[cells], long):
                merged[cells] = [list(t) for t in found[cells]]
            continue
        at = {c: k for k, c in enumerate(home)}
        for t in found[cells]:
            wide = [-1] * len(home)
            for c, x in zip(cells, t, strict=True):
                if c in at:
                    wide[at[c]] = x
            if not any(sum(a == b and a >= 0 for a, b in zip(wide, u, strict=True)) for u in merged[home]):
                merged[home].append(wide)
    return {c: sorted(t) for c, t in merged.items() if len(t) >= o.min_reps}


def sequences_in_order(spikes: DataFrame, orders: DataFrame, options: SequenceOptions, by: list[str] = ()) -> DataFrame:
    """(recording_id, .., cells, times) of the ordered raster of each recording (and surrogate)."""
    r = spike_lists(spikes, by).join(orders.select("recording_id", "cells"), "recording_id")
    key = ["recording_id", *by]

    def run(batches: Iterable[pd.DataFrame]):
        for pdf in batches:
            out = []
            for x in pdf.itertuples():
                times, order = _times(x.raster), [int(c) for c in x.cells]
                for rows, occ in walk_ordered([times.get(c, np.zeros(0, int)) for c in order], options).items():
                    out.append((*(getattr(x, k) for k in key), [order[i] for i in rows], occ))
            yield pd.DataFrame(out, columns=[*key, "cells", "times"])

    extra = "".join(f"{k} int, " for k in by)
    return r.mapInPandas(run, f"recording_id string, {extra}cells array<int>, times array<array<int>>")


def included_in(reference: list[int], sequences: list[list[int]], max_gaps: int, min_len: int = 4) -> list[list[int]]:
    """Sequences that follow the reference order with at most so many cells of it left out between."""
    at = {c: i for i, c in enumerate(reference)}
    out = []
    for s in sequences:
        places = [at[c] for c in s if c in at]
        if len(places) >= min_len and len(places) == len(s) and all(b > a for a, b in zip(places, places[1:])) and places[-1] - places[0] + 1 - len(places) <= max_gaps:
            out.append(s)
    return out


def categories(real: DataFrame, surrogate: DataFrame, n_surrogates: int, percentile: float = 95) -> DataFrame:
    """Real sequences with a category: 4 if their length never occurs in surrogates, else 1 if more of the length were found than the percentile over surrogates, plus 2 if they repeat more often than that of surrogate repetitions; 0 is dropped."""
    r = real.withColumn("len", F.size("cells")).withColumn("reps", F.size("times"))
    s = surrogate.withColumn("len", F.size("cells")).withColumn("reps", F.size("times"))
    p = percentile / 100
    n = s.groupBy("recording_id", "len", "surr").agg(F.count("*").alias("n")).groupBy("recording_id", "len").agg(F.sort_array(F.collect_list("n")).alias("v"))
    at = p * (n_surrogates - 1)
    full = F.concat(F.array_repeat(F.lit(0).cast("bigint"), n_surrogates - F.size("v")), F.col("v"))
    lo, hi = int(at), min(int(at) + 1, n_surrogates - 1)
    n = n.withColumn("f", full).select("recording_id", "len", (F.col("f")[lo] + (F.col("f")[hi] - F.col("f")[lo]) * (at - lo)).alias("n_cut"))
    reps = s.groupBy("recording_id", "len").agg(F.percentile("reps", F.lit(p)).alias("rep_cut"))
    own = r.groupBy("recording_id", "len").agg(F.count("*").alias("n"))
    j = r.join(own, ["recording_id", "len"]).join(n.join(reps, ["recording_id", "len"]), ["recording_id", "len"], "left")
    c = F.when(F.col("rep_cut").isNull(), 4).otherwise((F.col("n") > F.col("n_cut")).cast("int") + 2 * (F.col("reps") > F.col("rep_cut")).cast("int"))
    return j.withColumn("category", c).where("category > 0").select("recording_id", "cells", "times", "len", "reps", "category")


def sequence_statistics(seqs: DataFrame) -> DataFrame:
    """Per length: sequences, mean and deviation of repetitions and of durations."""
    span = F.transform("times", lambda t: F.array_max(t) - F.array_min(F.filter(t, lambda x: x >= 0)))
    s = seqs.select("recording_id", F.size("cells").alias("len"), F.size("times").alias("reps"), F.explode(span).alias("duration"))
    one = seqs.select("recording_id", F.size("cells").alias("len"), F.size("times").alias("reps"))
    d = s.groupBy("recording_id", "len").agg(F.avg("duration").alias("mean_duration"), F.stddev_pop("duration").alias("std_duration"))
    return one.groupBy("recording_id", "len").agg(F.count("*").alias("n"), F.avg("reps").alias("mean_reps"), F.stddev_pop("reps").alias("std_reps")).join(d, ["recording_id", "len"])


def significant_sequences(spikes: DataFrame, recordings: DataFrame, cells: DataFrame, options: SequenceOptions, n_surrogates: int = 2, seed: int = 0, longest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(best order, sequences with categories): transitions, paths, orders scored by their loss, sequences of the best order against those of surrogates."""
    from pulsegrid.operators.loss import best_order, score_orders
    from pulsegrid.operators.raster import spike_rates

    n_cells = cells.agg(F.max(F.col("cell")) + 1).first()[0] or 1
    rates = spike_rates(spikes, recordings, cells) if options.rate_weight else None
    edges = durable(transitions(spikes, recordings, options.low, options.high, rates, options.no_reverse))
    seqs = without_contained(find_sequences(spikes, beam_paths(edges, options, n_cells), options), options)
    orders = durable(candidate_orders(seqs, cells, options, longest))
    down = orders.withColumn("cells", F.reverse("cells"))  # the loss follows rows upwards
    best = durable(best_order(orders, score_orders(spikes, recordings, down, options.low, options.high)))
    real = sequences_in_order(spikes, best, options)
    surr = sequences_in_order(rolled(spikes, recordings, n_surrogates, seed), best, options, ["surr"])
    return best, categories(real, surr, n_surrogates)
