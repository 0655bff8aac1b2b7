"""Raster primitives: rates, runs, bins, intervals, activity, time correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["recording_id", "cell"]


def frames(recordings: DataFrame, last: Column | None = None) -> DataFrame:
    """The spine (recording_id, frame) for frames 0 .. n_frames - 1, or below ``last``."""
    n = F.col("n_frames") if last is None else last
    return recordings.where(n > 0).select("recording_id", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("frame"))


def spike_rates(spikes: DataFrame, recordings: DataFrame, cells: DataFrame) -> DataFrame:
    """Share of frames in which each cell is active; silent cells have 0."""
    n = spikes.groupBy(*KEY).agg(F.count("*").alias("n"))
    return cells.join(n, KEY, "left").join(recordings, "recording_id").select(*KEY, (F.coalesce("n", F.lit(0)) / F.col("n_frames")).alias("rate"))


def islands(rows: DataFrame, by: list[str], frame: str = "frame") -> DataFrame:
    """Maximal runs of consecutive frames: (*by, run_id from 0, start_frame, end_frame inclusive, length)."""
    order = W.partitionBy(*by).orderBy(frame)
    runs = rows.withColumn("__island", F.col(frame) - F.row_number().over(order)).groupBy(*by, "__island").agg(F.min(frame).alias("start_frame"), F.max(frame).alias("end_frame"))
    runs = runs.withColumn("run_id", (F.row_number().over(W.partitionBy(*by).orderBy("start_frame")) - 1).cast("int"))
    return runs.select(*by, "run_id", "start_frame", "end_frame", (F.col("end_frame") - F.col("start_frame") + 1).cast("int").alias("length"))


def runs(spikes: DataFrame) -> DataFrame:
    """Runs of each cell; repeated spikes don't count.

    Frames are held as bits of words, so that what is sorted is a word's row and not a
    spike's: a run starts at a bit without one before it and ends at one without one after.
    """
    place = F.pmod(F.col("frame"), F.lit(64)).cast("int")
    held = spikes.where("frame is not null").select(*KEY, F.floor(F.col("frame") / 64).cast("int").alias("word"), place.alias("place"))
    words = held.groupBy(*KEY, "word").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits"))
    order = W.partitionBy(*KEY).orderBy("word")
    before = F.when(F.lag("word").over(order) == F.col("word") - 1, F.shiftrightunsigned(F.lag("bits").over(order), 63)).otherwise(F.lit(0).cast("long"))
    after = F.when(F.lead("word").over(order) == F.col("word") + 1, F.shiftleft(F.lead("bits").over(order), 63)).otherwise(F.lit(0).cast("long"))
    ends = words.withColumn("before", before).withColumn("after", after).selectExpr(*KEY, "word", "bits & ~(shiftleft(bits, 1) | before) as first", "bits & ~(shiftrightunsigned(bits, 1) | after) as last")
    lists = ends.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("word", "first", "last"))).alias("w"))
    at = lambda c: F.expr(f"flatten(transform(w, x -> transform(filter(sequence(0, 63), i -> shiftrightunsigned(x.{c}, i) & 1 = 1), i -> x.word * 64 + i)))").cast("array<int>")
    each = lists.select(*KEY, at("first").alias("start_frame"), at("last").alias("end_frame")).select(*KEY, F.posexplode(F.arrays_zip("start_frame", "end_frame")).alias("run_id", "r"))
    return each.select(*KEY, "run_id", "r.start_frame", "r.end_frame", (F.col("r.end_frame") - F.col("r.start_frame") + 1).cast("int").alias("length"))


def continuous_frames(frame_rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Consecutive groups of a list of frames."""
    by = list(by) or ["recording_id"]
    return islands(frame_rows.select(*by, "frame").distinct(), by)


def transient_ids(spikes: DataFrame, recordings: DataFrame, cells: DataFrame) -> DataFrame:
    """The run every (cell, frame) belongs to, -1 outside runs."""
    inside = runs(spikes).select(*KEY, "run_id", F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))
    spine = cells.join(frames(recordings), "recording_id")
    return spine.join(inside, [*KEY, "frame"], "left").select(*KEY, "frame", F.coalesce("run_id", F.lit(-1)).alias("run_id"))


def run_durations(spikes: DataFrame, cells: DataFrame) -> DataFrame:
    """Lengths of each cell's runs in order; an empty list where there is none."""
    d = runs(spikes).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("run_id", "length"))), lambda x: x["length"]).alias("durations"))
    return cells.join(d, KEY, "left").select(*KEY, F.coalesce("durations", F.array().cast("array<int>")).alias("durations"))


def bin_or(spikes: DataFrame, recordings: DataFrame, bin_size: int) -> DataFrame:
    """Same number of frames: every frame of a bin with a spike is active."""
    b = spikes.select(*KEY, F.floor(F.col("frame") / bin_size).cast("int").alias("b")).distinct().join(recordings, "recording_id")
    last = F.least(F.col("n_frames") - 1, F.col("b") * bin_size + bin_size - 1).cast("int")
    return b.select(*KEY, F.explode(F.sequence(F.col("b") * bin_size, last)).alias("frame"))


def bin_sum(spikes: DataFrame, bin_size: int) -> DataFrame:
    """Spikes per (cell, bin); bins without spikes have no row."""
    return spikes.groupBy(*KEY, F.floor(F.col("frame") / bin_size).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def isi(spikes: DataFrame, time: str = "frame") -> DataFrame:
    """Intervals between consecutive spikes of a cell, with the later spike."""
    before = F.lag(time).over(W.partitionBy(*KEY).orderBy(time))
    return spikes.select(*KEY, time, (F.col(time) - before).alias("isi")).where("isi is not null")


def isi_lists(spikes: DataFrame, time: str = "frame") -> DataFrame:
    return isi(spikes, time).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct(time, "isi"))), lambda x: x["isi"]).alias("isi"))


def activity_sum(spikes: DataFrame, recordings: DataFrame, percent: bool = False) -> DataFrame:
    """Distinct active cells of every frame, or their percentage of all cells."""
    n = spikes.groupBy("recording_id", "frame").agg(F.count_distinct("cell").alias("n"))
    out = frames(recordings).join(n, ["recording_id", "frame"], "left").select("recording_id", "frame", F.coalesce("n", F.lit(0)).alias("n_cells_active"))
    if not percent:
        return out
    return out.join(recordings, "recording_id").select("recording_id", "frame", (F.col("n_cells_active") * 100.0 / F.col("n_cells")).alias("percent"))


def busy_windows(spikes: DataFrame, window: int, distinct: bool = True, by: list[str] = ()) -> DataFrame:
    """(recording_id, *by, t, n): cells (or spikes) in ``[t, t + window)`` for the starts t from 0 on that see any."""
    key = ["recording_id", *by]
    starts = spikes.select(*key, "cell", F.explode(F.sequence(F.greatest(F.lit(0), F.col("frame") - window + 1), F.col("frame"))).alias("t")) if window > 1 else spikes.select(*key, "cell", F.col("frame").alias("t"))
    if distinct and window > 1:
        starts = starts.distinct()
    return starts.groupBy(*key, "t").agg(F.count("*").alias("n"))


def window_activity(spikes: DataFrame, recordings: DataFrame, window: int, distinct: bool = True, by: list[str] = ()) -> DataFrame:
    """Cells (or spikes) in ``[frame, frame + window)`` for each start 0 .. n_frames - window - 1 (all frames for window 1).

    A spike is handed to the starts that see it, so nothing is compared with everything.
    """
    key = ["recording_id", *by]
    n = busy_windows(spikes, window, distinct, by)
    last = F.col("n_frames") if window == 1 else F.col("n_frames") - window
    spine = frames(recordings, last)
    if by:
        spine = spine.join(spikes.select(*key).distinct(), "recording_id")
    return spine.join(n.withColumnRenamed("t", "frame"), [*key, "frame"], "left").select(*key, "frame", F.coalesce("n", F.lit(0)).alias("n"))


def time_correlation(spikes: DataFrame, recordings: DataFrame, events: DataFrame, around: int = 5) -> DataFrame:
    """(cell, avg_lag, correlation) from the lags between a cell's first spike around events and the other cells' spikes.

    ``events(recording_id, event_id, start_frame, end_frame)``; lags are counted once per
    (cell, other, lag, event), the correlation is the largest count's share of all.
    """
    lo, hi = F.greatest(F.lit(0), F.col("start_frame") - around), F.least(F.col("end_frame") + 1 + around, F.col("n_frames") - 1)
    span = events.join(recordings, "recording_id").select("recording_id", "event_id", lo.alias("lo"), hi.alias("hi")).where("lo < hi")
    inside = span.select("recording_id", "event_id", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("frame")).join(spikes, ["recording_id", "frame"])
    first = inside.groupBy("recording_id", "event_id", "cell").agg(F.min("frame").alias("own"))
    # spikes of an event and frame are counted once for all cells, and a cell's own are taken off
    every = inside.groupBy("recording_id", "event_id", "frame").agg(F.count("*").alias("n"))
    met = first.join(every, ["recording_id", "event_id"]).select(*KEY, (F.col("own") - F.col("frame")).alias("lag"), "n")
    itself = inside.join(first, [*KEY, "event_id"]).select(*KEY, (F.col("own") - F.col("frame")).alias("lag"), F.lit(-1).cast("long").alias("n"))
    counts = met.union(itself).groupBy(*KEY, "lag").agg(F.sum("n").alias("n")).where("n > 0")
    return counts.groupBy(*KEY).agg((F.sum(F.col("lag") * F.col("n")) / F.sum("n")).alias("avg_lag"), (F.max("n") / F.sum("n")).alias("correlation"))


def trains_to_spikes(trains: DataFrame) -> DataFrame:
    """Spike times to frames: less the first time of the recording, cut to whole frames, without repeats."""
    low = trains.groupBy("recording_id").agg(F.min("t").alias("low"))
    return trains.join(low, "recording_id").select(*KEY, F.floor(F.col("t") - F.col("low")).cast("int").alias("frame")).distinct()


def spikes_to_trains(spikes: DataFrame) -> DataFrame:
    return spikes.groupBy(*KEY).agg(F.sort_array(F.collect_list("frame")).alias("train"))


def train_range(trains: DataFrame) -> DataFrame:
    return trains.groupBy("recording_id").agg(F.min("t").alias("min_t"), F.max("t").alias("max_t"))


def percentile_rank(scores: DataFrame, value: Column | float, score: str = "score", by: list[str] = ()) -> DataFrame:
    """Percentage of scores at or under ``value``."""
    value = value if isinstance(value, Column) else F.lit(value)
    return scores.groupBy(*by).agg((100.0 * F.avg((F.col(score) <= value).cast("int"))).alias("rank"))


def percentile_ranks(scores: DataFrame, score: str = "score", by: list[str] = ()) -> DataFrame:
    """The percentile rank of every score among its group."""
    return scores.withColumn("rank", 100.0 * F.cume_dist().over(W.partitionBy(*by).orderBy(score)))
