"""Sweep lines over intervals of frames: how many are open at each moment, without a row for every frame.

An interval adds one where it starts and takes one off behind its end. The running sum
of a recording is cut into stretches of frames: each stretch sums up for itself, and the
sums of the stretches before it are carried in. So a long recording is not one task's
work, and the frames in between never become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Frames of a stretch.
STRETCH = 4096


def merged(intervals: DataFrame, by: list[str], start: str = "start_frame", end: str = "end_frame") -> DataFrame:
    """(*by, start, end): intervals of a key that overlap or touch become one; ends are inclusive."""
    order = W.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) > reach + 1), 1).otherwise(0)
    part = intervals.where(F.col(start) <= F.col(end)).withColumn("__opens", opens).withColumn("__part", F.sum("__opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return part.groupBy(*by, "__part").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__part")


def running(steps: DataFrame, by: list[str], at: str, step: str, stretch: int = STRETCH) -> DataFrame:
    """(*by, at, value, next): the running sum at each place where it changes, and the next such place (null at the last).

    ``steps(*by, at, step)`` may name a place more than once; places where the steps cancel
    are no changes.
    """
    each = steps.groupBy(*by, at).agg(F.sum(step).alias("__step")).where("__step <> 0").withColumn("__stretch", F.floor(F.col(at) / stretch))
    key = [*by, "__stretch"]
    whole = each.groupBy(*key).agg(F.sum("__step").alias("__sum"), F.min(at).alias("__first"))
    order = W.partitionBy(*by).orderBy("__stretch")
    carried = whole.select(*key, (F.sum("__sum").over(order) - F.col("__sum")).alias("__carried"), F.lead("__first").over(order).alias("__next"))
    inside = W.partitionBy(*key).orderBy(at)
    part = each.withColumn("__own", F.sum("__step").over(inside)).withColumn("__lead", F.lead(at).over(inside))
    return part.join(carried, key).select(*by, at, (F.col("__own") + F.col("__carried")).alias("value"), F.coalesce("__lead", "__next").alias("next"))


def open_share(intervals: DataFrame, recordings: DataFrame, n_items: DataFrame, item: str = "cluster", window: int | None = None, stretch: int = STRETCH) -> DataFrame:
    """(recording_id, start_frame, end_frame, n, percent): stretches of frames and how many items are active in them.

    ``intervals(recording_id, item, start_frame, end_frame)`` are activations (they may
    overlap), ``recordings(recording_id, n_frames)`` the extent, ``n_items(recording_id,
    n_items)`` what counts as all. With ``window``, an item counts at a frame if it is
    active in any of the ``window`` frames from there on; the last ``window`` frames, from
    which no whole window starts, keep the value of the last one that does. A recording
    shorter than that has no value.
    """
    rec = recordings.select("recording_id", F.col("n_frames").cast("long").alias("n_frames"))
    last = F.col("n_frames") - 1 if window is None else F.col("n_frames") - window - 1
    rec = rec.withColumn("__last", last).where("__last >= 0")
    i = intervals.join(rec, "recording_id")
    # a window sees an item from window - 1 frames before it starts
    lead = 0 if window is None else window - 1
    lo, hi = F.greatest(F.lit(0), F.col("start_frame") - lead), F.least(F.col("end_frame"), F.col("__last"))
    seen = merged(i.select("recording_id", item, lo.cast("long").alias("start_frame"), hi.cast("long").alias("end_frame"), "__last"), ["recording_id", item, "__last"])
    ends: Column = F.array(F.struct(F.col("start_frame").alias("at"), F.lit(1).alias("step")), F.struct((F.col("end_frame") + 1).alias("at"), F.lit(-1).alias("step")))
    steps = seen.select("recording_id", F.explode(ends).alias("e"), "__last").where("e.at <= __last").select("recording_id", "e.at", "e.step")
    changes = running(steps, ["recording_id"], "at", "step", stretch)
    # before the first change nothing is open
    first = rec.select("recording_id").join(changes.groupBy("recording_id").agg(F.min("at").alias("first")), "recording_id", "left")
    quiet = first.where("first is null or first > 0").select("recording_id", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("value"), F.col("first").alias("next"))
    parts = changes.unionByName(quiet).join(rec, "recording_id").join(n_items.select("recording_id", "n_items"), "recording_id")
    end = F.coalesce(F.col("next") - 1, F.col("n_frames") - 1)
    return parts.select("recording_id", F.col("at").cast("int").alias("start_frame"), end.cast("int").alias("end_frame"), F.col("value").alias("n"), (F.col("value") * 100.0 / F.col("n_items")).alias("percent"))
