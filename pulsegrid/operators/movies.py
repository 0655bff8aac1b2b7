"""Cell boxes cut out of a movie, and the profiles made of them.

A movie is ``(frame, x, y, v)``; pixels it lacks are dark (0). Boxes are found by a tile
index: a box is dealt to the tiles it covers, a transient to its frames, and pixels meet
both by equality of (frame, tile). Only pixels of wanted frames and tiles are moved, and a
tile that many cells share is still spread over its frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Side of a tile in pixels.
TILE = 16


def boxes(cells: DataFrame, width: int, height: int, around: int = 0) -> DataFrame:
    """(cell, min_x, min_y, max_x, max_y): the whole-pixel bounds of each contour, ``around`` pixels wider, inside the frame.

    ``cells(cell, contour ARRAY<STRUCT<x, y>>)``. Bounds lose their fractions towards zero.
    """
    cut = lambda f, c: f(F.transform("contour", lambda p: p[c])).cast("int")
    low = lambda c: F.greatest(F.lit(0), cut(F.array_min, c) - around)
    high = lambda c, n: F.least(F.lit(n - 1), cut(F.array_max, c) + around)
    out = cells.where(F.size("contour") > 0).select("cell", low("x").alias("min_x"), low("y").alias("min_y"), high("x", width).alias("max_x"), high("y", height).alias("max_y"))
    return out.where("min_x <= max_x and min_y <= max_y")


def whole_frame(cells: DataFrame, width: int, height: int) -> DataFrame:
    """The same box, the whole frame, for every cell."""
    return cells.select("cell", F.lit(0).alias("min_x"), F.lit(0).alias("min_y"), F.lit(width - 1).alias("max_x"), F.lit(height - 1).alias("max_y"))


def shifted_contours(cells: DataFrame, box: DataFrame) -> DataFrame:
    """Contours in the coordinates of their boxes, fractions kept."""
    at = cells.join(box.select("cell", "min_x", "min_y"), "cell")
    return at.withColumn("contour", F.transform("contour", lambda p: F.struct((p["x"] - F.col("min_x")).alias("x"), (p["y"] - F.col("min_y")).alias("y")))).drop("min_x", "min_y")


def shifted_points(points: DataFrame, box: DataFrame) -> DataFrame:
    """(cell, x, y): contour points, whole numbers, in the coordinates of their boxes; a point keeps its fraction's loss towards zero."""
    return points.join(box.select("cell", "min_x", "min_y"), "cell").select("cell", (F.col("x").cast("int") - F.col("min_x")).alias("x"), (F.col("y").cast("int") - F.col("min_y")).alias("y"))


def _tiles(lo: str, hi: str) -> Column:
    return F.explode(F.sequence(F.floor(F.col(lo) / TILE), F.floor(F.col(hi) / TILE)))


def cut_out(movie: DataFrame, box: DataFrame, spans: DataFrame) -> DataFrame:
    """(cell, transient, frame, x, y, v): the pixels of each cell's box in the frames of its spans, in coordinates of the box.

    ``spans(cell, transient, start_frame, end_frame)``.
    """
    wanted = spans.join(box, "cell").withColumn("frame", F.explode(F.sequence("start_frame", "end_frame"))).drop("start_frame", "end_frame")
    wanted = wanted.withColumn("tile_x", _tiles("min_x", "max_x")).withColumn("tile_y", _tiles("min_y", "max_y"))
    tiled = movie.select("frame", "x", "y", "v", F.floor(F.col("x") / TILE).alias("tile_x"), F.floor(F.col("y") / TILE).alias("tile_y"))
    inside = tiled.join(wanted, ["frame", "tile_x", "tile_y"]).where("x between min_x and max_x and y between min_y and max_y")
    return inside.select("cell", "transient", "frame", (F.col("x") - F.col("min_x")).cast("int").alias("x"), (F.col("y") - F.col("min_y")).cast("int").alias("y"), "v")


def lifted(traces: DataFrame) -> DataFrame:
    """Traces raised by the size of the smallest value of all cells."""
    return traces.crossJoin(traces.agg(F.abs(F.min("value")).alias("__by"))).withColumn("value", F.col("value") + F.col("__by")).drop("__by")  # one row


def span_profiles(movie: DataFrame, box: DataFrame, traces: DataFrame, spans: DataFrame) -> DataFrame:
    """(cell, transient, x, y, v): the mean picture of each span in the cell's box, frames weighted by the cell's lifted trace.

    Pixels dark in all frames of a span have no row.
    """
    weights = lifted(traces).select("cell", "frame", F.col("value").alias("w"))
    total = spans.withColumn("frame", F.explode(F.sequence("start_frame", "end_frame"))).join(weights, ["cell", "frame"]).groupBy("cell", "transient").agg(F.sum("w").alias("total"))
    summed = cut_out(movie, box, spans).join(weights, ["cell", "frame"]).groupBy("cell", "transient", "x", "y").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return summed.join(total, ["cell", "transient"]).select("cell", "transient", "x", "y", (F.col("v") / F.col("total")).alias("v"))


def chosen_peaks(peaks: DataFrame, fewest: int = 5, most: int = 10) -> DataFrame:
    """(cell, frame): the highest peaks of each cell, over its 95th percentile; where that leaves over ``most`` or under ``fewest`` (of more than those), over the percentile that leaves as many.

    ``peaks(cell, frame, value)``; percentiles are linear between ranks, ties fall together.
    """
    order = W.partitionBy("cell").orderBy("value")
    ranked = peaks.withColumn("__r", F.row_number().over(order) - 1).withColumn("__n", F.count("*").over(W.partitionBy("cell")))

    def over(rows: DataFrame, share: Column, name: str) -> DataFrame:
        h = (F.col("__n") - 1) * share
        at = lambda r: F.max(F.when(F.col("__r") == r, F.col("value"))).over(W.partitionBy("cell"))
        low, high = at(F.floor(h)), at(F.ceil(h))
        return rows.withColumn(name, low + (high - low) * (h - F.floor(h)))

    rows = over(ranked, F.lit(0.95), "__t")
    rows = rows.withColumn("__k", F.count(F.when(F.col("value") > F.col("__t"), 1)).over(W.partitionBy("cell")))
    share = F.when(F.col("__k") > most, 1 - most / F.col("__n")).when((F.col("__k") < fewest) & (F.col("__n") > fewest), 1 - fewest / F.col("__n")).otherwise(0.95)
    rows = over(rows.withColumn("__share", share), F.col("__share"), "__t2")
    return rows.where("value > __t2").select("cell", "frame")


def rises(peaks: DataFrame, onsets: DataFrame) -> DataFrame:
    """(cell, transient, start_frame, end_frame): from the last onset at or before each peak up to it; ``transient`` is the peak's frame.

    A peak without an onset before it has no span.
    """
    both = peaks.select("cell", "frame", F.lit(1).alias("__peak")).unionByName(onsets.select("cell", "frame", F.lit(0).alias("__peak")))
    order = W.partitionBy("cell").orderBy("frame", "__peak").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("__peak") == 0, F.col("frame")), ignorenulls=True).over(order)
    return both.withColumn("start_frame", last).where("__peak = 1 and start_frame is not null").select("cell", F.col("frame").alias("transient"), "start_frame", F.col("frame").alias("end_frame"))


def movie_sources(movie: DataFrame, box: DataFrame, traces: DataFrame, peaks: DataFrame, onsets: DataFrame) -> DataFrame:
    """(cell, x, y, v): the source profile of each cell, the mean of the profiles of its chosen peaks.

    ``peaks(cell, frame)`` and ``onsets(cell, frame)``; a chosen peak without an onset
    counts as a dark picture.
    """
    chosen = chosen_peaks(peaks.select("cell", "frame").join(traces.select("cell", "frame", "value"), ["cell", "frame"]))
    n = chosen.groupBy("cell").agg(F.count("*").alias("n"))
    each = span_profiles(movie, box, traces, rises(chosen, onsets))
    return each.groupBy("cell", "x", "y").agg(F.sum("v").alias("v")).join(n, "cell").select("cell", "x", "y", (F.col("v") / F.col("n")).alias("v"))


def boxed(profiles: DataFrame, box: DataFrame, key: list[str]) -> DataFrame:
    """Profiles with a row for every pixel of the box, dark ones 0."""
    px = profiles.select(*key).distinct().join(box, "cell") if key != ["cell"] else box.join(profiles.select("cell").distinct(), "cell")
    spine = px.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("max_x") - F.col("min_x")))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("max_y") - F.col("min_y"))))
    return spine.select(*key, "x", "y").join(profiles, [*key, "x", "y"], "left").select(*key, "x", "y", F.coalesce("v", F.lit(0.0)).alias("v"))
