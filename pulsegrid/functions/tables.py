"""Row-generating functions for SQL, to be joined laterally.

    register(spark)
    spark.sql("SELECT cell, p.x, p.y FROM {cells}, LATERAL mask_pixels(xs, ys) p", cells=df)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from pulsegrid.operators.spatial import inside_polygon
from pulsegrid.operators.waves import slope_ranges

#: Rows of a mask that are judged at once, which bounds the memory of a large contour.
ROWS = 256


class MaskPixels:
    """The whole-number points in a polygon or on its edges, from the corners' coordinates; no corners, no points."""

    def eval(self, xs: list, ys: list) -> Iterator[tuple[int, int]]:
        if not xs or not ys or len(xs) != len(ys):
            return
        px, py = np.array(xs, float), np.array(ys, float)
        across = np.arange(np.ceil(px.min()), np.floor(px.max()) + 1)
        for top in np.arange(np.ceil(py.min()), np.floor(py.max()) + 1, ROWS):
            x, y = np.meshgrid(across, np.arange(top, min(top + ROWS, np.floor(py.max()) + 1)))
            on = inside_polygon(px, py, x, y)
            yield from zip(x[on].astype(int).tolist(), y[on].astype(int).tolist(), strict=True)


class SlopeRanges:
    """(place, first_frame, last_frame): where a wave of constant slope is looked for, for the places after the first; no rows if it leaves the recording."""

    def eval(self, first: int, last: int, frame: int, slope: float, n_frames: int, around: int) -> Iterator[tuple[int, int, int]]:
        if None not in (first, last, frame, slope, n_frames, around):
            for place, (lo, hi) in enumerate(slope_ranges(first, last, frame, slope, n_frames, around) or [], first + 1):
                yield place, lo, hi - 1


class FramesBetween:
    """The frames of an interval, both ends among them."""

    def eval(self, start: int, end: int) -> Iterator[tuple[int]]:
        if start is not None and end is not None:
            yield from ((f,) for f in range(start, end + 1))


FUNCTIONS = {
    "mask_pixels": udtf(MaskPixels, returnType="x int, y int", useArrow=False),
    "slope_ranges": udtf(SlopeRanges, returnType="place int, first_frame int, last_frame int", useArrow=False),
    "frames_between": udtf(FramesBetween, returnType="frame int", useArrow=False),
}


def register(spark: SparkSession) -> None:
    """Make the functions callable from SQL in this session; repeated calls change nothing."""
    for name, f in FUNCTIONS.items():
        spark.udtf.register(name, f)
