"""Cell shapes: centres, masks, overlaps, matching between sessions, image profiles, graph colouring, hulls."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.sources.durable import durable


def pixels(cells: DataFrame) -> DataFrame:
    """Distinct contour pixels of ``cells(cell, contour ARRAY<STRUCT<x, y>>)``."""
    return cells.select("cell", F.explode("contour").alias("p")).select("cell", "p.x", "p.y").distinct()


def centres(cells: DataFrame) -> DataFrame:
    return pixels(cells).groupBy("cell").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def inside_polygon(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points lie in a polygon or on its edges, by crossings."""
    inside, edge = np.zeros(x.shape, bool), np.zeros(x.shape, bool)
    n = len(px)
    for i in range(n):
        x1, y1, x2, y2 = px[i - 1], py[i - 1], px[i], py[i]
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        edge |= (np.abs(cross) < 1e-9) & (x >= min(x1, x2)) & (x <= max(x1, x2)) & (y >= min(y1, y2)) & (y <= max(y1, y2))
        if y1 != y2:
            inside ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return inside | edge


def masks(cells: DataFrame) -> DataFrame:
    """(cell, x, y): the pixels of each filled contour."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                px, py = (np.array([p[k] for p in r.contour], float) for k in ("x", "y"))
                if len(px):
                    x, y = np.meshgrid(np.arange(px.min(), px.max() + 1), np.arange(py.min(), py.max() + 1))
                    on = inside_polygon(px, py, x, y)
                    out.append(pd.DataFrame({"cell": r.cell, "x": x[on].astype(int), "y": y[on].astype(int)}))
            yield pd.concat(out) if out else pd.DataFrame({"cell": [], "x": [], "y": []}, dtype="int64")

    return cells.select("cell", "contour").mapInPandas(run, "cell int, x int, y int")


def overlaps(mask: DataFrame) -> DataFrame:
    """(a, b, n): cells a < b that share pixels."""
    a, b = mask.withColumnRenamed("cell", "a"), mask.withColumnRenamed("cell", "b")
    return a.join(b, ["x", "y"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def match_cells(first: DataFrame, second: DataFrame, radius: float = 2.0) -> DataFrame:
    """(cell, matched): the nearest centre of a second session within ``radius``, else -1; of equals the lowest cell.

    Equal centres are one. They are dealt to grid squares and each meets its own and the
    eight around, first in squares of a sixteenth of the radius, then of a quarter and of
    the radius: what lies within a square's side is the nearest, and only centres that have
    found nothing so near go on, so dense places don't make all their pairs.
    """
    a = durable(first.groupBy("cx", "cy").agg(F.collect_list("cell").alias("cells")).select("cx", "cy", F.explode("cells").alias("cell")))
    b = durable(second.groupBy(F.col("cx").alias("ox"), F.col("cy").alias("oy")).agg(F.min("cell").alias("other")))
    left, found = a.select("cx", "cy").distinct(), None
    d = F.sqrt((F.col("cx") - F.col("ox")) ** 2 + (F.col("cy") - F.col("oy")) ** 2)
    for part in (16, 4, 1):
        side = radius / part
        sq = lambda c: F.floor(F.col(c) / side)  # noqa: B023, E731
        near = F.explode(F.array(*[F.struct((sq("cx") + i).alias("gx"), (sq("cy") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        x = left.select("cx", "cy", near.alias("g")).select("cx", "cy", "g.gx", "g.gy")
        hit = x.join(b.withColumn("gx", sq("ox")).withColumn("gy", sq("oy")), ["gx", "gy"]).withColumn("d", d).where(F.col("d") <= side)
        best = durable(hit.groupBy("cx", "cy").agg(F.min(F.struct("d", "other")).alias("m")).select("cx", "cy", "m.other"))
        found = best if found is None else found.union(best)
        left = durable(left.join(best, ["cx", "cy"], "left_anti"))
    return a.join(found, ["cx", "cy"], "left").select("cell", F.coalesce("other", F.lit(-1)).alias("matched"))


def translated(cells: DataFrame, dx: int, dy: int) -> DataFrame:
    return cells.withColumn("contour", F.transform("contour", lambda p: F.struct((p["x"] - dx).cast("int").alias("x"), (p["y"] - dy).cast("int").alias("y"))))


def transient_profiles(pixels_: DataFrame, traces: DataFrame, transients: DataFrame) -> DataFrame:
    """(cell, transient, x, y, v): mean image over each transient, frames weighted by the cell's trace.

    ``pixels_(frame, x, y, v)`` clipped to the cells' boxes by ``box(cell, ..)`` joins upstream;
    ``transients(cell, transient, start_frame, end_frame)``.
    """
    f = transients.select("cell", "transient", F.explode(F.sequence("start_frame", "end_frame")).alias("frame")).join(traces.select("cell", "frame", F.col("value").alias("w")), ["cell", "frame"])
    key = [c for c in ("cell",) if c in pixels_.columns]
    return f.join(pixels_, [*key, "frame"]).groupBy("cell", "transient", "x", "y").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))


def source_profiles(profiles: DataFrame, peaks: DataFrame, most: int = 10) -> DataFrame:
    """(cell, x, y, v): mean of the profiles of each cell's highest peaks, ``peaks(cell, transient, height)``."""
    rank = F.row_number().over(W.partitionBy("cell").orderBy(F.desc("height"), "transient"))
    best = peaks.withColumn("r", rank).where(F.col("r") <= most).select("cell", "transient")
    return profiles.join(best, ["cell", "transient"]).groupBy("cell", "x", "y").agg(F.avg("v").alias("v"))


def profile_correlation(profiles: DataFrame, sources: DataFrame, mask: DataFrame) -> DataFrame:
    """(cell, transient, r): Pearson correlation of a transient's image with the cell's source profile inside its mask."""
    s = sources.select("cell", "x", "y", F.col("v").alias("s")).join(mask, ["cell", "x", "y"], "left_semi")
    return profiles.join(s, ["cell", "x", "y"]).groupBy("cell", "transient").agg(F.corr("v", "s").alias("r"))


def angle(x: float, y: float, cx: float, cy: float) -> float:
    """Angle of a point seen from a centre, 0 to 2 pi."""
    return float(np.arctan2(y - cy, x - cx) % (2 * np.pi))


def triangle_area(a, b, c) -> float:
    return abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) / 2


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the leftmost lowest point."""
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 3:
        return p

    def half(rows) -> list:
        out: list = []
        for r in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (r[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (r[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(tuple(r))
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def hulls(points: DataFrame, by: str) -> DataFrame:
    """(by, i, x, y) of the hull of each group of ``(by, x, y)``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({by: pdf[by].iloc[0], "i": range(len(h)), "x": h[:, 0], "y": h[:, 1]})

    return points.groupBy(by).applyInPandas(run, f"{by} {points.schema[by].dataType.simpleString()}, i int, x double, y double")


def colour(edges: list[tuple[int, int]], nodes: list[int] = (), ascending: bool = True) -> dict[int, int]:
    """Greedy colours, nodes taken by degree (then number): each colour is given to all nodes it fits before the next."""
    near: dict[int, set] = {n: set() for n in nodes}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    order = sorted(near, key=lambda n: (len(near[n]) if ascending else -len(near[n]), n))
    out: dict[int, int] = {}
    c = 0
    while len(out) < len(near):
        now: set[int] = set()
        for n in order:
            if n not in out and not near[n] & now:
                out[n] = c
                now.add(n)
        c += 1
    return out


def colour_graphs(edges: DataFrame, by: str, ascending: bool = True) -> DataFrame:
    """(by, node, colour) of each group of ``(by, src, dst)``; a group is one small graph."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = colour(list(zip(pdf.src, pdf.dst, strict=True)), ascending=ascending)
        return pd.DataFrame({by: pdf[by].iloc[0], "node": list(c), "colour": list(c.values())})

    return edges.groupBy(by).applyInPandas(run, f"{by} {edges.schema[by].dataType.simpleString()}, node int, colour int")


def spring_layout(edges: list[tuple[int, int]], rounds: int = 2000, seed: int = 0) -> dict[int, tuple[float, float]]:
    """Positions by attraction along edges and repulsion of all pairs, steps shrinking to none."""
    nodes = sorted({x for e in edges for x in e})
    at = {n: i for i, n in enumerate(nodes)}
    rng = np.random.default_rng(seed)
    p = rng.random((len(nodes), 2))
    e = np.array([(at[a], at[b]) for a, b in edges if a != b]).reshape(-1, 2)
    k = 1 / np.sqrt(max(len(nodes), 1))
    for i in range(rounds):
        d = p[:, None] - p
        r = np.maximum(np.linalg.norm(d, axis=2), 1e-6)
        f = (d / r[..., None] * (k**2 / r)[..., None]).sum(1)
        pull = p[e[:, 0]] - p[e[:, 1]]
        pull = pull * np.linalg.norm(pull, axis=1, keepdims=True) / k
        np.add.at(f, e[:, 0], -pull)
        np.add.at(f, e[:, 1], pull)
        size = np.maximum(np.linalg.norm(f, axis=1, keepdims=True), 1e-9)
        p = p + f / size * np.minimum(size, 0.1 * (1 - i / rounds))
    return {n: (float(a), float(b)) for n, (a, b) in zip(nodes, p, strict=True)}
