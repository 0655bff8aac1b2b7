"""How often cells follow each other, for all pairs of cells, as products of blocks.

The cells of a recording are dealt to blocks, and a task holds one pair of blocks as trains.
It takes parts of both as two rasters: the spikes of the one side's cells, and for each of
their frames whether (and how late) a cell of the other side follows. Their product counts
every pair of cells at once; it is made strip by strip and handed on, or folded to what is
asked of it, where it is made. Nothing of the size of the pairs is shuffled, sorted or kept:
a block is packed and sent once for every block, and there are no more than ``WIDE`` of them
until they are full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.sources.durable import durable

#: Cells of a part at most, cells of a block at least, values of a part's raster, and rows of a product made at once.
MOST, LEAST, RASTER, STRIP = 4096, 64, 4_000_000, 256
#: Blocks of a recording, unless one would hold more spikes than a task is to have.
WIDE, SPIKES = 12, 4_000_000
#: A product over a frame costs so much less than adding up one of a cell's spikes, in parts of so many cells at least.
DENSE, NARROW = 5, 256
#: Tasks of one job at most.
TASKS = 8192


class Side:
    """A part of a block: cells in order, with their spikes, what the cells carry, and the rasters made of them."""

    def __init__(self, rows: pa.StructArray, n_frames: int):
        self.cells, self.n_frames, self.rows = rows.field("cell"), n_frames, rows
        trains = rows.field("frames")
        self.at = np.repeat(np.arange(len(rows)), np.asarray(pc.list_value_length(trains)))
        self.frames = np.asarray(trains.flatten(), dtype=np.int64)
        keep = None if rows.type.get_field_index("searched") < 0 else np.asarray(rows.field("searched").flatten(), dtype=bool)
        inside = (self.frames >= 0) & (self.frames < n_frames)
        self.found = inside if keep is None else inside & keep

    def __len__(self) -> int:
        return len(self.cells)

    def column(self, name: str) -> np.ndarray:
        return np.asarray(self.rows.field(name).to_numpy(zero_copy_only=False), dtype=float)

    @property
    def thin(self) -> bool:
        """Whether adding up the frames of a cell's spikes costs less than a product over all frames, and fits a byte."""
        return len(self) >= NARROW and len(self.frames) * DENSE <= len(self) * self.n_frames and np.bincount(self.at, minlength=1).max() <= 255

    def places(self, offsets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(frames, places): the frames with a spike, and the place of each spike's frame among them."""
        frames = self._moved(offsets)
        if offsets is None:
            t, to = np.unique(frames, return_inverse=True)
        else:  # moved frames are all inside, and need no sorting
            t = np.flatnonzero(np.bincount(frames, minlength=self.n_frames))
            place = np.zeros(self.n_frames, int)
            place[t] = np.arange(len(t))
            to = place[frames]
        return t, to

    def sources(self, offsets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(frames, counts): the frames with a spike, and each cell's spikes in them."""
        t, to = self.places(offsets)
        place = self.at * len(t) + to
        x = np.zeros(len(self) * len(t), np.float32)
        x[place] = 1
        if np.count_nonzero(x) < len(place):  # a frame comes twice
            x = np.bincount(place, minlength=len(x)).astype(np.float32)
        return t, x.reshape(len(self), len(t))

    def raster(self, offsets: np.ndarray | None = None) -> np.ndarray:
        s = np.zeros((len(self), self.n_frames), bool)
        s[self.at[self.found], self._moved(offsets)[self.found]] = True
        return s

    def _moved(self, offsets: np.ndarray | None) -> np.ndarray:
        return self.frames if offsets is None else (self.frames + offsets[self.at]) % self.n_frames


def parts(rows: pa.StructArray, n_frames: int) -> list[Side]:
    """The cells of a block, in order, by as many as may be a raster at once."""
    rows = rows.take(pc.sort_indices(rows.field("cell")))
    size = max(LEAST, min(MOST, RASTER // max(n_frames, 1)))
    return [Side(rows.slice(at, size), n_frames) for at in range(0, len(rows), size)]


def pack(rows: pa.StructArray) -> bytes:
    """The cells of a block, in order; frames go as their steps, byte by byte, of which most are 0 or alike."""
    rows = rows.take(pc.sort_indices(rows.field("cell")))
    columns = dict(zip([f.name for f in rows.type], rows.flatten(), strict=True))
    trains = columns.pop("frames")
    steps = np.diff(np.asarray(trains.flatten()), prepend=trains.type.value_type.to_pandas_dtype()(0))  # wraps around, and back in unpack
    for k, part in enumerate(steps.view(np.uint8).reshape(-1, steps.itemsize).T):
        columns[f"frames{k}"] = pa.ListArray.from_arrays(trains.offsets, pa.array(np.ascontiguousarray(part)))
    batch = pa.RecordBatch.from_pydict(columns)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpack(block: pa.Buffer) -> pa.StructArray:
    """The rows given to ``pack``, by cell."""
    with pa.ipc.open_stream(block) as stream:
        batch = stream.read_next_batch()
    columns = dict(zip(batch.schema.names, batch.columns, strict=True))
    bytes_ = [columns.pop(c) for c in batch.schema.names if c.startswith("frames")]
    steps = np.stack([np.asarray(x.flatten()) for x in bytes_], axis=1).view(f"i{len(bytes_)}").ravel()
    columns["frames"] = pa.ListArray.from_arrays(bytes_[0].offsets, pa.array(np.cumsum(steps, dtype=steps.dtype)))
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def follows(raster: np.ndarray, t: np.ndarray, low: int, high: int, lags: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """(hit, lag): whether each cell has a spike in ``[t + low, t + high)`` of every t, and how late its first comes; t ascends."""
    n = raster.shape[1]
    hit = np.zeros((len(raster), len(t)), bool)
    lag = np.zeros(hit.shape, np.float32) if lags else None
    whole = len(t) and t[-1] - t[0] == len(t) - 1  # then frames are a slice
    for d in range(high - 1, low - 1, -1):  # the earliest is seen last
        ok = slice(*np.searchsorted(t, [-d, n - d]))
        if ok.start >= ok.stop:
            continue
        seen = raster[:, t[ok.start] + d : t[ok.stop - 1] + d + 1] if whole else raster[:, t[ok] + d]
        hit[:, ok] |= seen
        if lags:
            np.copyto(lag[:, ok], d, where=seen)
    return hit, lag


def exact(n_frames: int, low: int, high: int) -> type:
    """The type in which sums over frames are whole numbers."""
    return np.float32 if (n_frames + high - low) * max(abs(low), abs(high), 1) < 1 << 24 else np.float64


def pair_blocks(spikes: DataFrame, recordings: DataFrame, key: list[str], each: Callable[..., Iterator[pa.RecordBatch]], schema, skip: DataFrame | None = None, rates: DataFrame | None = None, offsets=None) -> DataFrame:
    """Rows of ``each(first, second, names)`` for all unordered pairs of parts of a recording, a part with itself among them.

    ``first`` and ``second`` are ``Side``s (the same one for a part with itself); ``names``
    are the values of ``key``. ``offsets`` is a column of an array for each cell.
    """
    held = spikes.where("cell is not null and frame is not null").select(*key, "cell", "frame")
    what = [F.sort_array(F.collect_list("frame")).alias("frames")]
    if skip is not None:
        gone = skip.select("recording_id", "frame").distinct().withColumn("gone", F.lit(True))
        held = held.join(gone, ["recording_id", "frame"], "left").withColumn("s", F.struct("frame", F.col("gone").isNull().alias("searched")))
        what = [F.sort_array(F.collect_list("s")).alias("s")]
    trains = held.groupBy(*key, "cell").agg(*what)
    if skip is not None:
        trains = trains.select(*key, "cell", F.col("s.frame").alias("frames"), F.col("s.searched").alias("searched"))
    if rates is not None:
        trains = trains.join(rates.select("recording_id", "cell", F.col("rate").cast("double").alias("rate")), ["recording_id", "cell"], "left")
    trains = trains.join(F.broadcast(recordings.select("recording_id", "n_frames")), "recording_id")
    if offsets is not None:
        trains = trains.withColumn("offsets", offsets)
    trains = durable(trains)
    carried = [c for c in trains.columns if c not in (*key, "n_frames")]
    counts = trains.groupBy(*key, "n_frames").agg(F.count("*").alias("n"), F.sum(F.size("frames") + 8).alias("held"))  # a row a raster
    wide = F.least(F.lit(WIDE), F.ceil(F.col("n") / LEAST))
    many = durable(counts.select(*key, F.greatest(wide, F.ceil(F.col("held") / SPIKES)).cast("int").alias("many")))
    pairs = many.agg(F.sum(F.col("many") * (F.col("many") + 1) / 2)).first()[0] or 1
    dealt = trains.join(F.broadcast(many), key).withColumn("block", F.pmod(F.xxhash64("cell"), F.col("many")).cast("int"))
    blocks = dealt.groupBy(*key, "n_frames", "many", "block").agg(F.collect_list(F.struct(*carried)).alias("rows"))
    packed = T.StructType([*[blocks.schema[c] for c in (*key, "n_frames", "many", "block")], T.StructField("rows", T.BinaryType())])
    sent = blocks.mapInArrow(_packed, packed).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    sent = sent.select(*key, "n_frames", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "rows")
    # a block that has got no cell meets nobody: with it the other side stays alone
    met = sent.repartition(int(min(4 * max(pairs, 1), TASKS)), *key, "a", "b").sortWithinPartitions(*key, "a", "b", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in (*key, "n_frames", "a", "b", "block")}
                block = parts(unpack(batch.column("rows")[i].as_buffer()), int(r["n_frames"]))
                names = {c: r[c] for c in key}
                pair = (*names.values(), r["a"], r["b"])
                if r["a"] == r["b"]:
                    for j, first in enumerate(block):
                        for second in block[j:]:
                            yield from each(first, second, names)
                elif waiting is not None and waiting[0] == pair:
                    for first in waiting[1]:
                        for second in block:
                            yield from each(first, second, names)
                    waiting = None
                else:
                    waiting = (pair, block)

    return met.mapInArrow(run, schema)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("rows")
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).set_column(at, "rows", pa.array([pack(batch.column(at)[i].values)], pa.binary()))


def strips(first: Side, second: Side) -> Iterator[tuple[Side, Side, bool]]:
    """Both directions of a pair of blocks, or the one of a block with itself."""
    yield first, second, first is second
    if first is not second:
        yield second, first, False


def products(src: Side, dst: Side, low: int, high: int, same: bool, lags: bool = True, own: np.ndarray | None = None, other: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """(first row, counts, sums of lags) of strips of the source's cells; a cell with itself has 0."""
    if not lags and src.thin:
        yield from _sums(src, dst, low, high, same, own, other)
        return
    t, x = src.sources(own)
    hit, lag = follows(dst.raster(other), t, low, high, lags)
    kind = exact(src.n_frames, low, high)
    x, hit = x.astype(kind, copy=False), hit.astype(kind, copy=False).T
    lag_t = lag.astype(kind, copy=False).T if lags else None
    for top in range(0, len(src), STRIP):
        part = x[top : top + STRIP]
        n = part @ hit
        if same:
            n[np.arange(len(part)), np.arange(top, top + len(part))] = 0
        yield top, n, part @ lag_t if lags else None


def _sums(src: Side, dst: Side, low: int, high: int, same: bool, own: np.ndarray | None, other: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, None]]:
    """The same of cells with few spikes: who follows in the frames of a cell's spikes, added up byte by byte."""
    t, to = src.places(own)
    hit = np.ascontiguousarray(follows(dst.raster(other), t, low, high, False)[0].T).view(np.uint8)
    first = np.searchsorted(src.at, np.arange(len(src) + 1))
    rows = np.empty((np.diff(first).max(initial=0), len(dst)), np.uint8)
    for top in range(0, len(src), STRIP):
        n = np.empty((min(STRIP, len(src) - top), len(dst)), np.uint8)
        for i in range(len(n)):
            at = to[first[top + i] : first[top + i + 1]]
            seen = np.take(hit, at, axis=0, out=rows[: len(at)], mode="clip")  # nothing is outside; other modes make a copy
            np.add.reduce(seen, axis=0, dtype=np.uint8, out=n[i])
        if same:
            n[np.arange(len(n)), np.arange(top, top + len(n))] = 0
        yield top, n, None
