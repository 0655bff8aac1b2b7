"""N-gram Jaccard join by signature trees.

A document is its set of distinct word shingles. Equal sets are one class; only class
representatives are joined. Two sets x, y (x the smaller) with Jaccard >= t differ in at
most d = floor((1 - t) / t * |x|) shingles, so when x fills more than d parts of the shingle
space, some part is equal in both. Hashes of the parts, dealt per size level, bring all
linked sets of a level into one candidate block (a document's number of keys follows its
size, and in all but the smallest sets a key needs two or three shingles of the set). Linked
sets share all filled parts but d; those that meet fewer go before blocks are made.

Each block is joined by a signature tree: leaves are sets ordered by smallest shingles,
inner nodes hold the OR of their children's token bitmaps, the range of sizes and the
largest number of tokens that share bits. A dual traversal descends only into node
pairs whose largest possible overlap reaches the threshold and that are not yet known
to be in one component. It runs twice: over the bitmaps alone, which splits the blocks, then over
the sets of what is left, where leaf pairs are verified exactly. Large blocks are cut into
chunks of bounded total size. Each chunk is joined by itself, with a few members of other
chunks as hubs; then only members outside the block's largest component (itself one
component already) visit the other chunks.

Defined cases: null, empty or wordless texts have an empty set and are linked with
nothing; rows with a null id get a null component (they can't be named) but keep their
size; repeated rows share a component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.llm.common import bounded, connected_components, fresh, release, stage, table
from pulsegrid.llm.textkernel import Words, mix, shingles, slices, string_parts

#: Shingles of a chunk of a block on average; two chunks' worth meet in one task.
CHUNK_SHINGLES = 2_000_000
#: Bytes of token bitmaps of a chunk of a block on average.
MAP_BYTES = 16 << 20
#: A key is hot if so many sets of one hash in 64 have it.
HOT_KEY = 1_000
#: How often sets that meet too few others' keys go, and the keys that only they had.
ROUNDS = 2
#: Members of a large block that every chunk of it meets first.
HUBS = 64
#: Sets with keys that a task remembers, so that copies within it repeat no keys.
SEEN = 500_000
_A, _B, _C = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC13FA9A902A6328F))


def sets_of(buf: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice."""
    w = Words(buf, off, lower=True)
    h = w.hashes()
    s = shingles(h, k)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= k:
            yield np.unique(s[a : b - k + 1])
        elif b > a:
            yield mix(shingles(h[a:b], k)[:1] ^ _A + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return tuple(int(mix(s ^ c).sum(dtype=np.uint64).astype(np.int64)) for c in (_A, _B))


class Levels:
    """Size levels of ratio 1.5 and the parts that the shingle space has on each."""

    def __init__(self, num: int, den: int, most: int = 1 << 40):
        self.num, self.den = num, den
        self.low = [1]
        while self.low[-1] < most:
            self.low.append(self.low[-1] * 3 // 2 + 1)

    def differences(self, size: int) -> int:
        return (self.den - self.num) * size // self.num

    def keys(self, s: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, int, int]]:
        """(level, keys, weak keys, need, shared) on each level of a set.

        A set with q parts of ``least`` shingles or more, and at most d differences from a
        linked partner, shares ``need`` = q - d of those with it. Other filled parts are weak
        keys: they count only where some member of their group has no such bound. ``shared``
        is how many of its keys a linked partner has in any case: without such a bound all
        parts of the set count, and all but d of those that are filled are equal.
        """
        n = len(s)
        own = int(np.searchsorted(self.low, n, "right")) - 1
        out = []
        for level in (own, own - 1):
            if level < 0 or level < own and n > (self.low[own] - 1) * self.den // self.num:
                continue
            top = self.low[level + 1] - 1
            d = self.differences(top)
            if d == 0:  # linked only if equal
                out.append((level, np.zeros(0, np.uint64), np.zeros(0, np.uint64), 1, 1))
                continue
            parts, least, salts = (2 * d + 6, 1, 2) if top <= 25 else (2 * d, 2, 2) if top <= 60 else (d + d // 4 + 10, 2, 1) if top <= 600 else (d + d // 4 + 20, 3, 1)
            full, weak, need, filled = [], [], 0, 0
            for salt in range(salts):
                t = mix(s ^ _C) if salt else s
                part = ((t >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                part = part[order]
                first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                sums = np.add.reduceat(mix(t[order] ^ _B), first)
                key = mix(sums ^ mix((np.uint64(level * 4 + salt + 1) << np.uint64(32)) + part[first].astype(np.uint64)))
                enough = np.diff(np.append(first, n)) >= least
                full.append(key[enough])
                weak.append(key[~enough])
                need += max(0, int(enough.sum()) - self.differences(min(n, top)))
                filled += max(0, len(key) - self.differences(min(n, top)))
            # of a pair of this level the smaller has its size, and its bound is enough for both
            if n > top:
                need = max(need, 1)
            out.append((level, np.concatenate(full), np.concatenate(weak), need, need or max(filled, 1)))
        return out


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """The set's tokens in ``bits`` bits, as 64-bit words."""
    flag = np.zeros(bits, np.uint8)
    flag[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flag).view(np.uint64)


def level_bits(low: int) -> int:
    """Bits of the maps of a size level that begins at ``low``: about four a token."""
    return 1 << int(np.clip(np.ceil(np.log2(4 * low + 1)), 9, 16))


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def signatures(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, h1, h2, level, own, need, shared, keys, weak, map, least): a row for each row of ``docs`` (``own``) and each further level.

    A set repeated within a task has keys once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = Levels(num, den), set()
        none = np.zeros(0, np.uint64)
        for b in batches:
            buf, off = string_parts(b.column(1))
            ids = b.column(0).to_pylist()
            for i, j in slices(off):
                rows, keys, weak, maps = [], [], [], []
                for at, s in enumerate(sets_of(buf[off[i] : off[j]], off[i : j + 1] - off[i], k), i):
                    a, c = identity(s)
                    new = a not in seen and len(s)
                    for level, full, rest, need, shared in levels.keys(s) if new else [(0, none, none, 1, 1)]:
                        own = not rows or rows[-1][8] != at
                        rows.append((ids[at], len(s), a, c, level, own, need, shared, at, int(s[:1].view(np.int64).sum())))
                        keys.append(full)
                        weak.append(rest)
                        maps.append(bitmap(s, level_bits(levels.low[level])).tobytes() if len(full) + len(rest) else None)
                    if len(seen) < SEEN:
                        seen.add(a)
                col = lambda i, t: pa.array([r[i] for r in rows], t)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [*(col(i, pa.int64()) for i in range(4)), col(4, pa.int32()), col(5, pa.bool_()), col(6, pa.int32()), col(7, pa.int32()), _lists(keys), _lists(weak), pa.array(maps, pa.binary()), col(9, pa.int64())],
                    names=["doc_id", "n", "h1", "h2", "level", "own", "need", "shared", "keys", "weak", "map", "least"],
                )

    schema = "doc_id long, n long, h1 long, h2 long, level int, own boolean, need int, shared int, keys array<long>, weak array<long>, map binary, least long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


class SignatureTree:
    """Finds a spanning set of the links among sets: (i, j) pairs with num <= den * Jaccard."""

    FAN = 4
    FRONT = 1 << 15

    def __init__(self, sets: list[np.ndarray] | None, num: int, den: int, maps: np.ndarray | None = None, size: np.ndarray | None = None, least: np.ndarray | None = None, known: np.ndarray | None = None):
        """Of sets, or of ``maps`` with the sets' sizes and smallest tokens: then every possible pair counts as a link. ``known`` has components found before."""
        self.num, self.den = num, den
        if maps is None:
            size = np.array([len(s) for s in sets])
            bits = level_bits(int(np.median(size)))
            maps = np.array([bitmap(s, bits) for s in sets]).reshape(len(sets), -1)
            least = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
        self.order = np.lexsort((size, least))
        self.sets = None if sets is None else [sets[i] for i in self.order]
        maps, size = maps[self.order], size[self.order]
        n = len(size)
        spare = size - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, size, size, spare)]
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, ex = self.levels[-1]
            at = np.arange(0, len(m), self.FAN)
            self.levels.append((np.bitwise_or.reduceat(m, at, 0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at)))
        self.root = np.arange(n)
        if known is not None and n:
            _, first, label = np.unique(np.asarray(known)[self.order], return_index=True, return_inverse=True)
            self.root = first[label]
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return int(i)

    def flat(self) -> np.ndarray:
        while (self.root[self.root] != self.root).any():
            self.root = self.root[self.root]
        return self.root

    def try_link(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a == b:
            return
        if self.sets is None:
            self.root[max(a, b)] = min(a, b)
            self.links.append((int(self.order[i]), int(self.order[j])))
            return
        x, y = sorted((self.sets[i], self.sets[j]), key=len)
        if len(x) * self.den < self.num * len(y) or not len(x):
            return
        at = np.searchsorted(y, x)
        both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
        if self.den * both >= self.num * (len(x) + len(y) - both):
            self.root[max(a, b)] = min(a, b)
            self.links.append((int(self.order[i]), int(self.order[j])))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Node pairs below which a link may exist."""
        m, lo, hi, ex = self.levels[level]
        ok = (hi[a] * self.den >= self.num * lo[b]) & (hi[b] * self.den >= self.num * lo[a])
        at = np.flatnonzero(ok)
        common = np.bitwise_count(m[a[at]] & m[b[at]]).sum(1, dtype=np.int64) + np.minimum(ex[a[at]], ex[b[at]])
        most = np.minimum(common, np.minimum(hi[a[at]], hi[b[at]]))
        ok[at] = (self.num + self.den) * most >= self.num * (lo[a[at]] + lo[b[at]])
        return ok

    def pure(self, level: int) -> np.ndarray:
        """The component of each node whose leaves are all in one, else -1."""
        r = self.flat()
        lo = hi = r
        for _ in range(level):
            at = np.arange(0, len(lo), self.FAN)
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
        return np.where(lo == hi, lo, -1)

    def run(self) -> list[tuple[int, int]]:
        n = len(self.root)
        i = np.arange(n - 1)
        for x in i[self.possible(0, i, i + 1)] if n > 1 else ():
            self.try_link(x, x + 1)
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            p = self.pure(level)
            keep = (p[a] != p[b]) | (p[a] < 0)
            a, b = a[keep], b[keep]
            keep = (a == b) & (level > 0) | self.possible(level, a, b)
            a, b = a[keep], b[keep]
            if level == 0:
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    if x != y:
                        self.try_link(x, y)
                continue
            below = len(self.levels[level - 1][0])
            f = np.arange(self.FAN)
            ca = np.repeat(a[:, None] * self.FAN + f, self.FAN, 1).ravel()
            cb = np.tile(b[:, None] * self.FAN + f, (1, self.FAN)).ravel()
            keep = (ca < below) & (cb < below) & (ca <= cb)
            ca, cb = ca[keep], cb[keep]
            for at in range(0, len(ca), self.FRONT):
                stack.append((level - 1, ca[at : at + self.FRONT], cb[at : at + self.FRONT]))
        return self.links


def _links_in_blocks(rows: DataFrame, limit: int, attach: Callable[[DataFrame], DataFrame], links: Callable[[pd.DataFrame], pd.DataFrame], hubs: int = HUBS) -> DataFrame:
    """(node, root): components of the links among the ``rows`` (node, block, weight and further columns) of each block.

    ``attach`` adds what ``links`` needs to rows with the columns block, a, b and known
    in place of weight; ``links`` gets the rows of one (block, a, b) and returns (u, v).
    """
    further = [c for c in rows.columns if c not in ("block", "weight")]
    large = stage(rows.groupBy("block").agg(F.ceil(F.sum("weight") / limit).cast("int").alias("chunks")).where("chunks > 1"), "large")
    chunk = lambda count, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(count)).cast("int")
    placed = rows.join(bounded(large), "block", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", chunk("chunks", 0))
    placed = stage(placed, "placed")
    nobody = F.lit(None).cast("long").alias("known")
    cells = placed.select("block", F.col("own").alias("a"), F.lit(0).alias("b"), *further, nobody)
    wide = bool(large.take(1))
    if wide:
        first = placed.where((F.col("chunks") > 1) & (F.col("own") < hubs)).groupBy("block", "own", "chunks").agg(F.min(F.struct(*further)).alias("hub"))
        guests = first.select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("a"), F.lit(0).alias("b"), "hub.*")
        cells = cells.union(guests.select("block", "a", "b", *further, nobody))
    run = lambda c: attach(c).groupBy("block", "a", "b").applyInPandas(links, "u long, v long")
    if not wide:
        return connected_components(run(cells))
    found = stage(run(cells), "links")
    joined = connected_components(found).withColumnRenamed("node", "member")
    known = placed.where("chunks > 1").join(joined, F.col("node") == F.col("member"), "left").withColumn("known", F.coalesce("root", "node")).drop("member", "root")
    known = stage(known, "known")
    size = known.groupBy("block", "known").agg(F.count("*").alias("m"))
    top = size.groupBy("block").agg(F.max(F.struct("m", "known"))["known"].alias("top"))
    guests = known.join(bounded(stage(top, "top")), "block").where("known <> top")
    guests = stage(guests, "guests")
    shares = stage(guests.groupBy("block").agg(F.ceil(F.sum("weight") / limit).cast("int").alias("shares")), "shares")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    shares = bounded(shares)
    guests = guests.join(shares, "block").withColumn("b", chunk("shares", 1)).select("block", every("chunks").alias("a"), "b", *further, "known")
    hosts = known.join(shares, "block").select("block", F.col("own").alias("a"), every("shares").alias("b"), *further, "known")
    more = run(guests.union(hosts))
    return connected_components(found.union(more))


def classes(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, chunk: int = CHUNK_SHINGLES, map_bytes: int = MAP_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    sig = stage(signatures(docs, k, num, den), "signatures")
    nodes = stage(sig.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    slim = stage(sig.where("own").select("doc_id", "n", "h1", "h2"), "slim")
    node = F.xxhash64("h1", "h2", "level")
    strong = sig.select(node.alias("node"), F.explode("keys").alias("key"))
    needed = stage(sig.where("need = 0").select(F.explode("weak").alias("key")).distinct(), "needed")
    weak = sig.select(node.alias("node"), F.explode("weak").alias("key")).join(bounded(needed), "key").select("node", "key")
    keyed = strong.union(weak)
    # keys of very many sets, known by the sets of one hash in 64, need no window to be known as shared
    some = keyed.where(F.pmod(F.xxhash64("node"), F.lit(64)) == 0).groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("low"), F.max("node").alias("high"))
    hot = stage(some.where((F.col("m") > HOT_KEY) & (F.col("low") != F.col("high"))).select("key"), "hot")
    by_key = W.partitionBy("key").orderBy("node")
    usual = keyed.join(bounded(hot), "key", "left_anti").select("node", "key", F.lag("node").over(by_key).alias("before"), F.lead("node").over(by_key).alias("after"))
    usual = usual.where("before <> node or after <> node").select("node", "key")
    met = stage(usual.union(keyed.join(bounded(hot), "key").select("node", "key")), "met")  # copies of a row only loosen the bound below
    # a set that meets fewer parts than any partner would share has no partner here; nor do larger sets among themselves
    bounds = sig.where("size(keys) > 0 or size(weak) > 0").select(node.alias("node"), "shared", "own").distinct()
    hubs, shared_keys = met.distinct(), None
    for _ in range(ROUNDS):
        if shared_keys is not None:
            hubs = hubs.join(shared_keys, "key").select("key", "node")
        alive = hubs.groupBy("node").agg(F.count("*").alias("n")).join(bounds, "node").where("n >= shared").select("node", "own")
        hubs = stage(hubs.join(alive, "node").select("key", "node", "own"), "alive")
        shared_keys = hubs.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.max("own").alias("any")).where("any and hub <> last").select("key", "hub")
    pairs = hubs.join(shared_keys, "key").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    blocks = stage(connected_components(pairs).withColumnRenamed("root", "block"), "blocks")
    maps = sig.where("map is not null").select("n", "h1", "h2", node.alias("node"), "map", "least").join(bounded(blocks), "node")
    maps = stage(maps.dropDuplicates(["node"]), "maps")
    release(sig, needed, hot, met)

    def join_maps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").reset_index(drop=True)
        bits = np.frombuffer(b"".join(pdf["map"]), np.uint64).reshape(len(pdf), -1)
        known = None if pdf["known"].isna().any() else pdf["known"].to_numpy()
        links = SignatureTree(None, num, den, bits, pdf["n"].to_numpy(), pdf["least"].to_numpy().view(np.uint64), known).run() if len(pdf) > 1 else []
        ids = pdf["node"].to_numpy()
        return pd.DataFrame({"u": [ids[i] for i, _ in links], "v": [ids[j] for _, j in links]}, dtype="int64")

    # first by the maps alone: what they can't rule out stays in one block, and only such documents' texts are read again
    rows = maps.select("node", "block", F.octet_length("map").alias("weight"))
    with_maps = lambda cells: cells.join(maps.select("node", "n", "map", "least"), "node")
    blocks = stage(_links_in_blocks(rows, map_bytes, with_maps, join_maps), "blocks")
    members = maps.select("n", "h1", "h2", "node").join(blocks, "node").join(nodes.where("rep is not null"), ["n", "h1", "h2"])
    members = stage(members.select(F.col("rep").alias("node"), F.col("root").alias("block"), F.col("n").alias("weight"), F.col("h1").alias("want")), "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")

    def join_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["node", "text"])
        sets, ids, known = [], [], []
        buf, off = string_parts(pa.array(pdf.text, pa.large_string()))
        reps, want, label = pdf.node.to_numpy(), pdf.want.to_numpy(), pdf.known.to_numpy()
        for i, j in slices(off):
            for at, s in enumerate(sets_of(buf[off[i] : off[j]], off[i : j + 1] - off[i], k), i):
                if identity(s)[0] == want[at]:
                    sets.append(s)
                    ids.append(reps[at])
                    known.append(label[at])
        links = SignatureTree(sets, num, den, known=None if pdf["known"].isna().any() else np.array(known)).run() if len(sets) > 1 else []
        return pd.DataFrame({"u": [ids[i] for i, _ in links], "v": [ids[j] for _, j in links]}, dtype="int64")

    with_texts = lambda cells: texts.join(bounded(stage(cells, "cells")), "node")
    joined = _links_in_blocks(members, chunk, with_texts, join_cell)
    named = nodes.join(joined, F.col("rep") == F.col("node"), "left").select("n", "h1", "h2", F.coalesce("root", "rep").alias("component_id"))
    out = slim.join(named, ["n", "h1", "h2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without those that have a linked row of smaller id; repeated rows stay once.

    Rows are told apart by their ids; where ids repeat or are null, by numbers given in
    order of id (null last) and text, so that no row goes for the text of another.
    """
    rows, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    row, name = fresh(docs, "__row", "__drop")
    own = rows == ids
    numbered = docs if own else stage(docs.orderBy(F.asc_nulls_last("doc_id"), F.xxhash64("text")).withColumn(row, F.monotonically_increasing_id()), "rows")
    at = "doc_id" if own else row
    c = stage(classes(numbered.select(F.col(at).alias("doc_id"), "text"), k, num, den), "components")
    drop = stage(c.where("component_id <> doc_id").select(F.col("doc_id").alias(name)), "drop")
    out = numbered.join(bounded(drop), numbered[at] == F.col(name), "left_anti")
    return out if own else out.drop(row).dropDuplicates()


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS g, len(w) >= 4 AS long FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0) x),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pr AS (SELECT a.r AS u, b.r AS v, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.long = b.long AND a.r < b.r GROUP BY a.r, b.r),
e AS (SELECT u, v FROM pr JOIN n a ON a.r = u JOIN n b ON b.r = v WHERE 100 * m >= 85 * (a.n + b.n - m)),
l AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach(u, v) AS (SELECT u, v FROM l UNION SELECT reach.u, l.v FROM reach JOIN l ON l.u = reach.v),
c AS (SELECT reach.u AS r, min(doc_id) AS low FROM reach JOIN d ON d.r = reach.v GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN d.doc_id IS NOT NULL THEN least(d.doc_id, coalesce(low, d.doc_id)) END AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r)
"""
