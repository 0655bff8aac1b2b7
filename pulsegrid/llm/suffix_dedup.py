"""Suffix-array deduplication of repeated byte strings across documents.

Every byte covered by a ``length``-byte string that starts anywhere else in the corpus
(the same document included) is removed. The suffix array is sparse: each window of
``length`` bytes has one anchor, the position of its smallest ``gram``-byte fingerprint,
and equal windows have equal anchors at equal offsets. Anchors whose fingerprint occurs
once are dropped; for each other fingerprint the texts to the right of its anchors, and
those to the left read backwards, are suffix-sorted by deep-shallow sorting: multikey
quicksort to a shallow depth, then a blind trie for each group that still ties. Common
prefixes of neighbours in both orders give, for each anchor, the windows that recur.

Equal texts are one content. A content is searched once; where two documents or more
share one of ``length`` bytes or more, all of it goes.

Groups of over ``giant`` anchors do not meet in one task: their windows are counted by
128-bit digests with partial aggregation.

Defined cases: a null text is empty; a text of under ``length`` bytes loses nothing;
rows with null or repeated ids are judged row by row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.llm.common import stage, table
from pulsegrid.llm.textkernel import mix, slices, string_parts

LENGTH, GRAM, SHALLOW, GIANT = 400, 32, 32, 50_000
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(1 << max(16, int(n - 1).bit_length()), base)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def anchors(buf: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint of each position, window starts inside one text, anchor of each such window)."""
    n = len(buf)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power(_P, n), out=total[1:])
    h = mix((total[gram:] - total[:-gram]) * _power(_PINV, n - gram + 1))
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    low = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal ones is the smallest
    width, have, m = length - gram + 1, 1, low
    while have < width:  # running minimum of ``width`` by doubling
        step = min(have, width - have)
        m = np.minimum(m[: len(m) - step], m[step:])
        have += step
    at = (m & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    owner = np.searchsorted(off, np.arange(len(at)), "right") - 1
    starts = np.flatnonzero(np.arange(len(at)) + length <= off[np.minimum(owner + 1, len(off) - 1)])
    return h, starts, at[starts]


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class BlindTrie:
    """Orders strings by the characters that tell them apart: a node has a depth and children by one byte."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings

    def _leaf(self, node):
        while isinstance(node, list):
            node = next(iter(node[1].values()))
        return node

    def order(self, ids: list[int]) -> list[int]:
        same: dict[int, list[int]] = {ids[0]: [ids[0]]}
        root = ids[0]  # a leaf is an id, an inner node [depth, {byte or -1: child}]
        for i in ids[1:]:
            s = self.strings[i]
            node = root
            while isinstance(node, list):  # blind descent
                node = node[1].get(s[node[0]] if node[0] < len(s) else -1, self._first(node))
            other = self.strings[self._leaf(node)]
            d = common(s, other)
            if d == len(s) == len(other):
                same[self._leaf(node)].append(i)
                continue
            same[i] = [i]
            parent, key, node = None, None, root
            while isinstance(node, list) and node[0] < d:
                parent, key = node, s[node[0]]
                node = node[1][key]
            c = s[d] if d < len(s) else -1
            if isinstance(node, list) and node[0] == d:
                node[1][c] = i
            else:
                far = self.strings[self._leaf(node)]
                new = [d, {c: i, (far[d] if d < len(far) else -1): node}]
                if parent is None:
                    root = new
                else:
                    parent[1][key] = new
        return [x for leaf in self._walk(root) for x in same[leaf]]

    def _first(self, node):
        return next(iter(node[1].values()))

    def _walk(self, root) -> Iterator[int]:
        stack = [root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                yield node


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Sorted order of the strings."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        ids, d = stack.pop()
        if len(ids) < 2:
            out.extend(ids)
        elif d >= shallow:
            out.extend(BlindTrie(strings).order(ids))
        else:  # multikey quicksort, eight bytes as one character
            words = [strings[i][d : d + 8] for i in ids]
            pivot = words[len(ids) // 2]
            less, equal, more = [], [], []
            for i, w in zip(ids, words, strict=True):
                (less if w < pivot else more if w > pivot else equal).append(i)
            stack.append((more, d))
            stack.append((equal, d + 8 if len(pivot) == 8 else shallow))
            stack.append((less, d))
    return out


def covered(group: list[tuple[bytes, int]], length: int) -> list[tuple[int, int] | None]:
    """For each (context, anchor offset in it): how far left and right of the anchor recurring windows reach."""
    m = len(group)
    right = [c[a:] for c, a in group]
    left = [c[:a][::-1] for c, a in group]
    if m == 2:
        lo, hi = common(left[0], left[1]), common(right[0], right[1])
        return [(min(lo, length), min(hi, length)) if lo + hi >= length else None] * 2
    orders, gaps = [], []
    for s in (left, right):
        o = deep_shallow(s)
        orders.append(np.array(o))
        gaps.append(np.array([0] + [common(s[x], s[y]) for x, y in zip(o, o[1:])]))
    best = np.full((m, 2), -1)
    if m <= 256:
        both = []
        for o, g in zip(orders, gaps, strict=True):
            p = np.full((m, m), 1 << 30)
            for x in range(m - 1):  # smallest gap between x and each later one
                p[o[x], o[x + 1 :]] = p[o[x + 1 :], o[x]] = np.minimum.accumulate(g[x + 1 :])
            both.append(p)
        np.fill_diagonal(both[0], 0)
        np.fill_diagonal(both[1], 0)
        ok = both[0] + both[1] >= length
        for k in (0, 1):
            best[:, k] = np.where(ok, np.minimum(both[k], length), -1).max(1)
    else:
        rank = np.empty((2, m), np.int64)
        for o in range(length):  # windows that begin o bytes left of the anchor
            for k, need in ((0, o), (1, length - o)):
                rank[k][orders[k]] = np.cumsum(gaps[k] < need)
            key = rank[0] * (m + 1) + rank[1]
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
            # texts too short for this window only tie with themselves
            at = at[(np.array([len(left[i]) for i in at], int) >= o) & (np.array([len(right[i]) for i in at], int) >= length - o)]
            best[at, 0] = np.maximum(best[at, 0], o)
            best[at, 1] = np.maximum(best[at, 1], length - o)
    return [(int(a), int(b)) if a >= 0 else None for a, b in best]


def _content() -> object:
    return F.unhex(F.substring("sha", 1, 32))


def removed_spans(docs: DataFrame, base: DataFrame, length: int = LENGTH, gram: int = GRAM, giant: int = GIANT) -> DataFrame:
    """(content, start, stop): spans of recurring windows, by content (the first 16 bytes of its SHA-256)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = string_parts(b.column(0))
            for i, j in slices(off):
                part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                h, _, at = anchors(part, o, length, gram)
                at = np.unique(at)
                owner = np.searchsorted(o, at, "right") - 1
                ids = [hashlib.sha256(part[o[x] : o[x + 1]].tobytes()).digest()[:16] for x in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[at].view(np.int64)), pa.array([ids[x] for x in owner], pa.binary()), pa.array(at - o[owner], pa.int64())], names=["h", "content", "pos"]
                )

    found = docs.select("text").where(F.octet_length("text") >= length).mapInArrow(find, "h long, content binary, pos long")
    by_h = W.partitionBy("h")
    place = F.struct("content", "pos")
    met = found.withColumn("lo", F.min(place).over(by_h)).withColumn("hi", F.max(place).over(by_h)).where("lo <> hi")
    met = stage(met.select("h", "content", "pos").distinct(), "anchors")
    big = stage(met.groupBy("h").count().where(F.col("count") > giant).select("h"), "giant")
    reps = base.groupBy("sha").agg(F.min("doc_id").alias("rep")).select("rep", _content().alias("content"))
    wanted = met.groupBy("content").agg(F.collect_set("pos").alias("at")).join(reps, "content").withColumnRenamed("content", "wanted")
    wanted = stage(wanted, "wanted")
    if met.count() <= 500_000:  # 8 bytes and a share of 40
        wanted = F.broadcast(wanted)
    texts = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).withColumn("content", _content())
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("content") == F.col("wanted"))).select("content", "text", "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = string_parts(b.column(1))
            ids, places = b.column(0).to_pylist(), b.column(2)
            for i, j in slices(off):
                rows = []
                for x in range(i, j):
                    part = buf[off[x] : off[x + 1]]
                    h, starts, at = anchors(part, np.array([0, len(part)]), length, gram)
                    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, int)
                    want = set(places[x].as_py())
                    raw = part.tobytes()
                    for lo, hi in zip(first, np.append(first[1:], len(at)) - 1, strict=True):
                        p = int(at[lo])
                        if p in want:
                            s = int(starts[lo])
                            rows.append((int(h[p].view(np.int64)), ids[x], p, p - s, raw[s : int(starts[hi]) + length]))
                col = lambda k, t: pa.array([r[k] for r in rows], t)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([col(0, pa.int64()), col(1, pa.binary()), col(2, pa.int64()), col(3, pa.int64()), col(4, pa.binary())], names=["h", "content", "pos", "a", "ctx"])

    contexts = texts.mapInArrow(cut, "h long, content binary, pos long, a long, ctx binary")

    def sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, h = {}, None

        def done() -> pa.RecordBatch | None:
            if len(rows) < 2:
                return None
            keys = list(rows)
            out = [(c, p - r[0], p + r[1]) for (c, p), r in zip(keys, covered([rows[k] for k in keys], length), strict=True) if r]
            if not out:
                return None
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64())], names=["content", "start", "stop"])

        for b in batches:
            for x, c, p, a, ctx in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if x != h:
                    if (r := done()) is not None:
                        yield r
                    rows, h = {}, x
                rows[c, p] = (ctx, a)
        if (r := done()) is not None:
            yield r

    spans = "content binary, start long, stop long"
    if not big.take(1):
        return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(sort_groups, spans)
    contexts = stage(contexts, "contexts")
    usual = contexts.join(big, "h", "left_anti").repartition("h").sortWithinPartitions("h").mapInArrow(sort_groups, spans)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, c, p, a, ctx in zip(*(col.to_pylist() for col in b.columns), strict=True):
                starts = range(len(ctx) - length + 1)
                w = [hashlib.blake2b(ctx[s : s + length], digest_size=16).digest() for s in starts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h] * len(w), pa.int64()), pa.array([c] * len(w), pa.binary()), pa.array([p - a + s for s in starts], pa.int64()), pa.array(w, pa.binary())],
                    names=["h", "content", "start", "w"],
                )

    each = stage(contexts.join(big, "h", "left_semi").mapInArrow(windows, "h long, content binary, start long, w binary").distinct(), "windows")
    twice = each.groupBy("h", "w").agg(F.count("*").alias("n")).where("n > 1").select("h", "w")
    more = each.join(twice, ["h", "w"]).select("content", "start", (F.col("start") + length).alias("stop"))
    return usual.union(more)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, giant: int = GIANT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = stage(own.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "base")
    spans = stage(removed_spans(docs, base, length, gram, giant).distinct(), "spans")
    contents = base.groupBy("sha", "n_bytes").agg(F.count("*").alias("m"), F.min("doc_id").alias("rep"))
    single = contents.where("m = 1").select("rep", _content().alias("c"))
    lists = spans.groupBy("content").agg(F.collect_list(F.struct("start", "stop")).alias("s")).join(single, F.col("content") == F.col("c")).select("rep", "c", "s")
    lists = stage(lists, "lists")
    if lists.count() <= 100_000:
        lists = F.broadcast(lists)
    texts = own.withColumn("sha", F.sha2("text", 256)).join(lists, F.col("doc_id").eqNullSafe(F.col("rep")) & (_content() == F.col("c"))).select("sha", "text", "s")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for sha, text, s in zip(*(col.to_pylist() for col in b.columns), strict=True):
                raw, kept, at, gone, n = text.encode(), [], 0, 0, 0
                stop = -1
                for x in sorted((x["start"], x["stop"]) for x in s):
                    if x[0] > stop:
                        n += 1
                        kept.append(raw[at : x[0]])
                    lo = max(x[0], stop)
                    gone += max(0, x[1] - lo)
                    stop = at = max(stop, x[1])
                kept.append(raw[at:])
                rows.append((sha, gone, n, hashlib.sha256(b"".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["sha", "gone", "runs", "kept"])

    cut = texts.mapInArrow(remove, "sha string, gone long, runs long, kept string")
    out = base.join(contents.select("sha", "m"), "sha").join(cut, "sha", "left")
    whole = (F.col("m") > 1) & (F.col("n_bytes") >= length)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT r, doc_id, h, length(h) // 2 AS n_bytes FROM d),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS g FROM (SELECT r, h, unnest(range(n_bytes - 399)) AS i FROM n WHERE n_bytes >= 400) x),
c AS (SELECT r, i FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)),
o AS (SELECT r, i, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) > 400 AS opens FROM c),
q AS (SELECT r, i, sum(opens::INT) OVER (PARTITION BY r ORDER BY i) AS span FROM o),
s AS (SELECT r, span, min(i) AS a, max(i) + 400 AS b FROM q GROUP BY r, span),
k AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM s),
t AS (
  SELECT n.r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM k JOIN n USING (r) GROUP BY n.r)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM n LEFT JOIN t USING (r)
"""
