"""Toxicity by compression distance with two zstandard dictionaries.

Both dictionaries are assembled from labelled text of their class (zstandard's own
trainer, which keeps what is frequent in either class, tells the classes apart far less
well, see the README). The ordinary one holds the commonest
words of ordinary documents; the toxic one shares them (toxic documents hold them too)
and ends in the words that begin with a learned mark, a word beginning met in toxic
documents and hardly elsewhere, where the ordinary one has further ordinary words. A text is cut into windows of a few words. A window's distance is its
compressed length under the ordinary dictionary less that under the toxic one. A
document's score is a calibrated logistic function of its largest window distances
and of the counts and shares of windows at or over fixed distances.

Defined cases: a null, empty or wordless text has no windows and gets the score of all
zero distances; repeated rows and null ids are scored row by row; without labels of
both classes every score is the share of toxic labels (0 without any); an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.llm.common import table

#: Labelled rows used for fitting at most, by class.
MAX_TOXIC, MAX_ORDINARY = 3_000, 6_000
#: Bytes of text of these rows at most, by class.
MAX_BYTES = 64 << 20
WINDOW_WORDS = 4
LEVEL = 9
COMMON_BYTES = 8_000
#: Distances (bytes) at which windows are counted; the weights of the counts are calibrated.
CUTS = (2, 3, 4, 5, 6)
BATCH = 4_096


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def windows(text: str | None, size: int = WINDOW_WORDS) -> list[bytes]:
    w = (text or "").lower().split()
    return [(" " + " ".join(w[i : i + size])).encode() for i in range(0, len(w), size)]


def _own_words(text: str) -> set[str]:
    return {x.strip(".,;:!?\"'()") for x in text.lower().split()} - {""}


def _beginnings(words: set[str]) -> set[str]:
    return {" " + w[:n] for w in words for n in range(3, 8) if len(w) >= n}


def _fill(words: list[str], limit: int) -> bytes:
    """The words, first ones last (nearest to the text), in at most ``limit`` bytes."""
    out, size = [], 0
    for w in words:
        size += len(w.encode()) + 1
        if size > limit:
            break
        out.append(" " + w)
    return "".join(reversed(out)).encode()


def find_marks(toxic: list[set[str]], ordinary: list[set[str]], cover: int = 4, min_lift: float = 20.0) -> list[str]:
    """Word beginnings that mark toxic documents: greedily those that most often raise a document's number of marks, up to ``cover``."""
    copies = {tuple(sorted(w)): w for w in toxic}  # texts of the same words count once
    docs = [_beginnings(copies[k]) for k in sorted(copies)]
    tox, ordi = Counter(p for d in docs for p in d), Counter()
    for w in ordinary:
        ordi.update(_beginnings(w))
    lift = lambda p: ((tox[p] + 0.5) / (len(docs) + 1)) / ((ordi[p] + 0.5) / (len(ordinary) + 1))
    left = [p for p, n in tox.items() if n >= max(3, 0.01 * len(docs)) and lift(p) >= min_lift]
    where = {p: np.array([i for i, d in enumerate(docs) if p in d]) for p in left}
    need, marks = np.full(len(docs), cover), []
    while left:
        gain = {p: int((need[where[p]] > 0).sum()) * math.log(lift(p)) * (1 + len(p) / 20) for p in left}
        best = max(left, key=lambda p: (gain[p], p))
        if (need[where[best]] > 0).sum() < max(3, 0.003 * len(docs)):
            break
        need[where[best]] -= 1
        marks.append(best)
        left = [p for p in left if not p.startswith(best) and not best.startswith(p)]
    return marks


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionary contents: common words of ordinary text, then as many bytes of further ordinary or of marked toxic words."""
    tox, ordi = [_own_words(t) for t in toxic], [_own_words(t) for t in ordinary]
    marks = tuple(m[1:] for m in find_marks(tox, ordi))
    ranked = lambda c: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))]
    marked = ranked(Counter(w for d in tox for w in d if w.startswith(marks)) if marks else Counter())
    common = ranked(Counter(x.strip(".,;:!?\"'()") for t in ordinary for x in t.lower().split()))
    common = [w for w in common if w]
    base, special = _fill(common, COMMON_BYTES), _fill(marked, sum(len(w.encode()) + 1 for w in marked))
    further = (" " + " ".join(common[600:])).encode()[: len(special)]
    return base + further + b" ", base + special + b" "


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: list[float] = field(default_factory=list)
    prior: float = 0.0

    def __post_init__(self):
        self._c = None

    def __getstate__(self):
        return self.__dict__ | {"_c": None}

    def _compressors(self):
        if self._c is None:
            self._c = []
            for content in (self.ordinary, self.toxic):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                p = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=len(content), write_content_size=0, write_dict_id=0)
                d.precompute_compress(compression_params=p)
                self._c.append(zstandard.ZstdCompressor(compression_params=p, dict_data=d))
        return self._c

    def distances(self, parts: list[bytes]) -> np.ndarray:
        a, b = ([len(c.compress(p)) for p in parts] for c in self._compressors())
        return np.array(a, np.int64) - np.array(b, np.int64)

    def summary(self, texts: list[str | None]) -> np.ndarray:
        """The three largest distances, counts (log) of windows at or over each cut and shares of three cuts, for each text."""
        top = np.zeros((len(texts), 3))
        over, n = np.zeros((len(texts), len(CUTS))), np.zeros(len(texts))

        def add(i: int, d: np.ndarray) -> None:
            top[i] = np.sort(np.concatenate([top[i], d]))[::-1][:3]
            over[i] += (d[:, None] >= CUTS).sum(0)
            n[i] += len(d)

        for i, t in enumerate(texts):
            w = windows(t)
            for at in range(0, len(w), BATCH):
                add(i, self.distances(w[at : at + BATCH]))
        return np.hstack([top, np.log1p(over), 10 * over[:, 1:4] / np.maximum(n, 1)[:, None]])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.prior)
        x = self.summary(texts)
        return 1 / (1 + np.exp(-(x @ np.array(self.weights[:-1]) + self.weights[-1])))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 0.05) -> np.ndarray:
    """Newton steps on the class-weighted, lightly penalised log loss."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - y)) + ridge * w
        h = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY, max_bytes: int = MAX_BYTES) -> Model:
    """Learn from at most ``max_toxic`` and ``max_ordinary`` labelled rows outside the held-out fold, and ``max_bytes`` of each class, chosen by hashed id."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").alias("__y"))
    ids = None
    for y, n in ((1, max_toxic), (0, max_ordinary)):
        one = known.where(F.col("__y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        ids = one if ids is None else ids.union(one)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "__y")
    upto = W.partitionBy("__y").orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("__upto", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(upto)).where(F.col("__upto") <= max_bytes).drop("__upto").toPandas()
    rows = rows.sort_values(["doc_id", "__y", "text"], na_position="first")
    y = rows["__y"].to_numpy()
    texts = [t or "" for t in rows["text"]]
    if not len(y) or y.min() == y.max():
        return Model(prior=float(y.mean()) if len(y) else 0.0)
    # dictionaries from two thirds, calibration on the rest
    third = np.arange(len(y)) % 3 == 0
    pick = lambda cls: [t for t, c, hold in zip(texts, y, third, strict=True) if c == cls and not hold]
    base, toxic = train_dictionaries(pick(1), pick(0))
    model = Model(base, toxic)
    rest, yr = [t for t, h in zip(texts, third, strict=True) if h], y[third]
    x = model.summary(rest)
    model.weights = [float(v) for v in _logistic(x, yr)]
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                s = model.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
