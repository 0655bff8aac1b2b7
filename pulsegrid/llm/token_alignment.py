"""Cross-tokenizer alignment: minimal groups of tokens of two tokenizers, and the links they make.

Tokens of A and B that overlap in their bytes are joined by an edge; the connected
components of that bipartite graph are exactly the minimal groups (both tokenizers end a
token where a component ends and nowhere within). Union-find over arrays finds them:
roots are hooked to the smaller root of an edge and paths are halved until no edge
joins two roots. A component's A tokens times its B tokens are its links, and a pair of
ids counts in how many documents it is linked.

Neither tokenizer makes a token across a place where a space follows a letter, digit or
ASCII mark (A cuts words before the space, B has no piece with a space after another
character; ``Aligner`` looks through B's pieces for one). So a text is aligned chunk by
chunk, and each different chunk once per task as far as its bounded memory holds it.
``tests`` compare this with whole texts.

Three steps, none of which holds the corpus: each document's figures and different pairs
are staged; the pairs are counted by a grouped sum; the most frequent pairs (at most
``HOT``, with their counts some 13 MB) are broadcast to be looked up, all other pairs meet
their counts by a join, and the parts are summed by document.

Defined cases: null and empty texts, and texts whose joined tokens differ from space +
text, have no tokens: zeros and ''. Rows are documents, also where ids repeat or are
null; an empty table gives no rows; other columns are ignored. Memory of a task follows
its longest text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import stage, table
from pulsegrid.llm.lexicon import most_frequent

#: Folder of the public vocabulary files, the same on all machines.
VOCABULARIES = "/opt/tokenizers"
#: Pairs whose counts are broadcast.
HOT = 1 << 20
#: Chunks, and bytes of them, that a task remembers.
KNOWN, KNOWN_BYTES = 200_000, 64 << 20
#: A chunk ends at a space after one of these characters; texts without other spaces are cut faster.
CUT = re.compile(r"(?<=[\w!-~]) ")
UNCUT = re.compile(r"(?:\A|[^\w!-~]) ")
#: Letters and marks that all Unicode versions class alike: here the faster library with A's ranks gives A's tokens.
PLAIN = re.compile(r"[\x00-\u024f]*\Z")
#: Fixed value: the words that byte-level vocabularies of A's kind cut a text into first.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARK = "▁"
SHIFT = 15  # bits of a B id in a pair


def union_find(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, for ``n`` nodes and edges (u, v)."""
    up = np.arange(n)
    while len(u):
        a, b = up[u], up[v]
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up, half := up[up]):
            up = half
    return up


def byte_of_mark() -> dict[str, int]:
    """The byte that each character of byte-level vocabularies stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Aligned chunks of one task: for each the figures, the listed groups and the linked pairs."""

    def __init__(self, folder: str):
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(f"{folder}/byte_bpe_50k.json")
        self.a.encode_special_tokens = True
        byte = byte_of_mark()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        # the merges of A are in the order of its ids, so these serve as ranks
        special = {i for i, t in self.a.get_added_tokens_decoder().items()}
        ranks = {x: i for i, x in enumerate(self.a_bytes) if i not in special}
        self.quick = tiktoken.Encoding("a", pat_str=WORD, mergeable_ranks=ranks, special_tokens={})
        self.b = SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id(MARK)
        self.whole = any(re.search(rf"[^{MARK}]{MARK}|[^ ] ", p) for p in pieces)
        self.a_len, self.b_len = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        # a token as it stands in the list of groups: before a comma, or last of its side
        self.said = [f"{i}{c}" for i in range(len(self.a_bytes)) for c in ",|"] + [f"{i}{c}" for i in range(len(self.b_bytes)) for c in ",;"]
        self.said_len = np.array(list(map(len, self.said)))
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.listed: list[str] = []
        self.good: list[bool] = []
        self.figures = np.zeros((0, 4), np.int64)
        #: the linked pairs of chunk k stand at first[k] .. first[k + 1]
        self.first = np.zeros(1, np.int64)
        self.pairs = self.times = np.zeros(0, np.int64)
        self.held = 0

    def chunks(self, text: str) -> list[str]:
        """The pieces of a text between the spaces that may end a chunk; each stands for a space and itself."""
        if self.whole:
            return [text]
        return CUT.split(text) if UNCUT.search(text) else text.split(" ")

    def _encoded(self, new: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        quick, a = self.quick.encode_ordinary, [[]] * len(new)
        slow = []
        for k, c in enumerate(new):
            if PLAIN.match(c):
                a[k] = quick(" " + c)
            else:
                slow.append(k)
        for k, e in zip(slow, self.a.encode_batch_fast([" " + new[k] for k in slow], add_special_tokens=False), strict=True):
            a[k] = e.ids
        b = self.b.encode(new, num_threads=1)
        for k, c in enumerate(new):
            if not c:  # nothing is put before nothing
                b[k] = [self.space]
        return a, b

    def _true(self, a: list[list[int]], b: list[list[int]], new: list[str]) -> list[bool]:
        """Whether a chunk's tokens give its own bytes on both sides."""
        text = [(" " + c).encode() for c in new]
        for ids, table_ in ((a, self.a_bytes), (b, self.b_bytes)):
            mine = [b"".join(map(table_.__getitem__, x)) for x in ids]
            if mine != text:
                return [b"".join(map(self.a_bytes.__getitem__, x)) == b"".join(map(self.b_bytes.__getitem__, y)) == t for x, y, t in zip(a, b, text, strict=True)]
        return [True] * len(new)

    def learn(self, new: list[str]) -> None:
        """Align chunks that are not known yet."""
        a, b = self._encoded(new)
        good = self._true(a, b, new)
        if not all(good):
            a, b = ([x if ok else [] for x, ok in zip(t, good, strict=True)] for t in (a, b))
        n_a, n_b = (np.array(list(map(len, t))) for t in (a, b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(t), np.int64, n.sum()) for t, n in ((a, n_a), (b, n_b)))
        end_a, end_b = np.cumsum(self.a_len[ids_a]), np.cumsum(self.b_len[ids_b])
        # one overlap for each stretch between two ends
        ends = np.union1d(end_a, end_b)
        u, v = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        root = union_find(len(ids_a) + len(ids_b), u, v + len(ids_a))
        root_a, root_b = root[: len(ids_a)], root[len(ids_a) :]
        # components stand one after the other on both sides, so their order numbers them alike
        of_a, of_b = (np.cumsum(np.append(True, r[1:] != r[:-1])[: len(r)]) - 1 for r in (root_a, root_b))
        n_groups = int(of_a[-1]) + 1 if len(of_a) else 0
        per_a, per_b = np.bincount(of_a, minlength=n_groups), np.bincount(of_b, minlength=n_groups)
        chunk_of_group = np.zeros(n_groups, np.int64)
        chunk_of_group[of_a] = np.repeat(np.arange(len(new)), n_a)
        by_chunk = lambda x=None: np.bincount(chunk_of_group, x, len(new)).astype(np.int64)
        figures = np.stack([n_a, n_b, by_chunk(), by_chunk(per_a * per_b)], 1)
        pair, times, chunk = self._links(ids_a, ids_b, of_a, of_b, chunk_of_group)
        self.listed += self._listed(ids_a, ids_b, of_a, of_b, per_a, per_b, n_a + n_b)
        self.at.update(zip(new, range(len(self.figures), len(self.figures) + len(new)), strict=True))
        self.good += good
        self.figures = np.concatenate([self.figures, figures])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(chunk, minlength=len(new)))])
        self.pairs, self.times = np.concatenate([self.pairs, pair]), np.concatenate([self.times, times])
        self.held += sum(map(len, new)) * 8 + 16 * len(pair)

    def _listed(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, per_a: np.ndarray, per_b: np.ndarray, n: np.ndarray) -> list[str]:
        """The groups of each chunk as text, each group closed by its semicolon."""
        behind_a, behind_b = np.cumsum(per_a), np.cumsum(per_b)
        said = np.empty(len(a) + len(b), np.int64)
        # a group's A tokens stand behind all tokens of earlier groups, its B tokens behind its A tokens as well
        said[np.arange(len(a)) + (behind_b - per_b)[of_a]] = 2 * a + (np.arange(len(a)) == behind_a[of_a] - 1)
        said[np.arange(len(b)) + behind_a[of_b]] = 2 * (len(self.a_bytes) + b) + (np.arange(len(b)) == behind_b[of_b] - 1)
        whole = "".join(map(self.said.__getitem__, said.tolist()))
        at = np.concatenate([[0], np.cumsum(self.said_len[said])])[np.concatenate([[0], np.cumsum(n)])].tolist()
        return [whole[i:j] for i, j in zip(at, at[1:], strict=False)]

    def _links(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, chunk_of_group: np.ndarray) -> tuple[np.ndarray, ...]:
        """(pair, times, chunk): different pairs of ids linked in each chunk, and how often; a group's repeated ids are multiplied, not expanded."""
        (ka, ca), (kb, cb) = (np.unique(g << 17 | x, return_counts=True) for g, x in ((of_a, a), (of_b, b)))
        start, stop = np.searchsorted(kb >> 17, ka >> 17), np.searchsorted(kb >> 17, ka >> 17, "right")
        left, right = np.repeat(np.arange(len(ka)), stop - start), _ranges(start, stop)
        pair = (ka[left] & 0x1FFFF) << SHIFT | (kb[right] & 0x1FFFF)
        key, at = np.unique(chunk_of_group[ka[left] >> 17] << 31 | pair, return_inverse=True)
        return key & 0x7FFFFFFF, np.bincount(at, ca[left] * cb[right], len(key)).astype(np.int64), key >> 31


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """start[0] .. stop[0] - 1, start[1] .. stop[1] - 1 and so on."""
    n = stop - start
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


def _documents(folder: str):
    """Arrow batches of (doc_id, text) to each document's figures, hash and pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, first, seen = Aligner(folder), TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for lo, hi in _parts(texts):
                if len(al.at) > KNOWN or al.held > KNOWN_BYTES:
                    al.forget()
                yield _aligned(al, ids.slice(lo, hi - lo), texts.slice(lo, hi - lo).to_pylist(), first + seen)
                seen += hi - lo

    return run


def _parts(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of some ``size`` bytes of text, or of one longer text."""
    import pyarrow.compute as pc

    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + size, "right")))
        yield lo, hi
        lo = hi


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<long>"


def _aligned(al: Aligner, ids: pa.Array, texts: list[str | None], row: int) -> pa.RecordBatch:
    chunks = [al.chunks(t) if t and MARK not in t else [] for t in texts]  # the mark never comes back as itself
    new = dict.fromkeys(c for cs in chunks for c in cs if c not in al.at)
    if new:
        al.learn(list(new))
    at = [list(map(al.at.__getitem__, cs)) for cs in chunks]
    at = [x if all(map(al.good.__getitem__, x)) else [] for x in at]
    hashes = [hashlib.sha256("".join(map(al.listed.__getitem__, x))[:-1].encode()).hexdigest() if x else "" for x in at]
    # each different chunk of a document, and how often
    n = np.array(list(map(len, at)))
    key, often = np.unique(np.repeat(np.arange(len(at)), n) << 32 | np.fromiter((i for x in at for i in x), np.int64, n.sum()), return_counts=True)
    doc, chunk = key >> 32, key & 0xFFFFFFFF
    figures = np.zeros((len(at), 4), np.int64)
    np.add.at(figures, doc, al.figures[chunk] * often[:, None])
    start, stop = al.first[chunk], al.first[chunk + 1]
    take, many = _ranges(start, stop), np.repeat(often, stop - start)
    key, place = np.unique(np.repeat(doc, stop - start) << 31 | al.pairs[take], return_inverse=True)
    times = np.bincount(place, al.times[take] * many, len(key)).astype(np.int64)
    off = pa.array(np.concatenate([[0], np.cumsum(np.bincount(key >> 31, minlength=len(at)))]), pa.int32())
    flat = lambda x, kind: pa.ListArray.from_arrays(off, pa.array(x, kind))
    names = ["n_a", "n_b", "n_groups", "n_links"]
    return pa.record_batch(
        {"row": pa.array(np.arange(row, row + len(texts))), "doc_id": ids.cast(pa.int64())} | {c: pa.array(figures[:, i]) for i, c in enumerate(names)} | {"groups_sha256": pa.array(hashes, pa.string()), "pairs": flat(key & 0x7FFFFFFF, pa.int32()), "times": flat(times, pa.int64())}
    )


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, docs): documents of each pair, summed over the pairs a task has in hand."""
    waiting: list[np.ndarray] = []

    def counted() -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(waiting), return_counts=True)
        waiting.clear()
        return pa.record_batch({"pair": pa.array(key, pa.int32()), "docs": pa.array(n, pa.int64())})

    for batch in batches:
        waiting.append(batch.column("pairs").flatten().to_numpy())
        if sum(map(len, waiting)) > 4_000_000:
            yield counted()
    if waiting:
        yield counted()


def _known_links(hot):
    """Each document's sums over the pairs that are broadcast, and its other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, best = hot.value
        for batch in batches:
            lists = batch.column("pairs")
            off = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            doc = np.repeat(np.arange(len(lists)), np.diff(off))
            pair, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            at = np.minimum(np.searchsorted(key, pair), max(len(key) - 1, 0))
            known = key[at] == pair if len(key) else np.zeros(len(pair), bool)
            sums = np.zeros((2, len(lists)), np.int64)
            np.add.at(sums[0], doc[known], times[known] * docs[at[known]])
            np.add.at(sums[1], doc[known], times[known] * best[at[known]])
            left = ~known
            rest = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[left], minlength=len(lists)))]), pa.int32())
            yield pa.record_batch(
                {c: batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
                | {"n_best": pa.array(sums[1]), "count_sum": pa.array(sums[0]), "pairs": pa.ListArray.from_arrays(rest, pa.array(pair[left])), "times": pa.ListArray.from_arrays(rest, pa.array(times[left]))}
            )

    return run


def align(docs: DataFrame, folder: str = VOCABULARIES, hot_pairs: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs``."""
    spark = docs.sparkSession
    one = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_documents(folder), ALIGNED), "aligned")
    counts = one.select("pairs").mapInArrow(_held, "pair int, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = stage(counts.withColumn("a", F.shiftrightunsigned("pair", SHIFT)), "pairs")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    judged = counts.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).cast("int").alias("best"))
    often = most_frequent(counts, F.col("docs"), hot_pairs)
    top = judged.where(often).toArrow().sort_by("pair")  # at most hot_pairs rows of 16 bytes
    hot = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "docs", "best")))
    figures = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    two = stage(one.mapInArrow(_known_links(hot), figures + ", pairs array<int>, times array<long>"), "looked-up")
    rare = two.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    rest = rare.join(judged.where(~often).withColumnRenamed("pair", "pairs"), "pairs").groupBy("row").agg(
        F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum")
    )
    names = ["n_a", "n_b", "n_groups", "n_links"]
    parts = two.select("row", "doc_id", *names, "n_best", "count_sum", "groups_sha256").unionByName(rest, allowMissingColumns=True)
    # one row of a document has its figures, the other only sums
    out = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.max(c).alias(c) for c in names], *[F.sum(c).alias(c) for c in ("n_best", "count_sum")], F.max("groups_sha256").alias("groups_sha256"))
    return out.drop("row")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
