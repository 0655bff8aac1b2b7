"""Class-based n-gram language model: exchange clustering, class transitions, word emissions.

    P(word | previous) = P(class | class of previous) * P(word | class)

Learning reads whole training texts in passes that each end in a grouped sum:

1. word counts; the most frequent words (at most ``looked_up`` of them, three occurrences
   or more) and their counts are broadcast. The first ``words`` of these are to be
   clustered, all other words and unseen ones share the class RARE, the end of a text has
   the class END;
2. counts of neighbouring words (numbers, not strings), staged once;
3. exchange rounds: with the classes of the round (a short array, broadcast) each word's
   neighbours are summed by class, and the word moves to the class that raises the mean
   mutual information of neighbouring classes most. Blocks of some ``BLOCK`` words are
   exchanged side by side, the words of a block one after the other; a round lets a
   hashed half of the words move, as blocks do not see each other's moves.

Scores are a pass over whole texts. Counts of words outside the broadcast table are met
by a join on each text's different rare words, and parts are summed by document.

Smoothing: transitions by Witten and Bell with add-one class frequencies; in the class
RARE, words once seen lend their number to the unseen word. Probabilities of all known
words, one unseen word and END add up to one after every word (tests).

Defined cases: null and empty texts are one END; ids that are null are never held out;
repeated rows count as often as they stand and get equal results; no training rows leave
every word unseen; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import release, stage, table
from pulsegrid.llm.lexicon import most_frequent, text_pieces

#: Words that are clustered, classes they get, exchange rounds, and words whose counts are broadcast.
WORDS, CLASSES, ROUNDS, LOOKED_UP = 1 << 15, 64, 6, 1 << 17
#: Words that one task exchanges one after the other in a round.
BLOCK = 2048
#: Longer words are not looked up, which bounds what is broadcast.
WORD_BYTES = 64
LEAST = 3
FOLDS, HELD_OUT = 7, 2
GAP = re.compile(rb"[\x20\x09-\x0d]")
#: Different entries a task holds before it passes them on.
HELD = 500_000


def in_fold(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def _texts(batch: pa.RecordBatch, training: bool = False) -> Iterator[tuple[int | None, bytes]]:
    ids = batch.column("doc_id").to_pylist()
    for i, text in zip(ids, batch.column("text").cast(pa.binary()), strict=True):
        if not (training and in_fold(i)):
            yield i, (text.as_py() or b"").lower()  # bytes lower A-Z only


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of training texts; the end of a text is the word ''."""
    n: Counter = Counter()

    def flushed() -> pa.RecordBatch:
        out = pa.record_batch({"word": pa.array(n, pa.binary(), size=len(n)).cast(pa.string()), "n": pa.array(n.values(), pa.int64(), size=len(n))})
        n.clear()
        return out

    for batch in batches:
        for _, text in _texts(batch, training=True):
            for piece in text_pieces(text, GAP):
                n.update(piece.split())  # splits at the six ASCII spaces
            n[b""] += 1
        if len(n) > HELD:
            yield flushed()
    if n:
        yield flushed()


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)


def _folded(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(key, n): sums by key over what a task has in hand."""
    keys, counts = [], []
    for k, n in pairs:
        keys.append(k)
        counts.append(n)
        if sum(map(len, keys)) > 4 * HELD:
            k, n = _summed(keys, counts)
            keys, counts = [k], [n]
            if len(k) > 2 * HELD:
                yield pa.record_batch({"key": k, "n": n})
                keys, counts = [], []
    if keys:
        k, n = _summed(keys, counts)
        yield pa.record_batch({"key": k, "n": n})


def _neighbours(words):
    """Training texts to (previous << 32 | word, n); words as numbers, after them RARE and END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(words.value)}
        rare, end = len(number), len(number) + 1

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                ids = [end]
                for _, text in _texts(batch, training=True):
                    for piece in text_pieces(text, GAP):
                        ids += [number.get(w, rare) for w in piece.split()]
                        if len(ids) > HELD:
                            yield _counted(ids)
                            ids = ids[-1:]
                    ids.append(end)
                if len(ids) > 1:
                    yield _counted(ids)

        yield from _folded(pairs())

    return run


def _counted(ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(ids, np.int64)
    return np.unique(x[:-1] << 32 | x[1:], return_counts=True)


def _by_class(of_word, slots: int):
    """Pairs to (word * 2 slots + slot, n): a word's next classes in the first slots, its previous ones after them, itself apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = of_word.value

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                key, n = batch.column("key").to_numpy(), batch.column("n").to_numpy()
                a, b = key >> 32, key & 0xFFFFFFFF
                same = a == b
                yield _summed([a * 2 * slots + c[b], b * 2 * slots + slots + c[a], a[same] * 2 * slots + slots - 1], [n, n, n[same]])

        yield from _folded(pairs())

    return run


def _class_pairs(of_word, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, total = of_word.value, np.zeros(slots * slots, np.int64)
        for batch in batches:
            key, n = batch.column("key").to_numpy(), batch.column("n").to_numpy()
            total += np.bincount(c[key >> 32] * slots + c[key & 0xFFFFFFFF], n, slots * slots).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.record_batch({"key": at, "n": total[at]})

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _without(table_: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, itself: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class counts without a word of the class ``own``, and the word's next and previous classes without itself."""
    t, r, l = table_.astype(float), after.astype(float), before.astype(float)
    t[own, :] -= r
    t[:, own] -= l
    t[own, own] += itself
    r[own] -= itself
    l[own] -= itself
    return t, r, l


def best_class(table_: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, itself: float, classes: int) -> int:
    """The class that gives the largest sum of n log n over neighbouring classes, less that of the margins.

    ``table_`` counts neighbouring classes with the word in ``own``; ``after`` and
    ``before`` count the word's next and previous classes, ``itself`` stands in both.
    The word stays where no class is better.
    """
    t, r, l = _without(table_, own, after, before, itself)
    k = np.arange(classes)
    rows, cols = t[:classes], t[:, :classes]
    gain = (_xlogx(rows + r) - _xlogx(rows)).sum(1) + (_xlogx(cols + l[:, None]) - _xlogx(cols)).sum(0)
    # the corner was counted twice, and takes both sides and the word itself
    d = t[k, k]
    gain -= _xlogx(d + r[k]) + _xlogx(d + l[k]) - 2 * _xlogx(d)
    gain += _xlogx(d + r[k] + l[k] + itself) - _xlogx(d)
    # margins count the other words' neighbours too, this word among them
    for margin, m in (((t.sum(1) + l)[:classes], after.sum()), ((t.sum(0) + r)[:classes], before.sum())):
        gain -= _xlogx(margin + m) - _xlogx(margin)
    best = int(np.argmax(gain))
    return best if gain[best] > gain[own] + 1e-9 * abs(gain[own]) + 1e-9 else own


def _moves(state, classes: int, slots: int):
    """The sums by class of a block of words to (word, class): word after word, most frequent first, each move counted before the next."""

    def run(block: pa.Table) -> pa.Table:
        of_word, counts = state.value
        block, out, t = block.sort_by("word").combine_chunks(), [], counts.astype(float)
        for word, sums in zip(block.column("word").to_pylist(), block.column("sums").chunk(0), strict=True):
            x = np.zeros(2 * slots)
            x[sums.values.field("slot").to_numpy()] = sums.values.field("n").to_numpy()
            after, before, itself, own = x[: slots - 1], x[slots : 2 * slots - 1], x[slots - 1], int(of_word[word])
            to = best_class(t, own, after, before, itself, classes)
            if to != own:
                t, r, l = _without(t, own, after, before, itself)
                # words that moved before it in the block leave its own sums a round behind
                np.maximum(t, 0, out=t)
                t[to, :] += r
                t[:, to] += l
                t[to, to] += itself
            out.append(to)
        return pa.table({"word": block.column("word"), "class": pa.array(out, pa.int32())})

    return run


class Model(NamedTuple):
    words: list[bytes]
    #: the first of the words, those that have a class of their own
    clustered: int
    of_word: np.ndarray
    #: log10 P(class | class before), and log10 P(word | class) for words by number, any other word (0) and END
    transition: np.ndarray
    emission: np.ndarray
    #: log10((n + 1) / (N + V + 1)) by word number, and the two figures it is made of
    base: np.ndarray
    train_tokens: int
    n_words: int
    #: of the class RARE: tokens and words seen once
    rare_tokens: int
    rare_once: int


def exchange(pairs: DataFrame, n_words: int, start: np.ndarray, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the words, and counts of neighbouring classes, from staged pairs of word numbers."""
    sc = pairs.sparkSession.sparkContext
    of_word, slots = start, classes + 3  # RARE, END, and a word's pairs with itself
    counts = _class_counts(pairs, of_word, classes)
    for r in range(rounds if n_words else 0):
        moving = F.pmod(F.xxhash64("word"), F.lit(2)) == r % 2
        sums = pairs.mapInArrow(_by_class(sc.broadcast(of_word), slots), "key long, n long").select(
            F.floor(F.col("key") / (2 * slots)).cast("int").alias("word"), (F.col("key") % (2 * slots)).cast("int").alias("slot"), "n"
        ).where(F.col("word") < n_words).where(moving)
        # a word has at most 2 * slots sums
        sums = sums.groupBy("word", "slot").agg(F.sum("n").alias("n")).groupBy("word").agg(F.collect_list(F.struct("slot", "n")).alias("sums"))
        block = F.pmod(F.xxhash64("word", F.lit(r)), F.lit(-(-n_words // BLOCK))).alias("block")
        moved = sums.groupBy(block).applyInArrow(_moves(sc.broadcast((of_word, counts)), classes, slots), "word int, class int").toArrow()
        of_word = of_word.copy()
        of_word[moved.column("word").to_numpy()] = moved.column("class").to_numpy()
        counts = _class_counts(pairs, of_word, classes)
    return of_word, counts


def _class_counts(pairs: DataFrame, of_word: np.ndarray, classes: int) -> np.ndarray:
    k = classes + 2
    got = pairs.mapInArrow(_class_pairs(pairs.sparkSession.sparkContext.broadcast(of_word), k), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k, np.int64)
    out[got.column("key").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(k, k)


def learn(docs: DataFrame, words: int = WORDS, classes: int = CLASSES, rounds: int = ROUNDS, looked_up: int = LOOKED_UP) -> tuple[Model, DataFrame]:
    """The model, and the staged counts (word, n) of all training words."""
    sc = docs.sparkSession.sparkContext
    counts = stage(docs.mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    r = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word") == "", F.col("n"))).alias("ends"), F.sum((F.col("n") == 1).cast("int")).alias("once")).first()
    n, v = r["n"] or 0, r["v"]
    plain = counts.where((F.col("word") != "") & (F.octet_length("word") <= WORD_BYTES) & (F.col("n") >= LEAST))
    chosen = plain.where(most_frequent(plain, F.col("n"), looked_up)).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    listed, each = [w.encode() for w in chosen.column("word").to_pylist()], chosen.column("n").to_numpy()
    own = min(words, len(listed))
    # the most frequent words start in a class each, the others with the class of their place
    of_word = np.concatenate([np.arange(own) % classes, [classes, classes + 1]]).astype(np.int64)
    pairs = stage(docs.mapInArrow(_neighbours(sc.broadcast(listed[:own])), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "neighbours")
    of_word, table_ = exchange(pairs, own, of_word, classes, rounds)
    release(pairs)
    once = (r["once"] or 0) - (1 if r["ends"] == 1 else 0)
    of_word = np.concatenate([of_word[:own], np.full(len(listed) - own, classes), of_word[own:]])
    return _model(listed, own, each, of_word, table_, n, v, once), counts


def _model(words: list[bytes], own: int, each: np.ndarray, of_word: np.ndarray, table_: np.ndarray, n: int, v: int, once: int) -> Model:
    k = len(table_)
    per_class = table_.sum(0)
    frequency = (per_class + 1) / (n + k)
    followers = np.maximum((table_ > 0).sum(1), 1)
    transition = (table_ + followers[:, None] * frequency) / (table_.sum(1) + followers)[:, None]
    emission, base = np.zeros(len(words) + 2), np.zeros(len(words) + 2)
    # of the class RARE, words seen once lend their number to the unseen word
    whole = np.where(np.arange(len(words)) < own, per_class[of_word[: len(words)]], per_class[k - 2] + once + 1)
    emission[: len(words)] = np.log10(each / whole) if words else []
    base[: len(words)] = np.log10((each + 1) / (n + v + 1))
    base[-1] = np.log10((per_class[k - 1] + 1) / (n + v + 1))
    return Model(words, own, of_word, np.log10(transition), emission, base, n, v, int(per_class[k - 2]), once)


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(model):
    """Texts to their scores without the emissions of rare words, and those words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        number = {w: i for i, w in enumerate(m.words)}
        rare, end = len(number), len(number) + 1
        ended = m.base[end] if m.train_tokens else -np.log10(m.train_tokens + m.n_words + 1)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            figures, strangers, many, lengths = [], [], [], []
            for doc_id, text in _texts(batch):
                last, n, known, base, score, rest = end, 1, int(m.train_tokens > 0), ended, 0.0, Counter()
                for piece in text_pieces(text, GAP):
                    w = piece.split()
                    ids = [number.get(x, rare) for x in w]
                    x = np.array([last, *ids], np.int64)
                    c = m.of_word[x]
                    score += m.transition[c[:-1], c[1:]].sum() + m.emission[x[1:]].sum()
                    base += m.base[x[1:]].sum()
                    strange = [y for y, i in zip(w, ids, strict=True) if i == rare]
                    rest.update(strange)
                    n, known, last = n + len(w), known + len(w) - len(strange), int(x[-1])
                score += m.transition[m.of_word[last], m.of_word[end]]
                figures.append((row, doc_id, in_fold(doc_id), n, known, base, score))
                strangers += rest
                many += rest.values()
                lengths.append(len(rest))
                row += 1
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            columns = [pa.array(x, k) for x, k in zip(zip(*figures, strict=True) if figures else [[]] * 7, kinds, strict=True)]
            flat = pa.StructArray.from_arrays([pa.array(strangers, pa.binary()).cast(pa.string()), pa.array(many, pa.int64())], ["word", "n"])
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), flat))
            yield pa.record_batch(columns, [f.split()[0] for f in SCORED.split(", ")] + ["rest"])

    return run


def score(docs: DataFrame, words: int = WORDS, classes: int = CLASSES, rounds: int = ROUNDS, looked_up: int = LOOKED_UP) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of ``docs``."""
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model, counts = learn(flat, words, classes, rounds, looked_up)
    one = stage(flat.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), SCORED + ", rest array<struct<word: string, n: long>>"), "scored")
    rest = one.select("row", F.explode("rest").alias("x")).select("row", "x.word", F.col("x.n").alias("times"))
    found = rest.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    base = F.log10((F.col("n") + 1) / F.lit(float(model.train_tokens + model.n_words + 1)))
    # all that is not looked up is of the class RARE
    weight = F.when(F.col("n") > 0, F.col("n")).otherwise(model.rare_once + 1)
    emitted = F.log10(weight / F.lit(float(model.rare_tokens + model.rare_once + 1)))
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("n_known"), F.sum(F.col("times") * base).alias("base_score"), F.sum(F.col("times") * emitted).alias("score")
    )
    parts = one.drop("rest").unionByName(sums, allowMissingColumns=True)
    out = parts.groupBy("row").agg(*[F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens")], *[F.sum(c).alias(c) for c in ("n_known", "base_score", "score")])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op11_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
