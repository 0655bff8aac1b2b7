"""Quality rules: a learned decision list of threshold conjunctions.

Whole-text statistics are computed per document with NumPy over Arrow batches. A
sequential-covering learner grows conjunctions of thresholds on labelled statistics,
prunes them on a held-back part and returns an ordered list, which is applied as one
Spark ``CASE WHEN`` expression.

Defined cases: a null or empty text has no words, so ``base_failed`` is true and
``kept`` false; repeated rows and null ids are judged row by row; an empty table gives
an empty result; without usable labels the list is empty and only the base decides.
Other columns of the input, whatever their names, pass through where asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import table
from pulsegrid.llm.textkernel import Words, mix, shingles, slices, string_parts

#: Labelled rows used for fitting at most (those whose hashed id is smallest).
MAX_FIT_ROWS = 20_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_upper", "n_letters", "n_bangs", "n_digits", "n_distinct", "n_same_next", "n_lines")
WINDOW = 8
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_CLASSES = {
    "n_symbols": b"#*$%&|<>",
    "n_upper": bytes(range(65, 91)),
    "n_letters": bytes(range(65, 91)) + bytes(range(97, 123)),
    "n_bangs": b"!?",
    "n_digits": b"0123456789",
}
_IN_CLASS = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}


def _repeats(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is another equal value in the same text, is an earlier one) for each value."""
    key = h ^ mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later = np.zeros(len(h), bool)
    later[order[1:]] = same
    either = later.copy()
    either[order[:-1]] |= same
    return either, later


def features(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of each text of a slice."""
    n = len(off) - 1
    w = Words(buf, off)
    counts = np.diff(w.first)
    owner = np.repeat(np.arange(n), counts)
    by_text = lambda flag, own: np.bincount(own[flag], minlength=n)
    total = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[off])
    out = {"n_words": counts, "word_chars": total(~w.gap & ((buf & 0xC0) != 0x80))}
    out |= {k: total(t[buf]) for k, t in _IN_CLASS.items()}
    h = w.hashes()
    _, later = _repeats(owner, h)
    out["n_distinct"] = by_text(~later, owner)
    out["n_same_next"] = by_text(np.concatenate([[False], (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])]) if len(h) else np.zeros(0, bool), owner)
    at = np.flatnonzero(np.arange(len(h)) + WINDOW <= w.first[1:][owner]) if len(h) else np.zeros(0, np.int64)
    twice, _ = _repeats(owner[at], shingles(h, WINDOW)[at])
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + WINDOW, -1)
    out["n_repeat_words"] = by_text(np.cumsum(step[:-1]) > 0, owner)
    lines = Words(buf, off, _NEWLINE)
    has_word = np.searchsorted(w.start, lines.end) > np.searchsorted(w.start, lines.start)
    line_owner = np.repeat(np.arange(n), np.diff(lines.first))
    out["n_lines"] = by_text(has_word, line_owner)
    _, later = _repeats(line_owner, lines.hashes())
    out["n_dup_lines"] = by_text(later & has_word, line_owner)
    return out


def with_features(docs: DataFrame, keep: list[str], text: str = "text", prefix: str = "") -> DataFrame:
    """The columns ``keep`` and the statistics, one row per row of ``docs``."""
    names = [*BASE, *EXTRA]
    cols = keep if text in keep else [*keep, text]
    at = cols.index(text)
    kept = docs.select(*[F.col(f"`{c}`") for c in cols])
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(prefix + c, T.LongType()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = string_parts(b.column(at))
            for i, j in slices(off):
                f = features(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays(
                    [*b.slice(i, j - i).columns[: len(keep)], *(pa.array(f[c].astype(np.int64)) for c in names)],
                    names=[*keep, *(prefix + c for c in names)],
                )

    return kept.mapInArrow(run, schema)


#: What the learner sees: ratios, as (name, numerator, denominator).
RATIOS = (
    ("symbols_per_word", "n_symbols", "n_words"),
    ("upper_share", "n_upper", "n_letters"),
    ("bangs_per_word", "n_bangs", "n_words"),
    ("digits_per_char", "n_digits", "word_chars"),
    ("repeat_share", "n_repeat_words", "n_words"),
    ("distinct_share", "n_distinct", "n_words"),
    ("same_next_share", "n_same_next", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("word_length", "word_chars", "n_words"),
    ("words", "n_words", None),
)


def _ratio(c: str, prefix: str) -> Column:
    _, a, b = next(r for r in RATIOS if r[0] == c)
    a = F.col(prefix + a).cast("double")
    return a if b is None else a / F.greatest(F.col(prefix + b), F.lit(1))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (ratio, '<=' or '>', threshold); a text that meets it is rejected."""

    terms: tuple[tuple[str, str, float], ...]

    def column(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for c, op, t in self.terms:
            out = out & (_ratio(c, prefix) <= t if op == "<=" else _ratio(c, prefix) > t)
        return out

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for c, op, t in self.terms:
            out &= x[c] <= t if op == "<=" else x[c] > t
        return out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7, max_rules: int = 24, max_terms: int = 4, min_precision: float = 0.9, min_cover: int = 5) -> list[Rule]:
    """Sequential covering of ``bad`` rows: grow by FOIL gain on two thirds, prune on the rest."""
    rules: list[Rule] = []
    n = len(bad)
    grow = np.random.default_rng(seed).random(n) < 2 / 3
    left = np.ones(n, bool)
    while len(rules) < max_rules and (bad & left).sum() >= min_cover:
        inside, terms = left & grow, []
        while len(terms) < max_terms and (inside & ~bad).any() and (inside & bad).any():
            p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
            best = (0.0, None)
            for c, v in x.items():
                cuts = np.unique(np.quantile(v[inside & bad], np.linspace(0, 1, 41)))
                cuts = np.unique(np.concatenate([cuts, np.quantile(v[inside], np.linspace(0, 1, 41))]))
                vb, vg = np.sort(v[inside & bad]), np.sort(v[inside & ~bad])
                pb, pg = np.searchsorted(vb, cuts, "right"), np.searchsorted(vg, cuts, "right")
                for op, p, q in (("<=", pb, pg), (">", len(vb) - pb, len(vg) - pg)):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(p > 0, p * (np.log2(p / (p + q)) - np.log2(p0 / (p0 + n0))), 0)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0] + 1e-9:
                        best = (float(gain[k]), (c, op, float(cuts[k])))
            if best[1] is None:
                break
            c, op, t = best[1]
            above = x[c][inside & (x[c] > t)]
            terms.append((c, op, (t + float(above.min())) / 2 if len(above) else t))  # midway to the next value
            inside &= Rule((terms[-1],)).mask(x)

        def worth(k: int) -> float:
            m = Rule(tuple(terms[:k])).mask(x) & left & ~grow
            p, q = (m & bad).sum(), (m & ~bad).sum()
            return (p - q) / (p + q) if p + q else -1.0

        if not terms:
            break
        size = max(range(1, len(terms) + 1), key=lambda k: (worth(k), -k))
        rule = Rule(tuple(terms[:size]))
        m = rule.mask(x) & left
        if (m & bad).sum() < min_cover or (m & bad).sum() < min_precision * m.sum():
            break
        rules.append(rule)
        left &= ~m
    return rules


def ratios_of(rows) -> dict[str, np.ndarray]:
    out = {}
    for name, a, b in RATIOS:
        v = rows[a].to_numpy(np.float64)
        out[name] = v if b is None else v / np.maximum(rows[b].to_numpy(np.float64), 1)
    return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS, label: str = "quality", base_failed: bool = True) -> list[Rule]:
    """Learn the list from at most ``max_rows`` labelled rows, chosen by hashed id."""
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .select("doc_id", F.col(label).alias("__label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "__label")
        .limit(max_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most max_rows ids
    rows = with_features(rows, ["__label"]).toPandas()
    if base_failed and len(rows):
        rows = rows[~((rows.n_words < 20) | (100 * rows.n_repeat_words > 30 * rows.n_words))]
    if not len(rows):
        return []
    # a fixed order, so that reruns learn the same list
    rows = rows.sort_values(list(rows.columns)).reset_index(drop=True)
    return learn(ratios_of(rows), (rows["__label"] == 0).to_numpy())


def base_failed(prefix: str = "") -> Column:
    n = F.col(prefix + "n_words")
    return (n < 20) | (100 * F.col(prefix + "n_repeat_words") > 30 * n)


def kept(rules: list[Rule], prefix: str = "") -> Column:
    """The decision list as one ordered conditional expression."""
    out = F.when(base_failed(prefix), False)
    for r in rules:
        out = out.when(r.column(prefix), False)
    return out.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base statistics, ``base_failed`` and ``kept`` for every row."""
    rules = fit(docs, labels)
    f = with_features(docs, ["doc_id"])
    return f.select("doc_id", *BASE, base_failed().alias("base_failed"), kept(rules).alias("kept"))


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the list keeps, with their columns."""
    rules = fit(docs, labels)
    prefix = "__q_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return with_features(docs, docs.columns, prefix=prefix).where(kept(rules, prefix)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
