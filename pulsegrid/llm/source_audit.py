"""Source divergence audit: how far the sources of a language lie apart, and by which terms.

Every (language, source) group and every language gives each term its language keeps
(those in ``min_docs`` documents of it or more) a smoothed whole-number share p. The
divergence of two groups is the sum over the kept terms of f = floor((p - q)^2 / (p + q)).
A term that neither group has adds the same f0, so a pair starts at V times f0 and the
inverted index only adds corrections that are not zero:

* one-sided, ``f(p, q0) - f0`` for a term one group has. It depends on the term's count
  alone, so a group's postings are first reduced to (count, number of terms);
* two-sided, ``f(p, q) - f(p, q0) - f(p0, q) + f0`` for a term both have, from the
  term's postings. A posting list is cut into blocks of ``BLOCK`` sources, and blocks
  meet block by block, so no list of a common term is held whole.

Texts are cut to terms and counted in Python per task (C-speed counters, flushed at a
bounded size); all else is whole-number DataFrame arithmetic. A term's ten first places
are a window of limited rank, which Spark cuts before it shuffles.

Defined cases: null text, language and source are ''; a group without terms takes part
with zero counts; a language that keeps no term has value 0 for all its pairs and no
term rows; repeated rows count as often as they stand; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.llm.common import fits, stage, table
from pulsegrid.llm.lexicon import text_pieces

#: Terms on lower-cased UTF-8 bytes: ASCII letters and everything beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
NOT_TERM = re.compile(rb"[^a-z\x80-\xff]")
#: Different (group, term) entries a task holds before it passes them on.
HELD = 800_000
#: Sources of one block of a posting list.
BLOCK = 64


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences and documents of each term, summed as far as one task sees them."""
    total: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), n in total.items():
            d, rows = docs[lang, source], len(n)
            yield pa.record_batch(
                {
                    "lang": pa.repeat(pa.scalar(lang, pa.string()), rows),
                    "source": pa.repeat(pa.scalar(source, pa.string()), rows),
                    "term": pa.array(n, pa.binary(), size=rows).cast(pa.string()),
                    "n": pa.array(n.values(), pa.int64(), size=rows),
                    "docs": pa.array(map(d.__getitem__, n), pa.int64(), size=rows),
                }
            )
        total.clear()
        docs.clear()

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for text, lang, source in zip(texts, batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
            key = lang, source
            if key not in total:
                total[key], docs[key] = Counter(), Counter()
            seen: set[bytes] = set()
            for piece in text_pieces((text.as_py() or b"").lower(), NOT_TERM):  # bytes lower A-Z only
                terms = TERM.findall(piece)
                total[key].update(terms)
                seen.update(terms)
            docs[key].update(seen)
        if sum(map(len, total.values())) > HELD:
            yield from flushed()
    yield from flushed()


def _div(a: Column, b: Column) -> Column:
    """Whole-number quotient of two columns of not negative whole numbers."""
    return F.call_function("div", a, b)


def _share(count: Column, n: Column, v: Column) -> Column:
    """p = 1 + floor(10^9 (count + 2) / (N + 2 V)), in decimals as the product outgrows a long."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + _div(F.lit(10**9).cast("decimal(10,0)") * wide(count + 2), wide(n + 2 * v))


def _apart(p: Column, q: Column) -> Column:
    """f = floor((p - q)^2 / (p + q)); p and q are at most 10^9 + 1, so the square fits a long."""
    return _div((p - q) * (p - q), p + q)


def kept_postings(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, source, n, total, first): counts of the kept terms, the language's total, and a flag on one row a term."""
    flat = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counted = flat.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    # one shuffle by term serves the sums by source and the windows over a term
    by_source = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    ranked = by_source.select(
        "lang", "term", "source", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("total"), (F.row_number().over(term.orderBy("source")) == 1).alias("first")
    )
    return ranked.where(F.col("docs") >= min_docs).drop("docs")


def groups_of(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, i, n, v, lang_n, p0): a group's number in its language, its sizes and its share of a term it lacks."""
    all_groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sizes = postings.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = postings.where("first").groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    out = all_groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "v", "lang_n"])
    out = out.withColumn("i", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)
    return out.withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0), F.col("n"), F.col("v"))))


def _small(groups: DataFrame, at_most: bool) -> DataFrame:
    """Columns of the staged groups, to be broadcast if its files are small."""
    return F.broadcast(groups) if at_most else groups


def _pair_sums(postings: DataFrame, groups: DataFrame, small: bool) -> DataFrame:
    """(lang, i, j, value) for i < j: V times f of two absent counts and all corrections."""
    side = lambda s: groups.select("lang", *[F.col(c).alias(f"{c}_{s}") for c in ("i", "v", "p0")])
    zero = _apart(F.col("p0_a"), F.col("p0_b"))
    both = side("a").join(side("b"), "lang")
    start = both.where("i_a < i_b").select("lang", F.col("i_a").alias("i"), F.col("i_b").alias("j"), F.when(F.col("v_a") > 0, F.col("v_a") * zero).otherwise(0).alias("value"))

    # a group's terms by their count, against every other group
    own = groups.select("lang", "source", "i", "n", "v", "p0").withColumnRenamed("n", "size")
    by_count = postings.groupBy("lang", "source", F.col("n").alias("count")).agg(F.count("*").alias("terms"))
    one = by_count.join(_small(own, small), ["lang", "source"]).select("lang", F.col("i").alias("i_a"), F.col("p0").alias("p0_a"), "terms", _share(F.col("count"), F.col("size"), F.col("v")).alias("p"))
    one = one.join(_small(side("b"), small), "lang").where("i_a <> i_b").select(
        "lang", F.least("i_a", "i_b").alias("i"), F.greatest("i_a", "i_b").alias("j"), (F.col("terms") * (_apart(F.col("p"), F.col("p0_b")) - zero)).alias("value")
    )

    # the postings of a term, block by block
    listed = postings.join(_small(own, small), ["lang", "source"]).select("lang", "term", "i", "p0", _share(F.col("n"), F.col("size"), F.col("v")).alias("p"))
    blocks = listed.repartition("lang", "term").groupBy("lang", "term", F.floor(F.col("i") / BLOCK).alias("block")).agg(F.collect_list(F.struct("i", "p", "p0")).alias("list"))
    left, right = (blocks.select("lang", "term", F.col("block").alias(f"block_{s}"), F.col("list").alias(f"list_{s}")) for s in "ab")
    met = left.join(right, ["lang", "term"]).where("block_a <= block_b").select("lang", F.explode("list_a").alias("x"), "list_b").select("lang", "x", F.explode("list_b").alias("y")).where("x.i < y.i")
    f = lambda p, q: _apart(F.col(p), F.col(q))
    two = met.select("lang", F.col("x.i").alias("i"), F.col("y.i").alias("j"), (f("x.p", "y.p") - f("x.p", "y.p0") - f("x.p0", "y.p") + f("x.p0", "y.p0")).alias("value"))
    return start.union(one.where("value <> 0")).union(two.where("value <> 0")).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank for every group of ``docs`` (lang, source, text)."""
    postings = stage(kept_postings(docs, min_docs), "postings")
    groups = stage(groups_of(docs, postings), "groups")
    small = fits(groups)
    sums = _pair_sums(postings, groups, small)
    name = lambda i, c: groups.select("lang", F.col("i").alias(i), F.col("source").alias(c))
    named = sums.join(_small(name("i", "a"), small), ["lang", "i"]).join(_small(name("j", "b"), small), ["lang", "j"])
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = named.select("lang", sides.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")

    own = groups.select("lang", "source", F.col("n").alias("size"), "v", "lang_n")
    at = postings.join(_small(own, small), ["lang", "source"]).select(
        "lang", "source", "term", _share(F.col("n"), F.col("size"), F.col("v")).alias("p"), _share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q")
    )
    terms = at.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).union(ranked(terms).where(F.col("rank") <= top))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
keep AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT l.lang, CAST(count(term) AS HUGEINT) AS v FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN keep USING (lang) GROUP BY l.lang),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM o JOIN keep USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (SELECT gn.lang, gn.source, keep.term, coalesce(c.n, 0) AS cnt, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (gn.n + 2 * v.v) AS p
  FROM gn JOIN keep ON keep.lang = gn.lang JOIN v ON v.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = keep.term),
ln AS (SELECT lang, sum(n) AS n FROM c GROUP BY lang),
q AS (SELECT c.lang, c.term, 1 + (1000000000 * (sum(c.n) + 2)) // (any_value(ln.n) + 2 * any_value(v.v)) AS q FROM c JOIN ln ON ln.lang = c.lang JOIN v ON v.lang = c.lang GROUP BY c.lang, c.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(((p.p - q.q) * (p.p - q.q)) // (p.p + q.q) AS BIGINT) AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE cnt > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 10
"""
