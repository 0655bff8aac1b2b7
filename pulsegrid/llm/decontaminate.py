"""Benchmark decontamination by a prefix-filtered set join (DataFrame functions only).

Every window of ``window`` item words (an item of fewer words is one window) must occur
in a document word by word, that is with containment 1, so the necessary prefix of its
rarity-ordered tokens has one token: the rarest. Token frequencies come from all
documents. Prefix tokens, each with its item neighbourhood of ``window - 1`` words on
either side, are joined with the exploded document words; the join condition applies
the positional and length bounds and verifies the words exactly, so one joined row
stands for a maximal matching run.

Defined cases: null, empty or wordless texts have no words and no hits; rows with a
null or repeated ``doc_id`` are judged row by row (identical rows get identical
results); items that are null or wordless match nothing; empty tables give empty or
clean results; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.llm.common import fresh, lower_ascii, stage, table

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of prefix tokens (under 1 KB each) that are broadcast at once; a larger benchmark goes in blocks.
BLOCK_ROWS = 50_000


def words(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), NOT_WORD), ""), F.array().cast("array<string>"))


def _run(doc: str, at: Column, near: str, step: int, limit: int) -> Column:
    """How many words in a row agree, from the one next to ``at`` on."""
    out = None
    for i in range(limit):
        same = F.coalesce(F.get(F.col(doc), at + step * (i + 1)) == F.get(F.col(near), F.lit(i)), F.lit(False))
        out = F.when(~same, i) if out is None else out.when(~same, i)
    return F.lit(0) if out is None else out.otherwise(limit)


def prefix_tokens(docs: DataFrame, benchmark: DataFrame, window: int, text: str = "text") -> DataFrame:
    """(item_id, word, left, right, need): the rarest token of each item window, once per item position."""
    items = benchmark.select("item_id", words(F.col(text)).alias("iw")).where(F.size("iw") > 0).distinct()
    flat = items.select("item_id", "iw", F.posexplode("iw").alias("q", "word"))
    vocabulary = flat.select("word").distinct()
    seen = docs.select(F.explode_outer(words(F.col(text))).alias("word"))
    n_words = vocabulary.count()
    blocks = max(1, math.ceil(n_words / (4 * BLOCK_ROWS)))
    freq = None
    for b in range(blocks):
        part = vocabulary.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == b)
        one = seen.join(F.broadcast(part), "word").groupBy("word").agg(F.count("*").alias("n"))
        freq = one if freq is None else freq.union(one)
    freq = stage(freq, "freq")
    ranked = (
        flat.join(freq, "word", "left")
        .groupBy("item_id", "iw")
        .agg(F.sort_array(F.collect_list(F.struct("q", F.coalesce("n", F.lit(0)).alias("n")))).alias("fq"))
        .withColumn("need", F.least(F.size("iw"), F.lit(window)))
    )
    rarest = F.expr(
        "array_distinct(transform(sequence(1, size(iw) - need + 1), s -> "
        "array_min(transform(slice(fq, s, need), x -> named_struct('n', x.n, 'q', x.q))).q))"
    )
    out = ranked.select("item_id", "iw", "need", F.explode(rarest).alias("q")).select(
        "item_id",
        "need",
        F.element_at("iw", F.col("q") + 1).alias("word"),
        F.expr(f"reverse(slice(iw, greatest(1, q - {window - 2}), least(q, {window - 1})))").alias("left"),
        F.expr(f"slice(iw, q + 2, {window - 1})").alias("right"),
    )
    # equal neighbourhoods of one item need one row
    return stage(out.distinct(), "prefix")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """(doc_id, text_hash, first, last, item_id): maximal runs of document words inside occurrences of item windows."""
    tokens = prefix_tokens(docs, benchmark, window, text)
    blocks = max(1, math.ceil(tokens.count() / BLOCK_ROWS))
    flat = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), words(F.col(text)).alias("dw")).select(
        "doc_id", "text_hash", "dw", F.posexplode_outer("dw").alias("p", "word")
    )
    left = _run("dw", F.col("p"), "left", -1, window - 1)
    right = _run("dw", F.col("p"), "right", 1, window - 1)
    out = None
    for b in range(blocks):
        part = tokens.where(F.pmod(F.xxhash64("item_id", "word"), F.lit(blocks)) == b).withColumnRenamed("word", "token")
        found = flat.join(F.broadcast(part), (F.col("word") == F.col("token")) & (left + right + 1 >= F.col("need"))).select(
            "doc_id", "text_hash", (F.col("p") - left).alias("first"), (F.col("p") + right).alias("last"), "item_id"
        )
        out = found if out is None else out.union(found)
    return out


def judge(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of ``docs``."""
    found = stage(hits(docs, benchmark, window, text), "hits")
    by_doc = W.partitionBy("doc_id", "text_hash").orderBy("first", "last")
    reach = F.max("last").over(by_doc.rowsBetween(W.unboundedPreceding, -1))
    spans = (
        found.select("doc_id", "text_hash", "first", "last")
        .distinct()
        .withColumn("reach", F.coalesce(reach, F.lit(-1)))
        .groupBy("doc_id", "text_hash")
        .agg(F.sum(F.greatest(F.lit(0), F.col("last") - F.greatest("first", F.col("reach") + 1) + 1)).alias("n_hit"))
    )
    items = found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    per_doc = spans.alias("s").join(
        items.alias("i"), F.col("s.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("s.text_hash") == F.col("i.text_hash"))
    ).select(F.col("s.doc_id").alias("h_id"), F.col("s.text_hash").alias("h_hash"), "n_hit", "items")
    base = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.size(words(F.col(text))).cast("long").alias("n_words"))
    joined = base.join(per_doc, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def filter_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item window occurs."""
    h_id, h_hash = fresh(docs, "__h_id", "__h_hash")
    bad = stage(hits(docs, benchmark, window, text).select(F.col("doc_id").alias(h_id), F.col("text_hash").alias(h_hash)).distinct(), "hits")
    if bad.count() <= 200_000:
        bad = F.broadcast(bad)
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(h_id)) & (F.xxhash64(text) == F.col(h_hash)), "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT DISTINCT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
i AS (SELECT item_id, w, least(10, len(w)) AS need, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, need, array_to_string(w[s:s + need - 1], ' ') AS g FROM i),
n AS (SELECT DISTINCT need FROM iw),
dw AS (SELECT r, need, w, unnest(range(1, len(w) - need + 2)) AS s FROM d, n WHERE len(w) >= need),
hit AS (SELECT r, item_id, need, s FROM (SELECT r, need, s, array_to_string(w[s:s + need - 1], ' ') AS g FROM dw) x JOIN iw USING (need, g)),
p AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + need)) AS pos FROM hit) x GROUP BY r),
t AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""
