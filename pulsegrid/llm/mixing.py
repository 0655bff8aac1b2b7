"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Within its source every document gets a place in a shuffle keyed by its id, and is
served in packets of up to ``packet`` words. A packet's virtual finish time is the
cumulative words of its source, up to and with it, divided by the source's target; a
second pass over the source continues the count. All packets are sorted by virtual
finish time and the order is cut where the served words reach the total budget; a packet
in service at the cut is taken in part. What a document has in the mix is what its
packets have, and each source ends within a packet or so of its target.

Running sums are two-level, both within the sources and over the global order: sums per
bucket of the shuffle key, or range of finish times, give offsets, and only rows of one
bucket or range meet in one task, so a hot source is split.

Defined cases: a null or empty text has size 0 and nothing is taken from it; a null
source is a source of its own, last in order; a null id is shuffled by the text instead;
identical rows are interchangeable; an empty table gives an empty result; other columns
pass through ``mixed_documents``, whose own columns avoid their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.llm.common import SPACE_WORDS, fresh, release, stage, table

WEIGHTS = (3, 1, 2)
#: Words of a packet.
PACKET = 256
#: Ranges of finish times, per unit of virtual time.
RANGES = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE_WORDS), "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target): shares by weight, each at most ``cap`` times its source.

    The excess of capped sources is reshared by weight: in order of cap / weight, a source
    is capped as long as its cap lies under its share of what the earlier ones left. The
    table has one row per source.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1)
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", w)
    t = t.withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    t = t.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("w") * F.col("level"))
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(every)
    t = t.withColumn("final", final)
    return t.select("source", "source_size", F.when(F.col("capped") | F.col("final").isNull(), F.col("cap")).otherwise(F.col("w") * F.col("final.level")).alias("target"))


def _offsets(df: DataFrame, by: list[str], bucket: str, value: str) -> DataFrame:
    """Sum of ``value`` over the earlier buckets of the same ``by``."""
    s = df.groupBy(*by, bucket).agg(F.sum(value).alias("s"))
    w = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return s.select(*by, bucket, F.coalesce(F.sum("s").over(w), F.lit(0)).alias("offset"))


def mix(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, row: Column | None = None, packet: int = PACKET) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and of the last packet taken its ``finish`` and ``mix_end``, the words of the mix up to its end.

    ``row``, an expression over the columns of ``docs``, is returned as a column too.
    """
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))))
    key = F.md5(F.concat(own, F.lit(f":{seed}")))
    more = [] if row is None else [row.alias("row")]
    sized = stage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("k"), *more), "sizes")
    d = sized.withColumn("b", F.substring("k", 1, 3))
    t = targets(d, weights, share, cap)
    off = _offsets(d, ["source"], "b", "size").join(t.withColumnRenamed("source", "ts"), F.col("source").eqNullSafe(F.col("ts"))).drop("ts")
    off = off.withColumnsRenamed({"source": "os", "b": "ob"})
    within = W.partitionBy("source", "b").orderBy("k", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.withColumn("run", F.sum("size").over(within)).join(off, F.col("source").eqNullSafe(F.col("os")) & (F.col("b") == F.col("ob")))
    d = d.withColumn("start", F.col("offset") + F.col("run") - F.col("size"))
    d = stage(d.select("doc_id", "source", "size", "source_size", "target", "start", *(["row"] if more else [])), "queued")
    release(sized)
    # a source and a start name a document with words
    turn = F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / packet) - 1)).alias("j")
    p = d.where("size > 0").select("source", "start", "size", "source_size", "target", F.explode(F.array(F.lit(0), F.lit(1))).alias("again")).select("*", turn)
    to = F.least("size", (F.col("j") + 1) * packet)
    p = p.select("source", "start", (to - F.col("j") * packet).alias("words"), (F.col("again") * F.col("source_size") + F.col("start") + to).alias("end"), "target")
    p = p.withColumn("finish", F.col("end") / F.col("target")).withColumn("range", F.floor(F.col("finish") * RANGES)).drop("target")
    p = stage(p, "packets")
    in_range = W.partitionBy("range").orderBy("finish", F.col("source").asc_nulls_last(), "end").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = _offsets(p, [], "range", "words").withColumnRenamed("range", "r")
    budget = F.floor(F.lit(float(min(share, cap))) * F.sum("source_size"))
    total = d.groupBy("source").agg(F.max("source_size").alias("source_size")).agg(budget.cast("long").alias("budget"))
    p = p.withColumn("run", F.sum("words").over(in_range)).join(before, F.col("range") == F.col("r")).crossJoin(F.broadcast(total))  # one row
    left = F.col("budget") - (F.col("offset") + F.col("run") - F.col("words"))
    p = p.withColumn("served", F.least("words", left)).where("served > 0")
    got = p.groupBy("source", "start").agg(F.sum("served").alias("taken"), F.max("finish").alias("finish"), F.max(F.col("offset") + F.col("run") - F.col("words") + F.col("served")).alias("mix_end"))
    got = got.withColumnsRenamed({"source": "gs", "start": "ga"})
    out = d.join(got, F.col("source").eqNullSafe(F.col("gs")) & (F.col("start") == F.col("ga")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "finish", "mix_end", *(["row"] if more else []))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of which words are taken, with all columns of ``docs`` and ``taken``, ``finish`` and ``mix_end``."""
    taken, finish, end = fresh(docs, "taken", "finish", "mix_end")
    m = mix(docs, row=F.struct(*[F.col(f"`{c}`") for c in docs.columns]), **options).where("taken > 0")
    return m.select("row.*", F.col("taken").alias(taken), F.col("finish").alias(finish), F.col("mix_end").alias(end))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, '')) || ':0') AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w
  FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM c WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level FROM l WHERE cap > w * level ORDER BY cap / w LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN cap <= w * level OR (SELECT count(*) FROM f) = 0 THEN cap ELSE w * (SELECT level FROM f) END AS target FROM l),
p AS (
  SELECT doc_id, source, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start FROM d),
e AS (
  SELECT p.*, t.source_size, t.target, again, unnest(CASE WHEN size > 0 THEN generate_series(0, (size - 1) // 256) ELSE [] END) AS j
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) a(again)),
f2 AS (
  SELECT source, start, target, least(size, (j + 1) * 256) - j * 256 AS words, again * source_size + start + least(size, (j + 1) * 256) AS stop FROM e),
g AS (
  SELECT source, start, words, sum(words) OVER (ORDER BY stop::DOUBLE / target, source NULLS LAST, stop ROWS UNBOUNDED PRECEDING) AS run FROM f2),
h AS (
  SELECT source, start, CAST(sum(greatest(0, least(words, (SELECT floor(1.5::DOUBLE * sum(source_size)) FROM s) - (run - words)))) AS BIGINT) AS taken FROM g GROUP BY ALL)
SELECT p.doc_id, p.size, t.source_size, t.target, coalesce(h.taken, 0) AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
LEFT JOIN h ON h.source IS NOT DISTINCT FROM p.source AND h.start = p.start AND p.size > 0
"""
