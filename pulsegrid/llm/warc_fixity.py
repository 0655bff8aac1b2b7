"""Merkle fixity audit of WARC replicas.

Pages are laid out as WARC records, ordered in files of ``per_file`` ids, each with its
byte offset. A leaf is the SHA-256 of a record's place (file, sequence, offset, length)
and bytes; a node is the SHA-256 of its up to ``fan`` children in order, so every node
stands for one ordered offset range. Replicas are compared by file roots, and only the
children of nodes that differ are compared on the level below. A fault that changes a
record's length moves all later ones of its file; so of the records that the descent ends
at, those whose bytes stand elsewhere in the same file of the other replica are sound.

Defined cases: null urls and html are empty, a null id has a file of its own (``null``);
repeated rows are further records in a fixed order; a record that the other replica lacks
is reported alone, though the rest of its file has moved; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.llm.common import stage, table

PER_FILE, FAN, LEVELS = 512, 8, 4


def record_bytes(html: Column | None = None) -> Column:
    """A resource record as text; its length counts UTF-8 bytes."""
    body = F.coalesce(F.col("html") if html is None else html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("null")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce("url", F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def leaves(pages: DataFrame, html: Column | None = None, per_file: int = PER_FILE) -> DataFrame:
    """(file, seq, page_id, start, length, record_sha256, leaf): one row per record."""
    r = pages.select("page_id", F.floor(F.col("page_id") / per_file).alias("file"), record_bytes(html).alias("r")).select(
        "page_id", "file", F.octet_length("r").cast("long").alias("length"), F.sha2("r", 256).alias("record_sha256")
    )
    order = W.partitionBy("file").orderBy("page_id", "record_sha256")
    r = r.withColumn("seq", F.row_number().over(order).cast("long") - 1)
    r = r.withColumn("start", F.sum("length").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("length"))
    return r.withColumn("leaf", F.sha2(F.concat_ws(":", F.coalesce(F.col("file").cast("string"), F.lit("null")), "seq", "start", "length", "record_sha256"), 256))


def tree(leaf: DataFrame, fan: int = FAN, levels: int = LEVELS) -> list[DataFrame]:
    """Nodes (file, node, hash) by level, leaves first; the last level has one node a file."""
    out = [leaf.select("file", F.col("seq").alias("node"), F.col("leaf").alias("hash"))]
    for k in range(1, levels + 1):
        up = F.floor(F.col("node") / fan) if k < levels else F.lit(0).cast("long")
        kids = F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"])
        out.append(out[-1].withColumn("up", up).groupBy("file", "up").agg(F.sha2(F.array_join(kids, ""), 256).alias("hash")).withColumnRenamed("up", "node"))
    return out


def audit(a: DataFrame, b: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(file, seq): the records in which two replicas' leaves differ, found from the roots down."""
    ta, tb = tree(a, fan, levels), tree(b, fan, levels)
    suspect = None
    for k in range(levels, -1, -1):
        x, y = ta[k], tb[k]
        if suspect is not None:
            below = lambda d, k=k: d.withColumn("up", F.floor(F.col("node") / fan) if k + 1 < levels else F.lit(0).cast("long")).join(  # noqa: E731, B023
                suspect, F.col("file").eqNullSafe(F.col("s_file")) & (F.col("up") == F.col("s_node")), "left_semi"
            )
            x, y = below(x), below(y)
        y = y.select(F.col("file").alias("y_file"), F.col("node").alias("y_node"), F.col("hash").alias("y_hash"))
        both = x.join(y, F.col("file").eqNullSafe(F.col("y_file")) & (F.col("node") == F.col("y_node")), "full")
        differ = both.where(~F.col("hash").eqNullSafe(F.col("y_hash")))
        found = differ.select(F.when(F.col("node").isNull(), F.col("y_file")).otherwise(F.col("file")).alias("s_file"), F.coalesce("node", "y_node").alias("s_node"))
        suspect = stage(found, f"fixity{k}")
    return suspect.select(F.col("s_file").alias("file"), F.col("s_node").alias("seq"))


def damaged(a: DataFrame, b: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(file, seq): the records of replica ``a`` that are altered or missing in ``b``, wherever they stand in their file."""
    bad = audit(a, b, fan, levels).withColumnsRenamed({"file": "s_file", "seq": "s_seq"})
    files = stage(bad.select("s_file").distinct(), "files")
    # equal records of a file are told apart by their order
    nth = F.row_number().over(W.partitionBy("file", "record_sha256").orderBy("seq"))
    in_files = lambda d: d.join(files, F.col("file").eqNullSafe(F.col("s_file")), "left_semi").select("file", "seq", "record_sha256", nth.alias("nth"))
    other = in_files(b).select(F.col("file").alias("o_file"), F.col("record_sha256").alias("o_sha"), F.col("nth").alias("o_nth"))
    same = F.col("file").eqNullSafe(F.col("o_file")) & (F.col("record_sha256") == F.col("o_sha")) & (F.col("nth") == F.col("o_nth"))
    lost = in_files(a).join(other, same, "left_anti")
    return stage(lost.join(bad, F.col("file").eqNullSafe(F.col("s_file")) & (F.col("seq") == F.col("s_seq")), "left_semi").select("file", "seq"), "damaged")


def rotten(html: Column) -> Column:
    """What a second replica holds: one page in 61 lost its last character to a fault, which keeps its length."""
    return F.when((F.col("page_id") % 61 == 7) & (F.length(html) > 0), F.concat(F.expr("left(html, length(html) - 1)"), F.lit("\x00"))).otherwise(html)


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    a = stage(leaves(pages), "replica")
    b = stage(leaves(pages, rotten(F.col("html"))), "replica")
    bad = damaged(a, b).withColumnsRenamed({"file": "b_file", "seq": "b_seq"})
    out = a.join(bad, F.col("file").eqNullSafe(F.col("b_file")) & (F.col("seq") == F.col("b_seq")), "left")
    return out.select("page_id", "file", "seq", F.col("start").alias("offset"), "length", "record_sha256", F.col("b_seq").isNull().alias("intact"))


OP7_SQL = r"""
WITH b AS (
  SELECT page_id, CAST(floor(page_id / 512) AS BIGINT) AS file, coalesce(html, '') AS body, coalesce(url, '') AS url FROM pages),
r AS (
  SELECT page_id, file, body, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'null')
    || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
    || CAST(octet_length(encode(body)) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM b),
s AS (SELECT page_id, file, body, CAST(octet_length(encode(rec)) AS BIGINT) AS length, sha256(rec) AS record_sha256 FROM r)
SELECT page_id, file, row_number() OVER w - 1 AS seq, CAST(sum(length) OVER w - length AS BIGINT) AS "offset", length, record_sha256,
  NOT coalesce(page_id % 61 = 7 AND length(body) > 0, false) AS intact
FROM s WINDOW w AS (PARTITION BY file ORDER BY page_id, record_sha256 ROWS UNBOUNDED PRECEDING)
"""
