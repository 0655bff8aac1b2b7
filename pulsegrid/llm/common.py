"""Shared helpers: reading tables, durable intermediate tables, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as maximal runs of characters other than ASCII white space.
SPACE_WORDS = r"[\x20\x09-\x0D]+"
#: Most bytes of a table's Parquet files for a broadcast; in memory it takes some times as many.
BROADCAST_BYTES = 4 << 20
#: Edges of one node that meet in one task.
SPLIT = 200_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one is set only where a local session names none."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = "/tmp/checkpoints/pulsegrid"
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage durably: a lost executor costs only the tasks that were
    running. The files are removed by ``release`` or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pulsegrid-{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    p, fs = _file_system(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(schema).parquet(path)
    out._staged_at = path
    if _owned:
        _owned[-1].append(out)
    return out


def release(*staged: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in staged:
        p, fs = _file_system(df.sparkSession, df._staged_at)
        fs.delete(p, True)


#: Tables staged inside each open ``owner`` block.
_owned: list[list[DataFrame]] = []


@contextmanager
def owner() -> Iterator[list[DataFrame]]:
    """Collects the tables staged inside the block, to be released once what was made of them is written."""
    _owned.append([])
    try:
        yield _owned[-1]
    finally:
        _owned.pop()


def fits(staged: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the files of a staged table, as written, have at most ``limit`` bytes."""
    p, fs = _file_system(staged.sparkSession, staged._staged_at)
    return fs.getContentSummary(p).getLength() <= limit


def bounded(staged: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A staged table, to be broadcast if its files, as written, have at most ``limit`` bytes."""
    return F.broadcast(staged) if fits(staged, limit) else staged


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until ``df`` has no such column."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        out.append(n)
    return out


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(c, UPPER, UPPER.lower())


def null_safe(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in pairs))


def _shape(edges: DataFrame) -> tuple[bool, int]:
    """(whether every node with an edge up has only this one and none down, most edges of a node)."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    # a root has edges down only, a leaf one edge up only
    each = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    r = each.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).alias("open"), F.max(F.col("up") + F.col("down")).alias("most")).first()
    return not r["open"], r["most"] or 0


def _with_lowest(edges: DataFrame, lowest: Column, salts: int) -> DataFrame:
    """The edges (u, v) with ``m``, the least ``lowest`` of the edges of u; the edges of a hot u stay in ``salts`` parts."""
    if salts < 2:
        return edges.join(edges.groupBy("u").agg(F.min(lowest).alias("m")), "u")
    salted = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(salts)))
    parts = salted.groupBy("u", "part").agg(F.min(lowest).alias("low"))
    all_parts = parts.join(parts.groupBy("u").agg(F.min("low").alias("m")), "u").select("u", "part", "m")
    return salted.join(all_parts, ["u", "part"]).drop("part")


def connected_components(edges: DataFrame, max_rounds: int = 60, split: int = SPLIT) -> DataFrame:
    """Distributed union-find by alternating star contraction (large star, small star).

    ``edges`` has comparable columns ``u`` and ``v`` (self loops and repeats allowed,
    nulls are dropped). Returns ``(node, root)``: for every node that has an edge to
    another node, the smallest node of its component. Each round is two grouped
    minima joined back to the edge list, staged in the shared folder; where a node has
    over ``split`` edges, the joins are salted by the other end. Nothing but the shape
    of the edge list (two numbers) reaches the driver.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()
    e = stage(e, "edges")
    for _ in range(max_rounds):
        done, most = _shape(e)
        if done:
            break
        salts = -(-most // split)
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_lowest(both, F.least("u", "v"), salts).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        e2 = _with_lowest(large, F.col("v"), salts)
        small = e2.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).union(
            e2.where("v <> m").select("u", F.col("m").alias("v"))
        ).distinct()
        old, e = e, stage(small, "edges")
        release(old)
    else:
        raise RuntimeError("star contraction did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
