"""Text and columnar formats: numeric matrices, sequence listings, option files."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, values ARRAY<DOUBLE>) of whitespace-separated text matrices, one file a task at least; blank lines don't count."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("row", "line"))
    return whole.select("file", "row", F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("double")).alias("values"))


def matrix_samples(matrix: DataFrame, row: str = "cell", column: str = "frame") -> DataFrame:
    """Long form of ``read_matrix``."""
    return matrix.select("file", F.col("row").alias(row), F.posexplode("values").alias(column, "value"))


def write_matrix(samples: DataFrame, path: str, row: str = "cell", column: str = "frame") -> None:
    """One text line per row, values in column order."""
    line = samples.groupBy(row).agg(F.array_sort(F.collect_list(F.struct(column, "value"))).alias("v"))
    line.orderBy(row).select(F.array_join(F.transform("v", lambda x: x["value"].cast("string")), " ").alias("value")).write.mode("overwrite").text(path)


def read_stimulus(spark: SparkSession, path: str, convert: bool = False) -> DataFrame:
    """(k, t) of a stimulus matrix, or of one row of ids (0 is none) where ``convert``."""
    m = matrix_samples(read_matrix(spark, path), "k", "t").where("value > 0")
    return m.select((F.col("value") - 1).cast("int").alias("k"), "t") if convert else m.select("k", "t")


def write_sequences(best_order: list[int], sequences: DataFrame, path: str) -> None:
    """Text listing: the best order, then ``cells:times#times/category`` per sequence of (cells, times, category)."""
    spark = sequences.sparkSession
    head = spark.createDataFrame([(0, "best_order:" + " ".join(map(str, best_order)))], "k long, value string")
    times = F.array_join(F.transform("times", lambda t: F.array_join(t, " ")), "#")
    tail = F.when(F.col("category").isNotNull(), F.concat(F.lit("/"), F.col("category").cast("string"))).otherwise("")
    body = sequences.select(F.lit(1).cast("long").alias("k"), F.concat(F.array_join("cells", " "), F.lit(":"), times, tail).alias("value"))
    head.union(body).orderBy("k", "value").select("value").write.mode("overwrite").text(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(cells, times, category) of a listing."""
    ints = lambda c: F.transform(F.split(c, " "), lambda x: x.cast("int"))
    lines = spark.read.text(path).where("value not like 'best_order:%'")
    head, rest = F.substring_index("value", ":", 1), F.substring_index("value", ":", -1)
    return lines.select(
        ints(head).alias("cells"),
        F.transform(F.split(F.substring_index(rest, "/", 1), "#"), lambda x: F.transform(F.split(x, " "), lambda y: y.cast("int"))).alias("times"),
        F.when(rest.contains("/"), F.substring_index(rest, "/", -1).cast("int")).alias("category"),
    )


def write_slope_sequences(best_order: list[int], occurrences: DataFrame, path: str) -> None:
    """Text listing of (first_t, last_t, slope, range, cells) after the order."""
    spark = occurrences.sparkSession
    head = spark.createDataFrame([(0, "best_order:" + " ".join(map(str, best_order)))], "k long, value string")
    body = occurrences.select(F.lit(1).cast("long").alias("k"), F.concat_ws(" ", "first_t", "last_t", "slope", "range", F.array_join("cells", " ")).alias("value"))
    head.union(body).orderBy("k", "value").select("value").write.mode("overwrite").text(path)


def write_options(options, path: str, spark: SparkSession) -> None:
    """A dataclass of options as one JSON line."""
    spark.createDataFrame([(json.dumps(asdict(options), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def same_options(options, path: str, spark: SparkSession) -> bool:
    """Whether stored options equal these, numbers of any kind included."""
    return json.loads(spark.read.text(path).first()[0]) == json.loads(json.dumps(asdict(options)))
