"""Result listings of cell assemblies and cluster statistics, and the catalogue of stored fits.

Listings are lines with a recording and a place; Spark's text writer puts them into one
folder a recording, in order, under its own commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a fit stores beside its score, one text matrix each.
PARTS = ("alpha", "beta", "w", "b", "sigma", "tau_r", "tau_d", "gamma", "L")


def _spans(events: DataFrame, by: list[str], name: str) -> DataFrame:
    """First and last frames of events in order, joined by #."""
    one = F.transform(F.array_sort(F.collect_list(F.struct("sce_id", "start_frame", "end_frame"))), lambda x: F.concat_ws(" ", x["start_frame"].cast("string"), x["end_frame"].cast("string")))
    return events.groupBy(*by).agg(F.array_join(one, "#").alias(name))


def assembly_lines(options: dict[str, object], recordings: DataFrame, cells: DataFrame, sces: DataFrame, sce: DataFrame, sce_cells: DataFrame) -> DataFrame:
    """(recording_id, section, place, value): the listing of a recording's cell assemblies.

    ``cells(recording_id, assembly, cell)``, ``sces(recording_id, assembly, sce_id)`` are the
    assemblies found, ``sce`` the events' spans and ``sce_cells`` their cells. A recording
    without assemblies has the line NONE. An event of one assembly is single, of more multiple.
    """
    head = recordings.select("recording_id", F.posexplode(F.array(F.lit("#PARAM#"), F.concat(F.lit("data_id "), "recording_id"), *[F.lit(f"{k} {v}") for k, v in options.items()], F.lit("#CELL_ASSEMBLIES#"))).alias("place", "value"))
    out = head.select("recording_id", F.lit(0).alias("section"), "place", "value")

    def add(section: int, rows: DataFrame, place: Column, *value: Column) -> None:
        nonlocal out
        out = out.union(rows.select("recording_id", F.lit(section).alias("section"), place.cast("int").alias("place"), F.concat(*value).alias("value")))

    text = lambda c: F.col(c).cast("string")
    none = recordings.join(cells.select("recording_id").distinct(), "recording_id", "left_anti")
    add(1, none, F.lit(0), F.lit("NONE"))
    lists = cells.groupBy("recording_id", "assembly").agg(F.array_join(F.sort_array(F.collect_list("cell")).cast("array<string>"), " ").alias("cells"))
    add(1, lists, F.col("assembly"), F.lit("SCA_cluster:"), text("assembly"), F.lit(":"), F.col("cells"))
    each = sces.groupBy("recording_id", "sce_id").agg(F.sort_array(F.collect_set("assembly")).alias("ids")).join(sce.select("recording_id", "sce_id", "start_frame", "end_frame"), ["recording_id", "sce_id"])
    many, one = each.where(F.size("ids") > 1), each.where(F.size("ids") == 1).withColumn("assembly", F.col("ids")[0])
    add(2, many, F.col("sce_id"), F.lit("MCA_SCE:"), text("start_frame"), F.lit(" "), text("end_frame"), F.lit(":"), F.array_join(F.col("ids").cast("array<string>"), " "))
    add(3, _spans(one, ["recording_id", "assembly"], "spans"), F.col("assembly"), F.lit("single_sce_in_ca:"), text("assembly"), F.lit(":"), F.col("spans"))
    add(4, _spans(many, ["recording_id"], "spans"), F.lit(0), F.lit("multiple_sce_in_ca:"), F.col("spans"))
    # the single events of its assembly in which a cell is active
    active = one.join(cells, ["recording_id", "assembly"]).join(sce_cells.select("recording_id", "sce_id", "cell"), ["recording_id", "sce_id", "cell"])
    spans = cells.select("recording_id", "cell").join(_spans(active, ["recording_id", "cell"], "spans"), ["recording_id", "cell"], "left")
    add(5, spans, F.col("cell"), F.lit("cell:"), text("cell"), F.lit(":"), F.coalesce("spans", F.lit("")))
    return out


def statistics_lines(head: list[str], recordings: DataFrame, sce_stats: DataFrame, labels: DataFrame, cell_labels: DataFrame, digits: int = 2) -> DataFrame:
    """(recording_id, section, place, value): statistics of the events of each cluster, then of each event.

    ``sce_stats(recording_id, sce_id, duration, max_cells, mean_cells, n_cells)``, ``labels(recording_id,
    sce_id, label)``, ``cell_labels(recording_id, cell, cluster)``.
    """
    out = recordings.select("recording_id", F.posexplode(F.array(*[F.lit(h) for h in head])).alias("place", "value")).select("recording_id", F.lit(0).alias("section"), "place", "value")
    said = (("Duration", "duration"), ("Overall participation", "n_cells"), ("Max participation", "max_cells"), ("Mean participation", "mean_cells"))
    number = lambda c: F.round(c, digits).cast("string")
    s = sce_stats.join(labels, ["recording_id", "sce_id"])
    per = s.groupBy("recording_id", "label").agg(F.count("*").alias("n"), *[f(c).cast("double").alias(f"{k}_{c}") for _, c in said for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("median", F.median))])
    n_cells = cell_labels.groupBy("recording_id", F.col("cluster").alias("label")).agg(F.count("*").alias("cells"))
    per = per.join(n_cells, ["recording_id", "label"], "left").fillna(0, ["cells"])
    bar = "#" * 10
    title = F.concat(F.lit(f"{bar}   cluster "), F.col("label").cast("string"), F.lit(" / "), F.col("n").cast("string"), F.lit(" events / "), F.col("cells").cast("string"), F.lit(f" cells{bar}"))
    lines = [title, *[F.concat(F.lit(f"{t}: mean "), number(f"mean_{c}"), F.lit(", std "), number(f"std_{c}"), F.lit(", median "), number(f"median_{c}")) for t, c in said]]
    clusters = per.select("recording_id", "label", F.posexplode(F.array(*lines)).alias("i", "value")).select("recording_id", F.lit(1).alias("section"), (F.col("label") * len(lines) + F.col("i")).cast("int").alias("place"), "value")
    each = [F.concat(F.lit("SCE "), F.col("sce_id").cast("string")), F.concat(F.lit("Duration_in_frames "), F.col("duration").cast("string")), *[F.concat(F.lit(f"{t} "), number(F.col(c).cast("double"))) for t, c in said[1:]]]
    events = sce_stats.select("recording_id", "sce_id", F.posexplode(F.array(*each)).alias("i", "value")).select("recording_id", F.lit(2).alias("section"), (F.col("sce_id") * len(each) + F.col("i")).cast("int").alias("place"), "value")
    return out.union(clusters).union(events)


def write_listing(lines: DataFrame, path: str) -> None:
    """One folder ``recording_id=...`` a recording; its lines stand in order in one file."""
    # a recording's lines go to one task, which sorts them with spilling and writes them one by one
    lines.repartition("recording_id").sortWithinPartitions("recording_id", "section", "place", "value").select("recording_id", "value").write.partitionBy("recording_id").text(path)


def read_assemblies(spark: SparkSession, path: str) -> DataFrame:
    """(recording_id, assembly, cell) of listings written by ``write_listing``."""
    rows = spark.read.schema("value string, recording_id string").text(path).where("value like 'SCA_cluster:%'")
    parts = F.split("value", ":")
    return rows.select("recording_id", parts[1].cast("int").alias("assembly"), F.explode(F.split(parts[2], " ").cast("array<int>")).alias("cell"))


def fits(spark: SparkSession, folder: str) -> DataFrame:
    """(fit, modified, bytes, parts, complete): one row for each folder below ``folder`` that holds a part of a fit, by file metadata alone.

    Spark lists the folder of folders, in parallel where there are many; no file is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length")
    named = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("fit"), F.regexp_extract("path", r"([^/]+)$", 1).alias("part"), "modificationTime", "length")
    known = named.where(F.col("part").isin(*PARTS, "x", "x_test", "score"))
    out = known.groupBy("fit").agg(F.max("modificationTime").alias("modified"), F.sum("length").alias("bytes"), F.array_sort(F.collect_set("part")).alias("parts"))
    return out.withColumn("complete", F.size(F.array_except(F.array(*[F.lit(p) for p in PARTS]), "parts")) == 0)


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """(fit, score): the stored log posterior of each fit, read where there is one."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "score").text(folder).select(F.input_file_name().alias("path"), "value").where(F.trim("value") != "")
    return rows.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("fit"), F.trim("value").cast("double").alias("score"))


def best_fit(spark: SparkSession, folder: str) -> DataFrame:
    """(fit, score, parts) of the complete fit of best score; of equals the first by name."""
    rows = fits(spark, folder).where("complete").join(scores(spark, folder), "fit").where("score is not null and not isnan(score)")
    return rows.orderBy(F.desc("score"), "fit").limit(1).select("fit", "score", "parts")


def fit_values(spark: SparkSession, folder: str, chosen: DataFrame) -> DataFrame:
    """(fit, part, row, column, value) of the text matrices of the chosen fits; a part of one number is row 0, column 0."""
    text = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.input_file_name().alias("path"), "value")
    named = text.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("fit"), F.regexp_extract("path", r"([^/]+)$", 1).alias("part"), "value").where(F.col("part").isin(*PARTS, "x", "x_test"))
    lines = named.join(chosen.select("fit"), "fit", "left_semi").select("fit", "part", F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("row", "line"))
    return lines.select("fit", "part", "row", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("column", "value")).withColumn("value", F.col("value").cast("double"))


def write_fit(values: DataFrame, score: float, path: str) -> None:
    """Store a fit: ``values(part, row, column, value)`` as one text matrix a part, and its score, for ``fits`` to find.

    Parts are gathered line by line; each line is one row of a matrix.
    """
    from pyarrow import fs

    spark = values.sparkSession
    lines = values.groupBy("part", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", "value"))), lambda x: x["value"].cast("string")), " ").alias("line"))

    def write(batches):
        import pandas as pd

        files, top = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        files.create_dir(top, recursive=True)
        for pdf in batches:
            for part, text in zip(pdf["part"], pdf["text"], strict=True):
                with files.open_output_stream(f"{top}/{part}") as out:
                    out.write(text.encode())
            yield pd.DataFrame({"part": pdf["part"]})

    whole = lines.groupBy("part").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))
    whole = whole.union(spark.range(1).select(F.lit("score").alias("part"), F.lit(f"{score!r}\n").alias("text")))
    whole.mapInPandas(write, "part string").count()
