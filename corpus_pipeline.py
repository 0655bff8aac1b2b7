"""Corpus pipeline: quality rules, line dedup, n-gram join, decontamination, mixing.

Each stage reads what its predecessor wrote and applies its decisions:

* ``quality`` drops the documents that the learned list rejects;
* ``lines`` cuts repeated lines from the texts (a document whose lines all repeat stays
  with an empty text);
* ``near_copies`` keeps the document of smallest id of each group of linked ones;
* ``decontaminate`` drops the documents in which a benchmark window occurs;
* ``mix`` returns the documents of which words are taken, whole, with the words taken of
  each (up to twice its own) and the place of its end in the mix.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import decontaminate, line_dedup, mixing, ngram_join, quality_rules
from pulsegrid.llm.common import owner, release, shared_dir, table


#: Tables that the last stage called has staged.
_staged: list[DataFrame] = []


def _stage(step: Callable) -> Callable:
    """A stage that first deletes the tables staged by the one before, whose result has been written by now."""

    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(*[t for t in _staged if t.sparkSession.sparkContext is spark.sparkContext])
        with owner() as mine:
            out = step(spark, docs, sf_dir)
        _staged[:] = mine
        return out

    return run_step


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # no contract binds the stage: five words and a similarity of 0.8
    return ngram_join.one_of_each(docs, k=5, num=80, den=100)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.filter_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality rules", _stage(quality)),
    ("line dedup", _stage(lines)),
    ("n-gram Jaccard join", _stage(near_copies)),
    ("benchmark decontamination", _stage(uncontaminated)),
    ("mixing to target weights", _stage(mix)),
]

#: The n-gram join, the learned list and the line components have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pulsegrid-pipeline-{uuid.uuid4().hex}"
    for i, (_, step) in enumerate(STAGES):
        step(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    release(*_staged)
    _staged.clear()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return docs
