"""Registered queries with SQL, and the pipeline against a plain version."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulsegrid.llm import line_dedup, queries, quality_rules
from tests.llm import brute

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for n in ("documents", "pages", "benchmark", "labels"):
        c.sql(f"create view {n} as select * from '{DIR}/{n}.parquet'")
    a, b = queries.QUERIES[name](spark, DIR).toPandas(), c.sql(queries.ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True).astype(str) for x in (a, b))
    assert a.equals(b)


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))


def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rules = quality_rules.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    rows = {r.doc_id: r for r in docs.collect()}
    judged = {r.doc_id: r for r in quality_rules.with_features(docs, ["doc_id"]).toPandas().itertuples()}
    x = quality_rules.ratios_of(quality_rules.with_features(docs, ["doc_id"]).toPandas().sort_values("doc_id"))
    bad = {i for i, hit in zip(sorted(judged), sum((r.mask(x).astype(int) for r in rules), start=0 * x["words"]), strict=True) if hit}
    keep = [i for i in sorted(rows) if i not in bad and not ((q := brute.quality(rows[i].text))[0] < 20 or 100 * q[4] > 30 * q[0])]
    want = brute.line_removal([(i, rows[i].text) for i in keep])
    cut = {(r.doc_id, r.ln) for r in line_dedup.removed_lines(docs.where(F.col("doc_id").isin(keep))).collect()}
    assert not cut - want and len(want - cut) <= 0.02 * len(want)  # banding finds nearly all
    text = {i: "\n".join(x for n, x in enumerate((rows[i].text or "").split("\n")) if (i, n) not in cut) for i in keep}
    comp = brute.ngram_components(list(text.items()), 5, 80)
    text = {i: t for i, t in text.items() if comp[i][1] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    dirty = {x[0] for x in brute.decontamination(list(text.items()), items) if x[5]}
    mixed = brute.mixing([(i, rows[i].source, t) for i, t in text.items() if i not in dirty])
    want = {i: n for i, (_, _, n) in mixed.items() if n}
    got = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, DIR).collect()}
    assert got == want
