"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from pulsegrid.plans import catalogue

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in NAMES:
        c.sql(f"create view {n} as select * from '{DIR}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    a = catalogue.QUERIES[name](spark, DIR).toPandas()
    b = duck.sql(catalogue.ORACLES[name]).df()
    assert set(a.columns) == set(b.columns)
    cols = sorted(a.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in cols:
        if a[c].dtype.kind in "fi":
            assert (a[c].astype(float) - b[c].astype(float)).abs().max() < 1e-6 or not len(a)
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all()


ROWS = {
    "sequence_search": ["recording_id", "cells", "times"], "graph_waves": None, "graph_paths": None, "fca_merges": None, "fca_tree": None, "fca_clusters": None, "latent_fit": None, "latent_parts": None, "component_order": None, "order_loss": ["recording_id", "order_id", "loss"],
    "peak_events": ["recording_id", "sce_id", "start_frame", "end_frame", "peak_frame"], "oscillations": None, "band_passed": ["recording_id", "cell", "frame", "value"],
    "sce_no_redundancy": ["recording_id", "sce_id", "start_frame", "end_frame"], "order_repetitions": None, "train_dither": ["recording_id", "cell", "t"], "kmeans_events": None, "assembly_cells": None,
}


@pytest.mark.parametrize("name", sorted(ROWS))
def test_kernel_queries_run_and_repeat(spark, name):
    """Queries without SQL give the same rows twice; their kernels are tested apart."""
    df = catalogue.QUERIES[name](spark, DIR)
    rows = sorted(map(repr, df.collect()))
    assert ROWS[name] is None or set(ROWS[name]) <= set(df.columns)
    assert rows == sorted(map(repr, catalogue.QUERIES[name](spark, DIR).collect()))


def test_entry_without_the_other_package():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
