"""Counts of thin cells are added up by the frames of their spikes, and equal the products over all frames."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators import follow_blocks, transitions
from pulsegrid.sources import tables as S


S_SCHEMA = T.StructType([T.StructField("recording_id", T.StringType()), T.StructField("cell", T.IntegerType()), T.StructField("frame", T.IntegerType())])


def side(rng, cells, n, most):
    rows = [{"cell": c, "frames": sorted(rng.choices(range(-3, n + 3) if c % 3 else range(n), k=rng.randrange(1, most)))} for c in range(cells)]
    return follow_blocks.Side(pa.array(rows, pa.struct([("cell", pa.int32()), ("frames", pa.list_(pa.int32()))])), n)


@pytest.mark.parametrize(("low", "high"), [(1, 3), (0, 1), (-2, 4), (5, 5), (3, 90)])
def test_sums_are_the_products(monkeypatch, low, high):
    monkeypatch.setattr(follow_blocks, "STRIP", 7)
    monkeypatch.setattr(follow_blocks, "NARROW", 2)
    rng = random.Random(9)
    a, b = side(rng, 30, 60, 9), side(rng, 41, 60, 9)
    assert a.thin and b.thin and not side(rng, 5, 60, 200).thin
    rolls = np.arange(30) * 7 % 60, np.arange(41) * 11 % 60
    for src, dst in ((a, b), (b, a), (a, a)):
        same, offsets = src is dst, {30: rolls[0], 41: rolls[1]}
        for own, other in ((None, None), (offsets[len(src)], offsets[len(dst)])):
            got = np.concatenate([n for _, n, _ in follow_blocks.products(src, dst, low, high, same, False, own, other)])
            want = np.concatenate([n for _, n, _ in follow_blocks.products(src, dst, low, high, same, True, own, other)])
            assert got.dtype == np.uint8 and (got == want).all()


def test_a_pair_of_parts_is_counted_once_in_each_direction(monkeypatch):
    """Weights less those the other way round: two counts of a pair of parts, where there were four, both directions from them."""
    rng = random.Random(2)
    a, b = side(rng, 30, 60, 9), side(rng, 41, 60, 9)
    made, products = [], follow_blocks.products

    def counted(*args, **o):
        made.append(args[:2])
        return products(*args, **o)

    held = {}
    monkeypatch.setattr(follow_blocks, "NARROW", 2)
    monkeypatch.setattr(follow_blocks, "products", counted)
    monkeypatch.setattr(follow_blocks, "pair_blocks", lambda s, r, key, each, schema, skip, rates: held.setdefault("each", each))
    spikes = type("Spikes", (), {"schema": S_SCHEMA})
    transitions.transitions(spikes, None, 1, 3, no_reverse=True, lags=False)
    got = {(x["src"], x["dst"]) for x in pa.Table.from_batches(held["each"](a, b, {"recording_id": "r"})).to_pylist()}
    assert got and len(made) == 2


def test_no_reverse_weighed_by_rates(spark, monkeypatch):
    monkeypatch.setattr(follow_blocks, "MOST", 3)
    monkeypatch.setattr(follow_blocks, "LEAST", 3)
    monkeypatch.setattr(follow_blocks, "NARROW", 2)
    rng = random.Random(5)
    s = spark.createDataFrame(sorted({("r", rng.randrange(14), rng.randrange(90)) for _ in range(200)}), S.SPIKES)
    r = spark.createDataFrame([("r", 14, 90)], "recording_id string, n_cells int, n_frames int")
    rates = s.groupBy("recording_id", "cell").agg((F.count("*") / 90).alias("rate")).where("cell <> 4")
    plain = {(x.src, x.dst): x.weight for x in transitions.transitions(s, r, 1, 3, lags=False).collect()}
    rate = {x.cell: x.rate for x in rates.collect()}
    left = lambda c: 1 - rate[c] if c in rate else 0.0
    want = {(a, d): w * left(d) - plain.get((d, a), 0) * left(a) for (a, d), w in plain.items()}
    want = {k: pytest.approx(v) for k, v in want.items() if v > 1e-12}
    got = {(x.src, x.dst): x.weight for x in transitions.transitions(s, r, 1, 3, rates=rates, no_reverse=True, lags=False).collect()}
    assert {k: v for k, v in got.items() if v > 1e-12} == want
