"""The n-gram join compares only sets that share as many parts as linked ones must."""

import random

import numpy as np
import pytest

from pulsegrid.llm import ngram_join
from tests.llm import brute


def test_texts_in_a_chain_of_passages_meet_in_no_block(spark, monkeypatch):
    """Each text shares a passage with the next: one block of all of them before, of which no two are linked."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(100_000)]
    passages = [rng.sample(words, 40) for _ in range(61)]
    rows = [(i, " ".join(passages[i] + rng.sample(words, 420) + passages[i + 1])) for i in range(60)]
    near = rows[7][1].split(" ")
    rows += [(500, " ".join(near[:-1] + ["x"])), (501, " ".join(near + ["y"]))]
    met, links = [], ngram_join._links_in_blocks

    def counted(members, *a, **o):
        met.append({r.node for r in members.select("node").collect()})
        return links(members, *a, **o)

    monkeypatch.setattr(ngram_join, "_links_in_blocks", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect()}
    assert got == brute.ngram_components(rows, 5, 80) and got[500][1] == got[501][1] == 7
    assert 3 <= len(met[0]) <= 6


@pytest.mark.parametrize(("num", "den"), [(85, 100), (80, 100), (70, 100)])
def test_linked_sets_share_as_many_keys_as_the_bound_says(num, den):
    rng = np.random.default_rng(8)
    levels = ngram_join.Levels(num, den)
    for n in [*range(2, 80), 150, 400, 900, 2000]:
        for _ in range(4):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            out = int(rng.integers(0, levels.differences(n) // 2 + 1))  # as many go as come, and then as many more come as may
            more = levels.differences(n) - 2 * out if rng.random() < 0.5 else 0
            y = np.unique(np.concatenate([x[rng.permutation(n)[out:]], rng.integers(0, 1 << 63, out + more, dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            if den * both < num * (len(x) + len(y) - both):
                continue
            low, high = sorted((x, y), key=len)
            of = {level: (full, weak, need, shared) for level, full, weak, need, shared in levels.keys(high)}
            level, full, weak, need, shared = levels.keys(low)[0]
            if levels.differences(levels.low[level + 1] - 1) == 0:
                continue
            other = of[level]
            # a weak key counts if either has no bound of full ones
            mine, theirs = ((np.concatenate([f, w]) if need == 0 or other[2] == 0 else f) for f, w in ((full, weak), other[:2]))
            met = len(np.intersect1d(mine, theirs))
            assert met >= shared and met >= other[3]
