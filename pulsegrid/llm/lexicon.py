"""Helpers for operators that count words: whole texts in bounded pieces, and the most frequent entries of a counted table."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a piece of a long text.
PIECE = 4 << 20
#: Steps of counts that ``most_frequent`` tells apart in each doubling.
STEPS = 16


def text_pieces(text: bytes, gap: re.Pattern, size: int = PIECE) -> Iterator[bytes]:
    """The whole text in pieces of ``size`` bytes or more, each ending at a match of ``gap`` or at the end."""
    at = 0
    while at < len(text):
        cut = gap.search(text, at + size) if len(text) - at > size else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def most_frequent(counts: DataFrame, n: Column, limit: int) -> Column:
    """A condition that holds for the most frequent rows, at most ``limit`` of them: those at or over a count step.

    A histogram over count steps (some hundred rows, whatever the table's size) gives the step.
    """
    step = F.floor(F.log2(n) * STEPS)
    held, lowest = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).where("step is not null").collect(), reverse=True):
        held += r["rows"]
        if held > limit:
            break
        lowest = r["step"]
    return F.lit(False) if lowest is None else step >= lowest
