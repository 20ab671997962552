"""Broadcast only what was counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is, to be joined by shuffle.

    Counting runs the plan of ``df``: give it tables that are stored or derived
    from the queries, never a plan over the corpus.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
