"""Joins with tables that are usually small: broadcast only behind a count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000


def attach(df: DataFrame, small: DataFrame, on: Column | list[str], how: str = "inner",
           limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a table of short rows, broadcast if it has at most ``limit`` rows, else shuffled.

    A hot key of the shuffled join is split by Spark's skew handling, which needs a shuffle on both sides.
    """
    few = small.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(small) if few else small.hint("merge"), on, how)
