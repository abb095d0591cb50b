"""Joins whose small side is counted before it is sent along."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a counted side may be broadcast; its rows must be narrow.
MOST_ROWS = 100_000


def join_counted(frame: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", most_rows: int = MOST_ROWS) -> DataFrame:
    """Broadcasts ``small`` if it has at most ``most_rows`` rows, counted by one job; else a sort-merge join, whose skew AQE splits."""
    if small.limit(most_rows + 1).count() <= most_rows:
        return frame.join(F.broadcast(small), list(on), how)
    return frame.join(small.hint("merge"), list(on), how)
