"""Join helper: broadcast a side only after checking its size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A word list this long (~20 MB as a hash table) is still cheap to ship to
# every executor; longer lists are joined by shuffling both sides on the key.
BROADCAST_MAX_ROWS = 500_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """`df` with a broadcast hint when it has at most `max_rows` rows, else
    unchanged.  The check counts at most max_rows + 1 rows (one small job),
    so it is bounded however large `df` is.  Without it, a side with no
    size estimate (e.g. a frame made from a local list) leaves the choice to
    runtime statistics, which may broadcast the large side instead."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
