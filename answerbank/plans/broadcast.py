"""Broadcast only what has a checked size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Small configuration tables (rules, caps, grids) up to this many rows are broadcast.
MAX_BROADCAST_ROWS = 100_000


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint when the table has at most ``max_rows`` rows (one cheap bounded count),
    otherwise the plain DataFrame so Spark plans a shuffle join (AQE may still broadcast it)."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
