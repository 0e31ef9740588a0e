"""Broadcasting only what was measured to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 100_000
MAX_BYTES = 16 * 1024 * 1024


def is_small(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """Whether rows and text size stay within the bounds; reads at most ``max_rows + 1`` rows."""
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))
    rows, width = df.limit(max_rows + 1).agg(F.count("*"), size).first()
    return rows <= max_rows and width <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Hint a broadcast for a table that fits the bounds; any other is joined by shuffling.

    Without the hint Spark guesses from static estimates, which are unknown for rows made
    on the driver and wrong after filters; it could even broadcast the fact side.  Beyond
    the bounds adaptive execution joins by measured sizes and splits hot keys.
    """
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df
