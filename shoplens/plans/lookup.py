"""Describing the few rows of a top-k report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def only(described: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    """The rows of a big table whose key is among ``ids``, one column of at most ``rows`` rows.

    The table, unique in that key, is reduced where it is scanned instead of being shuffled.  Both
    sides are broadcast, which ``rows`` bounds; beyond BROADCAST_ROWS Spark chooses the joins itself.
    """
    if rows > BROADCAST_ROWS:
        return described
    return F.broadcast(described.join(F.broadcast(ids), ids.columns, "left_semi"))
