"""Joins whose small side is broadcast only after its rows are counted."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows of a few short values that a task can hold as the broadcast side of a join
BROADCAST_ROWS = 1_000_000


def counted_side(stored: DataFrame, rows: int) -> DataFrame:
    """A stored table of short rows, broadcast when its ``rows`` are few; otherwise the other side is shuffled to it."""
    return F.broadcast(stored) if rows <= BROADCAST_ROWS else stored
