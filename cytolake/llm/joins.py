"""Joins whose small side is broadcast only after its rows are counted."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows of a few short values that a task can hold as the broadcast side of a join
BROADCAST_ROWS = 1_000_000


def broadcast_if_few(stored: DataFrame, rows: int | None = None) -> DataFrame:
    """A stored table of short rows, broadcast when it has few of them; otherwise the other side is shuffled to it.

    ``rows`` is the number of values it holds where that is known and larger than its number of rows.
    """
    return F.broadcast(stored) if (stored.count() if rows is None else rows) <= BROADCAST_ROWS else stored
