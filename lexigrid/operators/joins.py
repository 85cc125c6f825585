"""Broadcasts of sides whose size was checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side of short rows is broadcast.
BROADCAST_ROWS = 500_000
#: Bytes of its files up to which a table of queries is taken for small without being counted.
SMALL_BYTES = 4 * 1024 * 1024


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a stated table (queries, quotes: no result of a search) has at most ``rows`` rows.

    The optimizer's estimate decides where it comes from small files; only where it
    says nothing, as for rows that the driver made, the table itself is counted.
    """
    known = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(known) <= SMALL_BYTES or df.limit(rows + 1).count() <= rows


def hinted(df: DataFrame, small: bool) -> DataFrame:
    """``df`` with a broadcast hint if it is small; else Spark shuffles, and AQE splits skewed partitions."""
    return F.broadcast(df) if small else df
