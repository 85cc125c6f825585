"""How a table lies over tasks before heavy work on each of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Tables of fewer or more bytes are left as their files lie.
LEAST_BYTES, SPREAD_BYTES = 4 * 1024 * 1024, 256 * 1024 * 1024


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal out a small table that lies in fewer files than there are cores: a scan cannot split a file's row group.

    Only the optimizer's estimate and the names of the files are looked at. A tiny or
    large table, and one in many files, is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if not LEAST_BYTES <= size <= SPREAD_BYTES or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores, key)
