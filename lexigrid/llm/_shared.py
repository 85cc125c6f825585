"""Helpers that the operators of this subpackage share.

Nothing here keeps rows on the driver: ``cut`` writes a table to the shared
folder, ``gapless_index`` numbers rows with two narrow shuffles, and
``join_small`` broadcasts a side only after its rows were counted.
"""

from __future__ import annotations

import ctypes
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.operators.layout import spread
from lexigrid.shared import kept as cut
from lexigrid.shared import shared_folder as shared_dir

#: Bytes of ASCII letters A-Z in lower case, all others as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Rows up to which a side with short fixed-width rows may be broadcast.
BROADCAST_ROWS = 1_000_000


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: None


def release() -> None:
    """Give back what a batch needed: workers wait beside those of the next stage, and should hold little then."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, df.columns[0])


def located(df: DataFrame) -> DataFrame:
    """Add where each row lies: ``_lx_file`` and ``_lx_at``, which no other row has, and ``_lx_part``, the number of the file its writer made.

    ``df`` must read files; any other table is written first.
    """
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        df = cut(df, "located")
    part = F.coalesce(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long"), F.lit(0))
    return df.select("*", F.xxhash64("_metadata.file_path").alias("_lx_file"), F.col("_metadata.row_index").alias("_lx_at"), part.alias("_lx_part"))


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, null as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def join_small(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join; ``right`` (short rows) is broadcast if it has at most ``rows`` rows, else both sides are shuffled.

    In the shuffled case AQE splits skewed partitions of the left side.
    """
    if right.limit(rows + 1).count() <= rows:
        right = F.broadcast(right)
    return left.join(right, list(on), how)


def gapless_index(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, buckets: int = 4096) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... without bringing a group into one task.

    A group is cut into ``buckets`` by a hash of the order columns, so the order
    is (bucket, order columns). Bucket sizes are summed first (at most ``buckets``
    narrow rows a group meet in one window), then rows are numbered per bucket.
    Rows equal in all order columns are interchangeable. ``df`` is read twice.
    """
    marked = df.withColumn("_lx_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    keys = [*group, "_lx_bucket"]
    before = Window.partitionBy(*group).orderBy("_lx_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_lx_n")).withColumn("_lx_start", F.coalesce(F.sum("_lx_n").over(before), F.lit(0))).drop("_lx_n")
    within = marked.withColumn("_lx_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return within.join(starts, keys).withColumn(name, F.col("_lx_start") + F.col("_lx_row") - 1).drop("_lx_bucket", "_lx_start", "_lx_row")


def stored_index(df: DataFrame, group: Sequence[str], name: str, stretch: int = 65_536) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... in the order in which ``located`` files hold them.

    Stretches of a file are numbered by themselves; only their sizes (a narrow row a
    group, file and stretch) meet in one window. ``df`` is read twice.
    """
    marked = df.withColumn("_lx_stretch", F.expr(f"_lx_at DIV {stretch}"))
    keys = [*group, "_lx_part", "_lx_file", "_lx_stretch"]
    before = Window.partitionBy(*group).orderBy("_lx_part", "_lx_file", "_lx_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_lx_n")).withColumn("_lx_start", F.coalesce(F.sum("_lx_n").over(before), F.lit(0))).drop("_lx_n")
    within = marked.withColumn("_lx_row", F.row_number().over(Window.partitionBy(*keys).orderBy("_lx_at")))
    return within.join(starts, keys).withColumn(name, F.col("_lx_start") + F.col("_lx_row") - 1).drop("_lx_stretch", "_lx_start", "_lx_row")
