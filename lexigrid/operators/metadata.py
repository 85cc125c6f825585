"""Metadata of documents and chunks: maps of strings."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_source(metadata: Column, source: Column) -> Column:
    """A document's metadata with its source, which wins over an entry of that name."""
    return F.map_concat(F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: k != "source"), F.create_map(F.lit("source"), source))


def matches(metadata: Column, wanted: Mapping[str, str] | None) -> Column:
    """Whether all wanted entries are there with just that value. No wish is always met; an absent key never is."""
    each = [F.coalesce(F.element_at(metadata, k) == v, F.lit(False)) for k, v in (wanted or {}).items()]
    return reduce(lambda a, b: a & b, each, F.lit(True))
