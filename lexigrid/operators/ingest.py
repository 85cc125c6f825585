"""Incremental ingest as set operations on tables: what changed, what went, what stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.errors import IngestError
from lexigrid.functions.text import is_blank

#: Enters every fingerprint, so that other chunking settings make all documents new.
DEFAULT_SETTINGS = '{"chunker":"recursive","chunk_size":512,"chunk_overlap":64}'


def fingerprint(content: Column, settings: str = DEFAULT_SETTINGS) -> Column:
    """A digest of content and chunking settings, each ended by NUL."""
    return F.sha2(F.concat(content.cast("binary"), F.lit(bytearray(b"\x00")), F.lit(settings).cast("binary"), F.lit(bytearray(b"\x00"))), 256)


def diff_sources(current: DataFrame, stored: DataFrame, settings: str = DEFAULT_SETTINGS) -> DataFrame:
    """Status of each current source (source, content) against the stored (source, fingerprint): new, changed, unchanged or emptied.

    Only fingerprints are joined, never texts.
    """
    now = current.select("source", is_blank(F.col("content")).alias("blank"), fingerprint(F.col("content"), settings).alias("fingerprint"))
    known = stored.select("source", F.col("fingerprint").alias("old"))
    both = now.join(known, "source", "left")
    status = F.when(F.col("blank"), F.when(F.col("old").isNull(), F.lit("blank")).otherwise("emptied")).when(F.col("old").isNull(), "new").when(F.col("old") == F.col("fingerprint"), "unchanged").otherwise("changed")
    return both.select("source", "fingerprint", status.alias("status"))


def below(source: Column, root: str) -> Column:
    """Whether a source is ``root`` or lies below it: a sibling that only begins with the same letters does not. Without a root, all are."""
    if not root:
        return F.lit(True)
    bare = root.rstrip("/")
    return (source == bare) | (source == root) | source.startswith(f"{bare}/")


def pruned_sources(current: DataFrame, stored: DataFrame, root: str) -> DataFrame:
    """Stored sources below ``root`` that the current listing lacks."""
    return stored.filter(below(F.col("source"), root)).select("source").join(current.select("source"), "source", "left_anti")


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The stored rows with those of ``new`` in the place of equal sources."""
    return stored.join(new.select("source").distinct(), "source", "left_anti").unionByName(new)


def orphans(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks whose document is not registered: a write that leaves any is refused."""
    return chunks.join(documents.select("document_id"), "document_id", "left_anti")


def refuse_orphans(chunks: DataFrame, documents: DataFrame) -> None:
    if bad := orphans(chunks, documents).select("document_id").distinct().limit(5).collect():
        raise IngestError(f"chunks of documents that are not registered: {[r.document_id for r in bad]}")


def refuse_repeats(rows: DataFrame, key: str) -> None:
    if bad := rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(5).collect():
        raise IngestError(f"{key} occurs more than once: {[r[key] for r in bad]}")


def report(status: DataFrame, pruned: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of totals. ``chunks`` are those of new and changed sources."""
    seen = status.agg(
        F.count(F.lit(1)).alias("files_seen"), F.count_if(F.col("status").isin("new", "changed")).alias("documents_indexed"),
        F.count_if(F.col("status") == "unchanged").alias("documents_skipped"), F.count_if(F.col("status") == "emptied").alias("documents_emptied"),
    )
    gone = pruned.agg(F.count(F.lit(1)).alias("documents_pruned"))
    written = chunks.agg(F.count(F.lit(1)).alias("chunks_written"))
    return seen.crossJoin(gone).crossJoin(written)  # three single rows
