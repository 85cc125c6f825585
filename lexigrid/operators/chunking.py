"""Chunks: offset-addressed pieces of documents."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid import defaults as D
from lexigrid.errors import ConfigError
from lexigrid.functions.text import content_hash, is_blank


def check_sizes(size: int, overlap: int) -> None:
    if size < 1 or overlap < 0 or overlap >= size:
        raise ConfigError(f"chunk size {size} and overlap {overlap}: the overlap must be smaller, both not negative")


def chunk_id(document_id: Column, index: Column, hash_: Column) -> Column:
    """Stable ids, so that no order depends on chance."""
    return F.sha2(F.concat_ws("\x1f", document_id.cast("string"), index.cast("string"), hash_).cast("binary"), 256)


def content_key(hash_: Column) -> Column:
    """The first 60 bits of a hash: a number that sorts as the hash does, and travels in its place."""
    return F.conv(F.substring(hash_, 1, 15), 16, 10).cast("bigint")


def _finish(spans: DataFrame) -> DataFrame:
    hashed = spans.withColumn("content_hash", content_hash(F.col("content"))).withColumn("content_key", content_key(F.col("content_hash")))
    return hashed.withColumn("chunk_id", chunk_id(F.col("document_id"), F.col("chunk_index"), F.col("content_hash")))


def whole_documents(docs: DataFrame) -> DataFrame:
    """Each document (document_id, source, content) as one chunk."""
    return _finish(docs.select("document_id", "source", F.lit(0).alias("chunk_index"), F.lit(0).alias("start_offset"), F.length("content").alias("end_offset"), "content"))


def fixed_windows(docs: DataFrame, size: int = D.CHUNK_SIZE, overlap: int = D.CHUNK_OVERLAP) -> DataFrame:
    """Windows of fixed size; blank ones are dropped, the first that reaches the end is the last. Narrow: no shuffle.

    A text is cut into steps once, and a window is put together from its steps, so the
    work grows with the text's length and not with its square.
    """
    check_sizes(size, overlap)
    step = max(1, size - overlap)
    steps = F.regexp_extract_all(F.col("content"), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    last = F.ceil(F.greatest(F.length("content") - size, F.lit(0)) / step).cast("int")
    of = lambda i: F.substring(F.array_join(F.slice("steps", i + 1, -(-size // step)), ""), 1, size)
    windows = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.struct((i * step).alias("start"), of(i).alias("text")))
    cut = docs.filter("length(content) > 0").select("document_id", "source", steps.alias("steps"), last.alias("last"))
    spans = cut.select("document_id", "source", F.posexplode(F.filter(windows, lambda w: ~is_blank(w["text"]))).alias("chunk_index", "w"))
    return _finish(spans.select("document_id", "source", "chunk_index", F.col("w.start").alias("start_offset"), (F.col("w.start") + F.length("w.text")).alias("end_offset"), F.col("w.text").alias("content")))


def recursive_spans(text: str, size: int = D.CHUNK_SIZE, overlap: int = D.CHUNK_OVERLAP, separators: Sequence[str] = D.SEPARATORS) -> list[tuple[int, int]]:
    """Spans of a text by a cascade of separators.

    A worklist of ranges, each with the separators that are still allowed: a range
    that fits is a span; one that does not is cut at its first separator into runs
    of parts, which go back on the list with the later separators. A run ends where
    the next part would make it too long; the next run starts with those last parts
    of it that fit into the overlap. Without a separator, fixed windows remain.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0)]
    while todo:
        lo, hi, level = todo.pop()
        if hi - lo <= size:
            if text[lo:hi].strip():
                out.append((lo, hi))
            continue
        at = next((k for k in range(level, len(separators)) if separators[k] and text.find(separators[k], lo, hi) >= 0), None)
        if at is None:
            step = max(1, size - overlap)
            last = -(-max(0, hi - lo - size) // step)
            out += [(s, e) for s, e in ((lo + k * step, min(lo + k * step + size, hi)) for k in range(last + 1)) if text[s:e].strip()]
            continue
        todo += [(a, b, at + 1) for a, b in reversed(_runs(text, lo, hi, separators[at], size, overlap))]
    return out


def _runs(text: str, lo: int, hi: int, separator: str, size: int, overlap: int) -> list[tuple[int, int]]:
    starts, ends = [lo], []
    while (found := text.find(separator, starts[-1], hi)) >= 0:
        ends.append(found)
        starts.append(found + len(separator))
    ends.append(hi)
    runs, first = [], 0
    for k in range(1, len(starts) + 1):
        if k < len(starts) and (first == k or ends[k] - starts[first] <= size):
            continue
        if k == len(starts):
            runs.append((starts[first], ends[-1]))
            break
        runs.append((starts[first], ends[k - 1]))
        # the overlap counts a separator for each part that is kept
        kept, room = k, overlap
        while overlap > 0 and kept > first and (need := ends[kept - 1] - starts[kept - 1] + len(separator)) <= room:
            room -= need
            kept -= 1
        first = kept
    return runs


def recursive_chunks(docs: DataFrame, size: int = D.CHUNK_SIZE, overlap: int = D.CHUNK_OVERLAP, separators: Sequence[str] = D.SEPARATORS, carried: Sequence[str] = ()) -> DataFrame:
    """Chunks of documents by the cascade, with the columns ``carried`` of their documents. Only spans come out of Python; texts are cut on the JVM side."""
    check_sizes(size, overlap)

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in recursive_spans(t or "", size, overlap, separators)] for t in texts], index=texts.index)

    each = docs.select("document_id", "source", "content", *carried, spans.asNondeterministic()(F.col("content")).alias("spans")).select("document_id", "source", "content", *carried, F.posexplode("spans").alias("chunk_index", "w"))
    return _finish(each.select("document_id", "source", *carried, "chunk_index", F.col("w.start").alias("start_offset"), F.col("w.end").alias("end_offset"), F.substring("content", F.col("w.start") + 1, F.col("w.end") - F.col("w.start")).alias("content")))
