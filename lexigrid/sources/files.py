"""Files and directories as documents."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid import defaults as D
from lexigrid.errors import IngestError
from lexigrid.functions.text import is_blank, newlines

SCHEMA = "document_id string, source string, content string, source_class string, extractor string, metadata map<string,string>"


def contained(path: str, root: str) -> Path:
    """The real path, which must lie below the root."""
    if not path or "\x00" in path:
        raise IngestError("an empty path, or one with a NUL")
    real, base = os.path.realpath(path), os.path.realpath(root)
    if os.path.commonpath([real, base]) != base:
        raise IngestError(f"{path} is not below {root}")
    return Path(real)


def discover(root: str, extensions: Iterable[str] = D.EXTENSIONS) -> list[str]:
    """Files below a directory with one of the extensions, sorted. Directories with a leading dot are skipped, such files are not."""
    wanted = tuple(e.lower() for e in extensions)
    found = []
    for top, folders, names in os.walk(root):
        folders[:] = [f for f in folders if not f.startswith(".")]
        found += [os.path.join(top, n) for n in names if n.lower().endswith(wanted)]
    return sorted(found)


def _reader(extractors: Mapping[str, Extractor]):
    def body(path: str) -> tuple[bytes | None, str | None]:
        if os.path.getsize(path) > D.MAX_FILE_BYTES:
            return None, None
        raw = Path(path).read_bytes()
        own = next((e for suffix, e in extractors.items() if path.lower().endswith(suffix)), None)
        return (own.text(raw).encode(), own.identity) if own else (raw, None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [body(p) for p in rows["source"]]
            yield pd.DataFrame({"source": rows["source"], "body": [b for b, _ in found], "extractor": [e for _, e in found]})

    return run


@dataclass(frozen=True)
class Extractor:
    """Turns the bytes of a format into text. ``identity`` names the rules: citations of its text are bound to it."""

    identity: str
    text: Callable[[bytes], str]


def load_files(spark: SparkSession, paths: list[str], root: str, extractors: Mapping[str, Extractor] | None = None, keep_blank: bool = False) -> DataFrame:
    """Documents of SCHEMA. Paths are checked here; bodies are read by tasks, one row a file.

    A file that is too large or not UTF-8 stops the job; a blank one gives no document
    unless ``keep_blank``. Line ends become LF before any offset is counted. Files whose
    suffix has an extractor (say, one for ".pdf") are read by it; no other format is guessed.
    """
    extractors = dict(extractors or {})
    for p in paths:
        real = contained(p, root)
        if not p.lower().endswith((*D.EXTENSIONS, *extractors)):
            raise IngestError(f"{p}: only {', '.join((*D.EXTENSIONS, *extractors))}")
        if not real.is_file():
            raise IngestError(f"{p} is not a file")
    listing = spark.createDataFrame([(p,) for p in sorted(paths)], "source string")
    bodies = listing.repartition(max(1, min(len(paths), spark.sparkContext.defaultParallelism))).mapInPandas(_reader(extractors), "source string, body binary, extractor string")
    said = lambda what: F.raise_error(F.concat(F.col("source"), F.lit(what))).cast("string")
    text = F.when(F.col("body").isNull(), said(f": over {D.MAX_FILE_BYTES} bytes")).when(~F.is_valid_utf8(F.col("body").cast("string")), said(": not UTF-8")).otherwise(newlines(F.col("body").cast("string")))
    name = F.element_at(F.split("source", "/"), -1)
    meta = F.create_map(F.lit("file_name"), name, F.lit("file_extension"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)))
    kind = F.when(F.col("extractor").isNull(), "text").otherwise("extracted")
    docs = bodies.select(F.sha2(F.col("source").cast("binary"), 256).alias("document_id"), "source", text.alias("content"), kind.alias("source_class"), "extractor", meta.alias("metadata"))
    return docs if keep_blank else docs.filter(~is_blank(F.col("content")))


def load_directory(spark: SparkSession, root: str, extractors: Mapping[str, Extractor] | None = None, keep_blank: bool = False) -> DataFrame:
    return load_files(spark, discover(root, (*D.EXTENSIONS, *(extractors or {}))), root, extractors, keep_blank)
