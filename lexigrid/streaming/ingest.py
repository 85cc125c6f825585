"""Incremental ingest from a stream of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.operators.joins import BROADCAST_ROWS, hinted
from lexigrid.plans.engine import Engine
from lexigrid.shared import kept, shared_folder


def newest(rows: DataFrame, version: str | None = None) -> DataFrame:
    """(source, content): of each source the text with the highest ``version``, then the greatest one. Only texts of repeated sources are shuffled."""
    rows = rows.filter("source IS NOT NULL")
    repeated = kept(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("source"), "repeated")
    n = repeated.count()
    if not n:
        return rows.select("source", "content")
    repeated = hinted(repeated, n <= BROADCAST_ROWS)
    order = F.struct(*([F.col(version)] if version else []), "content")
    several = rows.join(repeated, "source", "left_semi").groupBy("source").agg(F.max_by("content", order).alias("content"))
    return rows.join(repeated, "source", "left_anti").select("source", "content").union(several)


def stream_into(stream: DataFrame, engine: Engine, name: str, checkpoint: str, version: str | None = None):
    """Start a query that ingests a stream (source, content[, version]) into a collection, a generation for each batch that changes something.

    Of several texts of one source in a batch, the one with the highest ``version``
    stays (without that column: any one of them, the same on every run). A batch that is
    replayed after a failure finds its fingerprints stored and commits nothing, so the
    result is the same as if it had run once. What a batch leaves out is not pruned.
    """

    def write(batch: DataFrame, number: int) -> None:
        engine.ingest(name, newest(batch, version).select(F.sha2(F.col("source").cast("binary"), 256).alias("document_id"), "source", "content"), prune=False)
        engine.collection(name).drop_old()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` as a file stream into a fresh collection; returns its documents at the last generation."""
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    engine = Engine(spark, f"{place}/collections")
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(f"{sf_dir}/documents.parquet*")
    rows = source.select(F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("source"), F.coalesce("text", F.lit("")).alias("content"), F.col("_metadata.file_modification_time").alias("at"))
    stream_into(rows, engine, "documents", f"{place}/progress", "at").awaitTermination()
    return engine.collection("documents").read("documents").select("source", "fingerprint", "n_chars")
