"""The corpus pipeline: quality rules, near-duplicates, decontamination, source mixing, sharding.

Each stage reads what the one before it wrote. The first three drop documents, the
fourth orders them by the mixing schedule (its output files follow the slots), the
last assigns shards, whose slots follow that order, and returns one row a document:
doc_id, size, text_crc32, shard and slot. SQL cannot express the stages, so
``ORACLE_SQL`` is None and tests compare with brute force.

All stages take nulls in any column, empty and very long texts, repeated rows, ties,
extra columns and empty tables; what each makes of them is said where it is defined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigrid.llm import fertility_rules, kd_sharding, odd_minhash, pfair_mixing, simhash_leaks
from lexigrid.llm._shared import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text passes the base rules and the bands of its language. A null or empty text fails; rows that repeat an id are judged each."""
    return fertility_rules.keep_fluent(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near-duplicates. Texts without words are in no group and stay, as do rows without an id; rows that repeat an id go or stay together."""
    return odd_minhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item. Null and empty texts hold none; rows that repeat an id go together; a row without an id is judged by its own text."""
    return simhash_leaks.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixing schedule. A null source is a source of its own; repeated rows are placed each."""
    return pfair_mixing.in_mixed_order(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and a slot for every document; in a shard, slots follow the mixing schedule. A null text has size 1."""
    return kd_sharding.shard_documents(docs, in_order=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
