"""Secret scans with an incremental blob ledger.

Every version of a text is a blob, named by the SHA-256 of its bytes. The ledger, a
table that only grows, holds the pairs (blob, rule version) that were scanned and what
was found. A scan of a delivery takes one copy of each blob for which a pair is missing,
runs only the missing rules on it, and appends to the ledger. Findings are joined back
to all paths by blob: document ids here, (path, version) for a history.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm._shared import cut, shared_dir, table, text_bytes

#: Kind, version, pattern, group whose length counts, least length, RE2 pattern that any match contains.
RULES = (
    ("assign", 1, r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    ("access", 1, r"AKIA[A-Z0-9]+", 0, 18, r"AKIA[A-Z0-9]{14}"),
    ("hex", 1, r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16}"),
    ("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,40}PRIVATE KEY-----", 0, 64, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    ("web_token", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 36, r"eyJ[A-Za-z0-9_-]{10}"),
    ("url_login", 1, r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,80}:([^\s/:@]{6,80})@", 1, 6, r"://[^\s/:@]{1,80}:[^\s/:@]{6,80}@"),
)
KINDS = tuple(r[0] for r in RULES)
SPANS = "array<struct<kind:string,version:int,spans:array<struct<start:int,end:int>>>>"
#: A row for each blob and scan: the rules that ran, and those of them that found something.
LEDGER_SCHEMA = f"blob binary, rules array<struct<kind:string,version:int>>, found {SPANS}"


@lru_cache(maxsize=2)
def _compiled(rules: tuple) -> dict[str, tuple]:
    return {k: (v, re.compile(p, re.ASCII), group, least, hint) for k, v, p, group, least, hint in rules}


def scan_text(text: str, kind: str, rules: tuple = RULES) -> list[tuple[int, int]]:
    """Spans of a kind in code points: leftmost, non-overlapping; a match that is too short is consumed and dropped."""
    _, pattern, group, least, _ = _compiled(rules)[kind]
    return [m.span() for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def _scan(text: Column, missing: Column) -> Column:
    rules = RULES

    @F.pandas_udf(SPANS)
    def run(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        values = texts.tolist()
        found: list[list[dict]] = [[] for _ in values]
        column = pa.array(values, pa.large_string())
        for kind, (version, _, _, _, hint) in _compiled(rules).items():
            hits = pc.match_substring_regex(column, hint).to_numpy(zero_copy_only=False)
            for i in hits.nonzero()[0]:
                if kind in kinds.iloc[i] and (spans := scan_text(values[i], kind, rules)):
                    found[i].append({"kind": kind, "version": version, "spans": [{"start": a, "end": b} for a, b in spans]})
        return pd.Series(found, index=texts.index)

    return run.asNondeterministic()(text, missing)


def _blob(text: Column) -> Column:
    return F.unhex(F.sha2(text_bytes(text), 256))


def _current(rule: Column) -> Column:
    """Whether a rule of the ledger has the version that is in force."""
    return F.concat_ws(":", rule["kind"], rule["version"].cast("string")).isin([f"{r[0]}:{r[1]}" for r in RULES])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger as it is now; empty where nothing was appended yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def scan_unseen(docs: DataFrame, ledger: DataFrame, path: Sequence[str] = ("doc_id",)) -> DataFrame:
    """New ledger rows for (path, text): one for each blob that lacks a rule version, with the rules that ran on it.

    Of equal texts one is scanned: the blobs are found on narrow rows, so only the
    texts that are scanned are shuffled, by path, and no blob is a hot key. A null
    text is the empty blob; a null path is a path like any other; extra columns are
    ignored. An empty table, or one seen before, gives no row.
    """
    own = F.struct(*path)
    blobs = docs.select(own.alias("path"), _blob(F.col("text")).alias("blob")).groupBy("blob").agg(F.min("path").alias("_lx_path"))
    current = F.array(*[F.lit(k) for k in KINDS])
    seen = ledger.select("blob", F.explode(F.filter("rules", _current)).alias("r")).groupBy("blob").agg(F.collect_set("r.kind").alias("seen"))  # at most one of each rule
    wanted = blobs.join(seen, "blob", "left").withColumn("kinds", F.array_except(current, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("kinds") > 0).drop("seen")
    texts = docs.select(own.alias("path"), F.coalesce("text", F.lit("")).alias("text"), _blob(F.col("text")).alias("own"))
    same = (F.col("own") == F.col("blob")) & F.col("path").eqNullSafe(F.col("_lx_path"))
    picked = texts.join(wanted, same).select("blob", "kinds", _scan(F.col("text"), F.col("kinds")).alias("found"))
    version = F.create_map(*[x for r in RULES for x in (F.lit(r[0]), F.lit(r[1]))])
    rules = F.transform("kinds", lambda k: F.struct(k.alias("kind"), F.element_at(version, k).alias("version")))
    return picked.select("blob", rules.alias("rules"), "found").dropDuplicates(["blob"])  # a repeated path with one text gives two equal rows


def scan_delivery(docs: DataFrame, ledger_path: str, path: Sequence[str] = ("doc_id",)) -> None:
    """Scan what the ledger lacks of a delivery and append it; a delivery that is scanned again appends nothing.

    An append is one commit of Spark's, so a job that fails leaves the ledger as it was.
    """
    spark = docs.sparkSession
    scan_unseen(docs, read_ledger(spark, ledger_path), path).write.mode("append").parquet(ledger_path)


def findings_by_path(docs: DataFrame, ledger: DataFrame, path: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(path, blob, found) for every row of ``docs``; found has an entry for each rule in force that found something.

    Blobs with findings are few and are written first; AQE can then split a blob that very many paths share.
    """
    hits = ledger.filter(F.size("found") > 0).select("blob", F.explode(F.filter("found", _current)).alias("f")).groupBy("blob").agg(F.collect_set("f").alias("found"))  # at most one of each rule
    return docs.select(*path, _blob(F.col("text")).alias("blob")).join(cut(hits, "findings"), "blob", "left")


def _found(*kinds: str) -> Column:
    return F.filter(F.coalesce("found", F.array().cast(SPANS)), lambda f: f["kind"].isin(*kinds))


def _spans(kinds: tuple[str, ...]) -> Column:
    order = F.array(*[F.lit(k) for k in KINDS])
    flat = F.flatten(F.transform(_found(*kinds), lambda f: F.transform(f["spans"], lambda s: F.struct(s["start"].alias("start"), F.array_position(order, f["kind"]).alias("place"), s["end"].alias("end"), f["kind"].alias("kind")))))
    return F.array_join(F.transform(F.array_sort(flat), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.aggregate(_found(kind), F.lit(0).cast("long"), lambda n, f: n + F.size(f["spans"]))


def digest(findings: DataFrame) -> DataFrame:
    base = KINDS[:3]
    return findings.select(
        "doc_id", *[_count(k).alias(f"n_{k}") for k in base], F.sha2(_spans(base).cast("binary"), 256).alias("base_sha256"), _spans(KINDS).alias("spans"), F.lower(F.hex("blob")).alias("blob"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, which arrive in two deliveries, each with its sources; the second one finds the blobs of the first in the ledger."""
    docs = table(spark, sf_dir, "documents")
    ledger = f"{shared_dir(spark)}/lexigrid/ledger-{uuid.uuid4().hex}"
    early = F.coalesce(F.crc32(F.col("source").cast("binary")) % 2 == 0, F.lit(False))
    for delivery in (docs.filter(early), docs.filter(~early)):
        scan_delivery(delivery, ledger)
    return digest(findings_by_path(docs, read_ledger(spark, ledger)))
