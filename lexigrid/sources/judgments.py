"""Labelled queries from JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid import defaults as D
from lexigrid.errors import EvaluationError

SCHEMA = "query_id string, query string, category string, gold array<struct<doc:string,quote:string>>, notes string"


def violations(judgments: DataFrame) -> DataFrame:
    """(line, query_id, problem) of judgments (line, SCHEMA) that break a rule."""
    before = F.lag("query_id").over(Window.orderBy("line"))  # a labelled set is one small file; its order is a rule of the format
    safe = F.forall("gold", lambda g: ~g["doc"].startswith("/") & ~g["doc"].contains("\\") & ~F.array_contains(F.split(g["doc"], "/"), ".."))
    n = F.size("gold")
    rules = {
        "query_id is not kebab-case": ~F.col("query_id").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"),
        "unknown category": ~F.col("category").isin(*D.CATEGORIES),
        "no_answer and gold exclude each other": (F.col("category") == "no_answer") != (n == 0),
        "ambiguous needs two gold spans": (F.col("category") == "ambiguous") & (n < 2),
        "doc is not a relative path": ~safe,
        "query_id is not above the one before": F.col("before").isNotNull() & (F.col("before") >= F.col("query_id")),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(what)) for what, bad in rules.items()]), lambda x: x.isNotNull())
    return judgments.withColumn("before", before).select("line", "query_id", F.explode(found).alias("problem"))


def load_judgments(spark: SparkSession, path: str) -> DataFrame:
    """Judgments in order of their lines. Malformed lines and broken rules are errors that name the line."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n", -1)).alias("at", "value")).filter(F.trim("value") != "")
    parsed = lines.select((F.col("at") + 1).alias("line"), F.from_json("value", f"{SCHEMA}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("j")).select("line", "j.*")
    if bad := parsed.filter("_bad IS NOT NULL").orderBy("line").limit(20).collect():
        raise EvaluationError("; ".join(f"line {r.line}: not a judgment" for r in bad))
    read = parsed.drop("_bad")
    if bad := violations(read).orderBy("line").limit(20).collect():
        raise EvaluationError("; ".join(f"line {r.line}: {r.query_id}: {r.problem}" for r in bad))
    return read.orderBy("line").drop("line")
