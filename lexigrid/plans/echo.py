"""The echo check: does an answer cite the source that holds the answer, and nothing that it was not shown?

A case shows a model two sources that read alike: one answers the question and holds a
marker, the other one holds a marker of another subject. A third marker is in neither.
Markers hold no brackets, so they are never taken for citations or redaction tokens.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.errors import EvaluationError
from lexigrid.functions import text as T
from lexigrid.operators import citations, context
from lexigrid.providers import Chat, guarded

CASES = 5
QUESTION = "Under which code is the restart of the payment service filed?"
SOURCE = "Operations handbook: the restart of the {subject} service is filed under the code {marker}. Every step is written there."
PROMPT = "{sources}\n\nAnswer from the sources alone and cite them as [n].\n{question}"
SCHEMA = "case int, source string, content string, positive boolean, marker string, absent string"


def make_cases(spark: SparkSession, cases: int = CASES) -> DataFrame:
    """(SCHEMA): two sources a case, the one that answers first, with markers that were drawn afresh."""
    rows = []
    for n in range(cases):
        markers = [f"lexigrid-echo-{secrets.token_hex(16)}" for _ in range(3)]
        for subject, positive, marker in (("payment", True, markers[0]), ("mailing", False, markers[1])):
            rows.append((n, f"echo://{n}/{subject}", SOURCE.format(subject=subject, marker=marker), positive, marker, markers[2]))
    return spark.createDataFrame(rows, SCHEMA)


def score_answers(answers: DataFrame, cases: DataFrame, current: DataFrame) -> DataFrame:
    """(case, outcome, grounded, leaked, correct) of answers (case, answer); a null answer was refused.

    A citation is grounded if its source still holds the text, and the text the marker.
    The case is correct if only the first source is cited, grounded, and the marker that
    was not shown does not occur.
    """
    shown = cases.groupBy("case").agg(F.count(F.lit(1)).alias("n"), F.first("absent").alias("absent"))
    read = answers.join(shown, "case").withColumn("cited", T.markers(F.col("answer"))).withColumn("bad", T.marker_out_of_range(F.col("answer"), F.col("n")))
    outcome = (
        F.when(F.col("answer").isNull() | F.col("bad"), "rejected").when(F.array_contains("cited", F.lit(2).cast("bigint")), "cited_decoy")
        .when(F.array_contains("cited", F.lit(1).cast("bigint")), "cited_positive").otherwise("abstained")
    )
    spans = cases.filter("positive").select("case", "source", F.lit("text").alias("source_class"), F.lit(None).cast("string").alias("extractor"), F.lit(0).alias("start_offset"), F.length("content").alias("end_offset"), F.col("content").alias("expected"), "marker")
    held = citations.verify(spans, current).select("case", ((F.col("verdict") == "verified") & F.contains("expected", "marker")).alias("held"))
    scored = read.withColumn("outcome", outcome).join(held, "case")
    grounded = (F.col("outcome") == "cited_positive") & F.col("held")
    leaked = F.coalesce(F.contains("answer", "absent"), F.lit(False))
    return scored.select("case", "outcome", grounded.alias("grounded"), leaked.alias("leaked"), (grounded & ~leaked).alias("correct"))


def echo_check(spark: SparkSession, chat: Chat, cases: int = CASES) -> tuple[DataFrame, dict]:
    """Ask a model every case; returns the scored cases and their tallies, which must add up."""
    chat, made = guarded(chat), make_cases(spark, cases).collect()
    rows = []
    for n in range(cases):
        own = [r.content for r in made if r.case == n]
        numbered = spark.createDataFrame([(own,)], "c array<string>").select(T.numbered_sources(F.col("c")).alias("x")).first().x
        rows.append((n, chat.complete(PROMPT.format(sources=numbered, question=QUESTION)).strip() or None))
    table = spark.createDataFrame(made, SCHEMA)
    scored = score_answers(spark.createDataFrame(rows, "case int, answer string"), table, table.select("source", "content"))
    totals = context.echo_tallies(scored).first().asDict() | scored.agg(F.count_if("correct").alias("correct"), F.count_if("leaked").alias("leaked")).first().asDict()
    if totals["n"] != cases or sum(totals[o] for o in context.ECHO_OUTCOMES) != cases:
        raise EvaluationError("the outcomes do not add up to the cases")
    return scored, totals
