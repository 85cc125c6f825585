"""Connected components by label propagation with pointer jumping, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm._shared import cut

#: Rounds after which propagation gives up; each round at least halves the longest chain of labels.
MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of the edges (a, b); label is the smallest node of the component.

    All joins are plain equi-joins, whose skewed partitions AQE splits; the minimum
    over a node's neighbours is combined before the shuffle. Each round is written
    to the shared folder. No edge gives no row.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a AS node", "least(a, m) AS label"), "labels")
    for _ in range(MAX_ROUNDS):
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        lowered = labels.join(seen.withColumnRenamed("a", "node"), "node").selectExpr("node", "label AS old", "least(label, m) AS label")
        lowered = cut(lowered, "labels")
        jump = lowered.selectExpr("node AS label", "label AS further")
        stepped = cut(lowered.join(jump, "label", "left").selectExpr("node", "old", "least(label, coalesce(further, label)) AS label"), "labels")
        labels = stepped.select("node", "label")
        if stepped.filter("label <> old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
