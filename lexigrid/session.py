"""A session with the settings that the plans count on. On a cluster, pass its own through spark-submit."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(**settings: str) -> SparkSession:
    conf = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.showConsoleProgress": "false",
    } | {k: str(v) for k, v in settings.items()}
    return SparkSession.builder.appName("lexigrid").config(map=conf).getOrCreate()
