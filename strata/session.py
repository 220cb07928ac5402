"""Session settings that the library's results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "strata", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. Cluster settings stay with spark-submit."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return builder.config(map=settings).getOrCreate()
