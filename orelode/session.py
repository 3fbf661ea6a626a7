"""A session with the settings the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, memory: str = "4g", **conf: str) -> SparkSession:
    """Adaptive execution with skew joins, UTC, Arrow; ``master`` and memory only where no cluster sets them."""
    builder = SparkSession.builder.appName("orelode")
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master:
        builder = builder.master(master)
        settings["spark.driver.memory"] = memory
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
