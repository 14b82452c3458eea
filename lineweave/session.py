"""Session defaults for large line files."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "lineweave", **conf: str) -> SparkSession:
    """A session with adaptive execution and one shuffle partition for each core at least; AQE
    coalesces small partitions and splits skewed ones. Keywords override (dots as two underscores)."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        # more samples per partition: range slices stay within a few percent of each other
        "spark.sql.execution.rangeExchange.sampleSizePerPartition": "400",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
