"""Session settings the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime SQL settings only, so they can also be applied to a session somebody else created.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Strings that do not match a date pattern become null instead of an upgrade error.
    "spark.sql.legacy.timeParserPolicy": "CORRECTED",
    # "last 2 500 rows per series" is pruned before the shuffle, like smaller limits.
    "spark.sql.optimizer.windowGroupLimitThreshold": "5000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def create_session(app_name: str = "epitide", master: str | None = None, **conf: str) -> SparkSession:
    """Create or get a session; cluster sizing is left to spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())
