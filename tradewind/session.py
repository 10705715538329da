"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that change results or survive-at-scale behaviour. Sizes (executors,
# memory, shuffle partitions) stay with whoever submits the job.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def build_session(app: str = "tradewind", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` uses full Spark keys."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **SESSION, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# What the library itself sets in a session it is given: the zone of days and hours, row counts from Parquet footers, and
# state that may outgrow memory.
SESSION = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",  # else each row put is looked up a second time, for a metric
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in SESSION.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark
