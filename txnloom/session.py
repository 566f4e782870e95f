"""Session settings for running the jobs of this package."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "txnloom", **settings: str) -> SparkSession:
    """Session with adaptive execution.

    Shuffle width stays with the cluster: AQE merges small partitions and
    splits skewed ones, so no partition count is fixed here.
    """
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Open windows and other state lie on local disk instead of the heap.
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
