"""Session settings for panel jobs."""
from __future__ import annotations

from pyspark.sql import SparkSession

_TARGET_BYTES = 128 * 1024 * 1024


def cluster_settings(shuffled_bytes: int) -> dict[str, str]:
    """Spark settings for a job whose largest shuffle moves about ``shuffled_bytes``.

    Shuffles start with enough partitions for the whole volume; AQE then merges small
    ones, splits skewed joins and re-plans joins from measured sizes.
    """
    partitions = max(8, -(-int(shuffled_bytes) // _TARGET_BYTES))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(_TARGET_BYTES),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(2 * _TARGET_BYTES),
        "spark.sql.session.timeZone": "UTC",
    }


def local_session(
    cores: int = 8, memory: str = "8g", extra: dict[str, str] | None = None
) -> SparkSession:
    """Small session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("monthloom")
    settings = {
        **cluster_settings(0),
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        "spark.driver.memory": memory,
        **(extra or {}),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
