"""Session settings for the jobs, the benchmark and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Bytes one shuffle task should read: small enough to stay in memory next to
# its sort buffers, large enough that a 100 TB shuffle is ~800 k tasks, not more.
TASK_BYTES = 128 << 20

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES),
    "spark.sql.parquet.compression.codec": "snappy",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def shuffle_partitions(shuffled_bytes: int, cores: int) -> int:
    """Initial shuffle width for a job: AQE merges what turns out too fine."""
    return max(cores, -(-shuffled_bytes // TASK_BYTES))


def session(app: str, master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
