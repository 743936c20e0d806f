"""Session defaults: adaptive execution, UTC and RocksDB state for stateful streams."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def get_spark(app: str = "tidewatch", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the engine's defaults; on a cluster, master comes from spark-submit."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .config("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master).config("spark.driver.memory", "8g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The folder for checkpoints that the cluster names; a temporary one only where none is set (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(found)
        return found
    name = os.path.join(tempfile.gettempdir(), "tidewatch-checkpoints")
    sc.setCheckpointDir(name)
    return name
