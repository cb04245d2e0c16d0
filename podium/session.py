"""Spark session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# AQE splits skewed partitions of plain joins, also where that costs the aggregate above one more shuffle.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Shuffled ids compress to a few bytes a row: 64 MB of them, the default, are more rows than a task sorts in memory.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # A join whose smaller side has no larger partition than that is hashed: its larger side, mostly a log, is not sorted.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "16m",
    # The planner takes a stored table for as large as its files and broadcasts it if that is little. Rows of ids and short
    # codes are some 15 times as large in memory, which the driver has to hold; what a shuffle measures is not multiplied.
    "spark.sql.sources.fileCompressionFactor": "32",
    # Lets a "first n per group" filter trim every group before the shuffle, up to the longest ordered list.
    "spark.sql.optimizer.windowGroupLimitThreshold": "33000",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("podium")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**RUNTIME_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to a session made elsewhere."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables, named by the cluster.

    Only a local master may fall back to a temporary folder: on a cluster the executors would not see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="podium-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it does not exist yet."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
