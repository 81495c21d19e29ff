"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Cluster defaults for ~100 TB of events: shuffles start wide and adaptive
# execution coalesces them to ~256 MB partitions (which fit executor memory
# without spilling), splits skewed partitions, and input splits stay at
# 256 MB.  Every value can be overridden at submit time.
CLUSTER_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1024 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
}


def get_spark(master: str | None = None, app: str = "shiftlens",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings every query assumes (UTC, AQE, no UI).

    Local masters get one shuffle partition per core.  Without a master (a
    cluster submit) the :data:`CLUSTER_DEFAULTS` apply unless the submit
    configuration already sets them; the checkpoint folder must come from
    the cluster (``spark.checkpoint.dir``).
    """
    local = bool(master and master.startswith("local"))
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if local:
        parts = shuffle_partitions or int(os.environ.get("SHIFTLENS_SHUFFLE_PARTITIONS", "8"))
        builder = (builder.config("spark.sql.shuffle.partitions", str(parts))
                   .config("spark.driver.memory", os.environ.get("SHIFTLENS_DRIVER_MEMORY", "8g")))
    elif shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_utc(spark)
    if not local:
        conf = spark.sparkContext.getConf()
        for key, value in CLUSTER_DEFAULTS.items():
            if not conf.contains(key) and not (key == "spark.sql.shuffle.partitions" and shuffle_partitions):
                spark.conf.set(key, value)
    return spark


def ensure_utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting is always used when present.  Only a local-mode
    session without one (tests) gets a private folder; a cluster session
    without one is an error, since a driver-local folder is not shared.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local = tempfile.mkdtemp(prefix="shiftlens-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/shiftlens-{name}-{uuid.uuid4().hex[:12]}"


def landed_copy(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, a lost executor re-reads files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
