"""Staging layers landed once per session as Parquet tables in the shared folder.

Raw events -> staged events -> per-organisation roll-up are the models every
report reads (the warehouse materialises them the same way).  Each layer is
written once per (session, input signature) and read back as Parquet, so
later queries get column pruning and filter pushdown instead of re-running
the de-duplication and the roll-up.  The signature (name, size and
modification time of every input file, through the Hadoop file system)
invalidates a layer when the input changes.
"""

from __future__ import annotations

import hashlib
import threading

from pyspark.sql import DataFrame, SparkSession

from shiftlens.session import checkpoint_root, scratch_path

_LOCK = threading.RLock()
_TABLES: dict[tuple, str] = {}


def input_signature(spark: SparkSession, path: str) -> tuple:
    """Path, number, total size and a digest of (name, size, time) of the input's files."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append((f.getPath().toString(), int(f.getLen()), int(f.getModificationTime())))
    digest = hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()
    return path, len(seen), sum(size for _, size, _ in seen), digest


def landed_path(spark: SparkSession, source_path: str, name: str, build, partition_by=None) -> str:
    """Folder of Parquet table ``name`` derived from ``source_path``, written on first use."""
    key = (spark.sparkContext.applicationId, checkpoint_root(spark), name, input_signature(spark, source_path))
    with _LOCK:
        path = _TABLES.get(key)
        if path is None:
            path = scratch_path(spark, name)
            df = build()
            if partition_by:
                # One or a few writers per folder; adaptive execution splits large ones.
                df = df.hint("rebalance", *partition_by)
            writer = df.write.mode("overwrite")
            if partition_by:
                writer = writer.partitionBy(*partition_by)
            writer.parquet(path)
            _TABLES[key] = path
    return path


def landed(spark: SparkSession, source_path: str, name: str, build, partition_by=None) -> DataFrame:
    """Parquet table ``name`` derived from ``source_path``, written on first use.

    Each call returns a fresh reader over the files, so plans that use a
    table twice get distinct attributes (no self-join de-duplication).
    """
    return spark.read.parquet(landed_path(spark, source_path, name, build, partition_by))
