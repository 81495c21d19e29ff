"""Sinks for marts and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_mart(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
               partition_by: list[str] | None = None, sort_within: list[str] | None = None) -> str:
    """Write a mart or report table.

    Rows are sorted within each output partition only (no global sort, no
    single-file coalesce), so the write stays fully parallel.
    """
    out = df.sortWithinPartitions(*sort_within) if sort_within else df
    writer = out.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path
