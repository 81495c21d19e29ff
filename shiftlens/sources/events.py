"""Readers for the raw product-event log."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlens.sources.quarantine import parse_boolean, parse_events, parse_timestamp
from shiftlens.spec import RAW_COLUMNS, TIMESTAMP_COLUMNS

HEADER_READERS = 16  # files whose header line is read at once
EVENT_SCHEMA = T.StructType([
    T.StructField("organization_id", T.StringType()),
    T.StructField("activity_name", T.StringType()),
    T.StructField("event_timestamp", T.TimestampNTZType()),
    T.StructField("converted", T.BooleanType()),
    T.StructField("converted_at", T.TimestampNTZType()),
    T.StructField("trial_start", T.TimestampNTZType()),
    T.StructField("trial_end", T.TimestampNTZType()),
])


def normalise_columns(df: DataFrame, header=None) -> DataFrame:
    """Lower-case the header and name the event time ``event_timestamp``; of equal names the first column stays.

    ``header`` gives the names where those of ``df`` are not the file's own
    (Spark's CSV reader renames repeated ones).
    """
    names = [c.strip().lower() for c in header or df.columns]
    if "event_timestamp" not in names:
        names = ["event_timestamp" if c == "timestamp" else c for c in names]
    places = [f"{c}#{i}" for i, c in enumerate(names)]
    first = [i for i, c in enumerate(names) if c not in names[:i]]
    return df.toDF(*places).select(*[F.col(f"`{places[i]}`").alias(names[i]) for i in first])


def coerce_timestamps(df: DataFrame, cols=TIMESTAMP_COLUMNS) -> DataFrame:
    """Parse timestamp columns; values that do not parse become null."""
    return df.withColumns({c: parse_timestamp(c) for c in cols if c in df.columns})


def coerce_boolean(df: DataFrame, c: str = "converted") -> DataFrame:
    return df.withColumn(c, parse_boolean(c)) if c in df.columns else df


def header_groups(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """CSV files under ``path`` by header (lower case, in order).

    One line of each file is read through Hadoop's file system, as listing the
    folder does; files without a line are left out.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    files = []
    listed = fs.listFiles(root, True)
    while listed.hasNext():
        file = listed.next().getPath()
        below = file.toString()[len(root.toString()):].split("/")
        if not any(part.startswith(("_", ".")) for part in below if part):
            files.append(file)

    def header(file) -> tuple[str, ...]:
        stream = fs.open(file)
        try:
            codec = codecs.getCodec(file)
            plain = codec.createInputStream(stream) if codec is not None else stream
            line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine()
        finally:
            stream.close()
        return tuple(c.strip().lower() for c in next(csv.reader([(line or "").lstrip("\ufeff")]), []))

    groups: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        for file, names in zip(files, pool.map(header, files)):
            if names:
                groups.setdefault(names, []).append(file.toString())
    return groups


def _read_csv(spark: SparkSession, paths) -> DataFrame:
    return spark.read.option("header", True).option("mode", "PERMISSIVE").option("inferSchema", False).csv(paths)


def read_events(spark: SparkSession, path: str, fmt: str = "csv", with_rejects: bool = False) -> DataFrame:
    """Scan the event log (CSV with header, or Parquet) into the canonical schema.

    CSV columns are taken by header name as strings, so that no row is lost to a
    parse error; types are then coerced column by column.  Column order, header
    case and extra columns are free and may differ from file to file: files are
    grouped by their header, each group is read by name and the groups are
    united.  A column that a file lacks is null.  ``with_rejects`` adds the
    values that did not parse (see :mod:`shiftlens.sources.quarantine`).
    """
    if fmt == "csv":
        groups = header_groups(spark, path)
        frames = [normalise_columns(_read_csv(spark, files), names) for names, files in sorted(groups.items())] or [
            spark.createDataFrame([], EVENT_SCHEMA)]
    else:
        frames = [normalise_columns(spark.read.format(fmt).load(path))]
    out = reduce(DataFrame.unionByName, map(parse_events, frames))
    return out if with_rejects else out.select(*RAW_COLUMNS)
