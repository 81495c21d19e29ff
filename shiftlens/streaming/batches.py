"""Streams over several micro-batches: time-ordered sources, resumable runs, chained state, a keyed sink.

A run works off the files of its source a few at a time
(``maxFilesPerTrigger``), so watermarks move and state is closed between
batches.  Sink and checkpoint belong to a folder: running again with the same
folder goes on where the last run stopped, whether it ended or was stopped.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.operators.classify import side_of
from shiftlens.session import scratch_path
from shiftlens.spec import DEFAULT_SPEC, RAW_COLUMNS, Spec
from shiftlens.streaming.streams import daily_counts, state_partitions, with_event_time

PROGRESS = "batch_id long, input_rows long, watermark string, late_rows long, state_rows long"
ROWS_A_FILE = 100_000  # of a time-ordered source, about
MAX_FILES = 1000       # a slice
STOP_POLL = 0.02       # seconds
NUDGE = "organization_id string, first_unanswered_shift_at timestamp_ntz, nudge_due_at timestamp_ntz, shifts long"


class Run(NamedTuple):
    """The sink so far, one progress row per batch of this run, and whether the source was worked off."""

    table: DataFrame
    batches: DataFrame
    ended: bool


def files_a_slice(rows: int, slices: int) -> int:
    """Files that a slice of ``rows`` rows in all is landed as, so that many tasks write and read it."""
    return min(MAX_FILES, max(1, -(-rows // (slices * ROWS_A_FILE))))


def land_in_order(df: DataFrame, column: str, slices: int, name: str, files: int = 1) -> tuple[str, object]:
    """Land a batch frame as Parquet files in time order: slice by slice, by quantiles of ``column``.

    Every slice has exactly ``files`` files (the last may have fewer), empty ones if it takes
    that, so a micro-batch of as many files is one slice.  Rows with a null time come with
    the first slice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-ordered")
    at = F.unix_micros(F.col(column).cast("timestamp"))
    cuts = df.agg(F.percentile_approx(at, [i / slices for i in range(1, slices)])).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]), 1):
        part = df if lo is None else df.where(at > lo)
        part = part if hi is None else part.where((at <= hi) | at.isNull() if lo is None else at <= hi)
        part = part.repartition(files, *df.columns) if files > 1 else part.coalesce(1)
        part.write.mode("append").parquet(path)
        if files > 1 and hi is not None:
            written = len(spark.read.schema(df.schema).parquet(path).inputFiles())
            for _ in range(i * files - written):  # a file for every part without rows
                spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(path)
    return path, df.schema


def ordered_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """File stream in order of arrival, ``files_per_batch`` files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _progress(query) -> list[tuple]:
    rows = []
    for p in query.recentProgress:
        states = p["stateOperators"]
        rows.append((p["batchId"], p["numInputRows"], (p["eventTime"] or {}).get("watermark"),
                     sum(s["numRowsDroppedByWatermark"] for s in states), sum(s["numRowsTotal"] for s in states)))
    return rows


def run_batches(sdf: DataFrame, folder: str, sink=None, stop_after: int | None = None) -> Run:
    """Work off what the source holds, writing below ``folder``; a later call with it resumes.

    Without ``sink`` the rows go to a Parquet table (exactly once through its
    commit log); ``sink`` is a function (batch, batch_id) that must be
    idempotent per batch.  ``stop_after`` stops the query after that many
    batches with rows.
    """
    spark = sdf.sparkSession
    out = f"{folder}/table"
    writer = (sdf.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
              .trigger(availableNow=True))
    writer = writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", out)
    with state_partitions(spark):
        query = writer.start()
    ended = False
    try:
        while not ended:
            # A run to be stopped is watched closely: one stopped between its last rows and the batch that
            # closes their windows would leave them open, since a resumed query starts with new rows only.
            ended = query.awaitTermination(1 if stop_after is None else STOP_POLL)
            if not ended and stop_after is not None:
                if sum(p["numInputRows"] > 0 for p in query.recentProgress) >= stop_after:
                    break
    finally:
        if query.isActive:
            query.stop()
    if ended and query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    table = spark.createDataFrame([], sdf.schema) if sink else spark.read.schema(sdf.schema).parquet(out)
    return Run(table, spark.createDataFrame(_progress(query), PROGRESS), ended)


def activity_from_raw(raw: DataFrame, watermark: str = "1 hour", spec: Spec = DEFAULT_SPEC) -> DataFrame:
    """Daily counts straight from the duplicated raw stream: two stateful operators in one query.

    Copies are dropped within the watermark, rows outside their trial or without
    an organisation go, and what is left is counted by organisation, side and day.
    """
    timed = with_event_time(raw).withWatermark("event_time", watermark)
    staged = (timed.dropDuplicatesWithinWatermark(list(RAW_COLUMNS))
              .where(F.col("organization_id").isNotNull()
                     & F.col("event_timestamp").between(F.col("trial_start"), F.col("trial_end"))))
    return daily_counts(staged.withColumn("activity_type", side_of("activity_name", spec)))


class NudgeSink:
    """One nudge per organisation, whatever is replayed.

    Every batch writes its own folder of the table and then one ledger entry,
    which commits it.  A batch keeps the organisations that no earlier committed
    batch has nudged, with their first unanswered shift; running a batch again
    overwrites its folder with the same rows.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        for kind, schema in (("nudges", NUDGE), ("ledger", "received long, nudged long")):
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/{kind}/batch_id=-1")

    def ledger(self) -> DataFrame:
        return self.spark.read.schema("received long, nudged long, batch_id long").parquet(f"{self.folder}/ledger")

    def nudges(self) -> DataFrame:
        """Nudges of committed batches."""
        table = self.spark.read.schema(f"{NUDGE}, batch_id long").parquet(f"{self.folder}/nudges")
        return table.join(self.ledger().select("batch_id"), "batch_id", "left_semi")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        first = batch.groupBy("organization_id").agg(
            F.min("shift_ts").alias("first_unanswered_shift_at"), F.min("nudge_due_at").alias("nudge_due_at"),
            F.count(F.lit(1)).alias("shifts"))
        earlier = self.nudges().where(F.col("batch_id") < batch_id).select(F.col("organization_id").alias("__nudged"))
        new = first.join(earlier, F.col("organization_id").eqNullSafe(F.col("__nudged")), "left_anti")
        path = f"{self.folder}/nudges/batch_id={batch_id}"
        new.write.mode("overwrite").parquet(path)
        written = self.spark.read.schema(NUDGE).parquet(path)
        (written.agg(F.coalesce(F.sum("shifts"), F.lit(0)).alias("received"), F.count(F.lit(1)).alias("nudged"))
         .coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/ledger/batch_id={batch_id}"))
