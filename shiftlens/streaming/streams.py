"""Structured Streaming versions of de-duplication, daily activity and the nudge.

The transformations take and return streaming DataFrames; :func:`run_to_table`
drives one to completion with an ``availableNow`` trigger into a Parquet sink
(append mode, checkpointed) inside the shared checkpoint folder and returns
the sink as a batch DataFrame.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.operators.classify import side_of
from shiftlens.session import scratch_path
from shiftlens.spec import DEFAULT_SPEC, NUDGE_HOURS, RAW_COLUMNS, SHIFT_CREATED, Spec


def with_event_time(sdf: DataFrame, col: str = "event_timestamp", name: str = "event_time") -> DataFrame:
    """Watermarks need ``TIMESTAMP``; the session is UTC, so the cast keeps wall-clock time."""
    return sdf.withColumn(name, F.col(col).cast("timestamp"))


def stream_dedup(sdf: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Drop exact duplicates arriving within the watermark delay of each other."""
    timed = with_event_time(sdf).withWatermark("event_time", watermark)
    return timed.dropDuplicatesWithinWatermark(list(RAW_COLUMNS)).select(*RAW_COLUMNS)


def daily_counts(classified: DataFrame) -> DataFrame:
    """Events per organisation, side and calendar day of a watermarked, classified stream."""
    counts = (classified.groupBy(F.window("event_time", "1 day").alias("w"), "organization_id", "activity_type")
              .agg(F.count(F.lit(1)).alias("n_events")))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("day_start"),
                         F.col("w.end").cast("timestamp_ntz").alias("day_end"),
                         "organization_id", "activity_type", "n_events")


def stream_activity_by_day(sdf: DataFrame, watermark: str = "1 hour", spec: Spec = DEFAULT_SPEC) -> DataFrame:
    """Events per organisation, side and calendar day; a day is emitted once closed."""
    classified = with_event_time(sdf).withColumn("activity_type", side_of("activity_name", spec))
    return daily_counts(classified.withWatermark("event_time", watermark))


def stream_onboarding_nudge(sdf: DataFrame, hours: int = NUDGE_HOURS, watermark: str = "1 hour",
                            spec: Spec = DEFAULT_SPEC) -> DataFrame:
    """Shift creations with no worker event in the following ``hours`` hours.

    Stream-stream left outer join with watermarks on both sides and an
    event-time range condition; a shift is emitted (right side null) once the
    watermark passes its deadline, so state stays bounded.

    The join key is (organisation, day of the shift) rather than the
    organisation alone, so a hot organisation's state is spread over its
    days.  Each worker event is copied into every day a matching shift could
    fall on (``day(w - hours)`` .. ``day(w)``); shifts are never copied, so
    "no match" keeps its exact meaning.
    """
    day = F.lit(86400)
    shifts = (sdf.where(F.col("activity_name") == SHIFT_CREATED)
              .select(F.col("organization_id").alias("s_org"),
                      F.col("event_timestamp").cast("timestamp").alias("shift_ts"))
              .withColumn("s_day", F.floor(F.unix_seconds("shift_ts") / day))
              .withWatermark("shift_ts", watermark))
    w_sec = F.unix_seconds(F.col("event_timestamp").cast("timestamp"))
    workers = (sdf.where(side_of("activity_name", spec) == "worker")
               .select(F.col("organization_id").alias("w_org"),
                       F.col("event_timestamp").cast("timestamp").alias("worker_ts"),
                       F.explode(F.sequence(F.floor((w_sec - F.lit(int(hours) * 3600)) / day),
                                            F.floor(w_sec / day))).alias("w_day"))
               .withWatermark("worker_ts", watermark))
    cond = F.expr(f"s_org = w_org AND s_day = w_day AND worker_ts >= shift_ts "
                  f"AND worker_ts <= shift_ts + INTERVAL {int(hours)} HOURS")
    joined = shifts.join(workers, cond, "leftOuter")
    return (joined.where(F.col("worker_ts").isNull())
            .select(F.col("s_org").alias("organization_id"), F.col("shift_ts").cast("timestamp_ntz").alias("shift_ts"),
                    (F.col("shift_ts").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(hours)))
                    .alias("nudge_due_at")))


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def write_source(df: DataFrame, name: str) -> tuple[str, object]:
    """Land a batch frame as the Parquet files a stream will read."""
    path = scratch_path(df.sparkSession, f"{name}-source")
    df.write.mode("overwrite").parquet(path)
    return path, df.schema


@contextmanager
def state_partitions(spark: SparkSession):
    """Locally one state-store partition per core for a query started inside.

    The number is fixed when a query starts (it runs on a copy of the session
    taken then); on a cluster the session's setting stands.
    """
    previous = spark.conf.get("spark.sql.shuffle.partitions")
    if spark.sparkContext.master.startswith("local"):
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", previous)


def run_to_table(sdf: DataFrame, name: str, timeout_s: int | None = None) -> DataFrame:
    """Run a streaming frame to completion (``availableNow``) into Parquet; read it back.

    Without ``timeout_s`` the call waits as long as the stream runs; an expired
    limit stops the stream and raises instead of returning part of its output.
    """
    spark = sdf.sparkSession
    sink = scratch_path(spark, f"{name}-sink")
    with state_partitions(spark):
        query = (sdf.writeStream.format("parquet").outputMode("append")
                 .option("path", sink).option("checkpointLocation", sink + "-checkpoint")
                 .trigger(availableNow=True).start())
    try:
        if timeout_s is None:
            query.awaitTermination()
            ended = True
        else:
            ended = query.awaitTermination(timeout_s)
    finally:
        if query.isActive:
            query.stop()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    if not ended:
        raise TimeoutError(f"stream {name} did not finish within {timeout_s} s")
    return spark.read.schema(sdf.schema).parquet(sink)
