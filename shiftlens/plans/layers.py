"""A worker-adoption mart that is refreshed day by day.

The activity-day layer holds one row per (organisation, activity, day),
partitioned by day.  Refreshing some days rewrites those partitions alone
(dynamic partition overwrite); the roll-up is then recomputed for the
organisations that these days touch, before or after the refresh, and the
mart's other rows are carried over.  Every refresh writes a new version of the
mart and then its ``CURRENT`` entry, so readers and a refresh that dies midway
keep the last complete version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.functions.columns import days_between
from shiftlens.operators.classify import classify_events
from shiftlens.operators.features import daily_activity, rollup_daily
from shiftlens.operators.marts import mart_from_rollup
from shiftlens.session import landed_copy
from shiftlens.spec import DEFAULT_SPEC, Spec


class AdoptionLayers:
    """Activity-day layer and mart below one folder of the shared file system."""

    def __init__(self, spark: SparkSession, folder: str, spec: Spec = DEFAULT_SPEC) -> None:
        self.spark, self.folder, self.spec = spark, folder, spec

    def _exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def daily(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/daily")

    def version(self) -> int:
        """Number of the mart's last complete version, 0 before the first."""
        if not self._exists("current"):
            return 0
        return self.spark.read.schema("version long").parquet(f"{self.folder}/current").agg(F.max("version")).first()[0] or 0

    def mart(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/mart-{self.version()}")

    def refresh(self, stg: DataFrame, days: list | None = None) -> DataFrame:
        """Take the staged events of ``days`` (all of them if None) in and return the new mart.

        ``stg`` must hold all events of each refreshed day; a day without events
        loses its partition's rows.  Rows without an event time belong to no day.
        """
        day = F.to_date("event_timestamp")
        events = classify_events(stg if days is None else stg.where(day.isin(list(days))), self.spec)
        events = events.where(F.col("event_timestamp").isNotNull())
        fresh = landed_copy(daily_activity(events).drop("days_to_conversion"), "activity-days")
        first = not self._exists("daily")
        touched = fresh.select("organization_id")
        if not first:
            old = self.daily() if days is None else self.daily().where(F.col("day").isin(list(days)))
            touched = touched.unionByName(old.select("organization_id"))
        touched = landed_copy(touched.distinct().withColumnRenamed("organization_id", "__org"), "touched")
        if first or days is None:
            fresh.write.mode("overwrite").partitionBy("day").parquet(f"{self.folder}/daily")
        else:
            self._empty(days, fresh)
            (fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day")
             .parquet(f"{self.folder}/daily"))
        same = F.col("organization_id").eqNullSafe(F.col("__org"))
        new = self._rollup(self.daily().join(touched, same, "left_semi"))
        version = self.version()
        if version:
            new = new.unionByName(self.mart().join(touched, same, "left_anti"))
        new.write.mode("overwrite").parquet(f"{self.folder}/mart-{version + 1}")
        (self.spark.createDataFrame([(version + 1,)], "version long").coalesce(1)
         .write.mode("append").parquet(f"{self.folder}/current"))
        return self.mart()

    def _empty(self, days: list, fresh: DataFrame) -> None:
        """Drop the partitions of refreshed days that have no events any more."""
        left = {str(r[0]) for r in fresh.select("day").distinct().collect()}  # at most the days asked for
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for gone in {str(d) for d in days} - left:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/daily/day={gone}")
            path.getFileSystem(conf).delete(path, True)

    def _rollup(self, daily: DataFrame) -> DataFrame:
        base = rollup_daily(daily, self.spec).withColumn(
            "days_to_conversion", F.when(F.col("converted"), days_between("trial_start", "converted_at")))
        return mart_from_rollup(base, self.spec, ordered=False)
