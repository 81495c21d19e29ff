"""Activity classification (admin / worker / shared) and frequency tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shiftlens.spec import DEFAULT_SPEC, Spec


def side_of(name_col, spec: Spec = DEFAULT_SPEC):
    """worker / admin / shared for an activity-name column (null -> shared).

    The two lists become hash-set ``IN`` tests inside whole-stage codegen: no
    join, no shuffle, no Python.
    """
    c = F.col(name_col) if isinstance(name_col, str) else name_col
    return (F.when(c.isin(*spec.worker_activities), F.lit("worker"))
            .when(c.isin(*spec.admin_activities), F.lit("admin"))
            .otherwise(F.lit("shared")))


def activity_dimension(spark, spec: Spec = DEFAULT_SPEC) -> DataFrame:
    """The 28-row activity dimension (name, side, label, flag group)."""
    groups = {n: g[0] for g in spec.flag_groups for n in g[3]}
    rows = [(n, "worker", spec.worker_labels.get(n), groups.get(n)) for n in spec.worker_activities]
    rows += [(n, "admin", None, None) for n in spec.admin_activities]
    return spark.createDataFrame(rows, "activity_name string, side string, label string, flag_group string")


def classify_events(stg: DataFrame, spec: Spec = DEFAULT_SPEC) -> DataFrame:
    return stg.withColumn("activity_type", side_of("activity_name", spec))


def filter_membership(classified: DataFrame, spec: Spec = DEFAULT_SPEC) -> DataFrame:
    """Worker events that belong to one of the worker flag groups."""
    group_of = F.lit(None).cast("string")
    for count_col, _, _, names in reversed(spec.flag_groups):
        group_of = F.when(F.col("activity_name").isin(*names), F.lit(count_col)).otherwise(group_of)
    members = [n for g in spec.flag_groups for n in g[3]]
    return (classified
            .where((F.col("activity_type") == "worker") & F.col("activity_name").isin(*members))
            .select("organization_id", "activity_name", "event_timestamp", group_of.alias("flag_group")))


def events_by_side(classified: DataFrame) -> DataFrame:
    """Non-null activity names per side."""
    return classified.groupBy("activity_type").agg(F.count("activity_name").alias("event_count"))


def activity_breakdown(classified: DataFrame, side: str, spec: Spec = DEFAULT_SPEC) -> DataFrame:
    """Frequency table of one side's activities, most frequent first, with labels.

    The label lookup is a literal map (default: the name itself).  The display
    rank is a window over the aggregated table, whose size is bounded by the
    activity dimension, not by the data.
    """
    counts = (classified.where((F.col("activity_type") == side) & F.col("activity_name").isNotNull())
              .groupBy("activity_name").agg(F.count(F.lit(1)).alias("event_count")))
    labels = spec.worker_labels if side == "worker" else {}
    label = F.col("activity_name")
    if labels:
        lookup = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
        label = F.coalesce(F.try_element_at(lookup, F.col("activity_name")), F.col("activity_name"))
    order = Window.orderBy(F.col("event_count").desc(), F.col("activity_name"))
    return counts.select(
        "activity_name", label.alias("label"), "event_count",
        F.row_number().over(order).cast("int").alias("display_rank"),
    )
