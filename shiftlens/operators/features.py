"""Organisation-level roll-up: one aggregation pass over classified events.

Every per-organisation figure the reports need comes out of a single
``groupBy(organization_id)``.  Distinct counts use ``size(collect_set(..))``
(sets bounded by the activity taxonomy and the trial length) instead of
``COUNT(DISTINCT ..)``, which would make Catalyst expand every row once per
distinct expression.  All aggregates are partial-aggregated map-side, so a
hot organisation costs one partial row per map task in the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.columns import clip, days_between, flag, hours_between, sum_columns
from shiftlens.operators.classify import classify_events
from shiftlens.operators.staging import org_meta
from shiftlens.spec import (
    ARCHETYPE_ADMIN_ONLY, ARCHETYPE_BOTH, ARCHETYPE_MINIMAL, DEFAULT_SPEC, SHIFT_CREATED, Spec,
)

META = ("converted", "converted_at", "trial_start", "trial_end")


def daily_activity(classified: DataFrame) -> DataFrame:
    """Events, first event and metadata per (organisation, activity, day)."""
    meta = [*META, *(["days_to_conversion"] if "days_to_conversion" in classified.columns else [])]
    return (classified.groupBy("organization_id", "activity_type", "activity_name",
                               F.to_date("event_timestamp").alias("day"))
            .agg(F.count(F.lit(1)).alias("events"), F.min("event_timestamp").alias("first_ts"),
                 *[F.max(c).alias(c) for c in meta]))


def org_rollup(classified: DataFrame, spec: Spec = DEFAULT_SPEC) -> DataFrame:
    """Base aggregates per organisation, rolled up from its activity days.

    Both steps are hash aggregates combined map-side; the distinct counts expand
    the (organisation, activity, day) rows only, never the events.
    """
    return rollup_daily(daily_activity(classified), spec)


def rollup_daily(daily: DataFrame, spec: Spec = DEFAULT_SPEC) -> DataFrame:
    """Base aggregates per organisation from (organisation, activity, day) rows."""
    name, day = F.col("activity_name"), F.col("day")
    is_admin, is_worker = F.col("activity_type") == "admin", F.col("activity_type") == "worker"
    is_shift = name == F.lit(SHIFT_CREATED)

    def events(cond) -> F.Column:
        return F.coalesce(F.sum(F.when(cond, F.col("events"))), F.lit(0)).cast("bigint")

    def distinct(value, cond=None) -> F.Column:
        return F.count_distinct(value if cond is None else F.when(cond, value))

    def first(cond) -> F.Column:
        return F.min(F.when(cond, F.col("first_ts")))

    meta = [c for c in (*META, "days_to_conversion") if c in daily.columns]
    return daily.groupBy("organization_id").agg(
        *[F.max(c).alias(c) for c in meta],
        F.sum("events").alias("total_events"),
        events(is_admin).alias("admin_events"),
        events(is_worker).alias("worker_events"),
        distinct(name, is_admin).alias("admin_unique_activities"),
        distinct(name, is_worker).alias("worker_unique_activities"),
        distinct(day, is_admin).alias("admin_active_days"),
        distinct(day, is_worker).alias("worker_active_days"),
        distinct(day).alias("active_days"),
        distinct(name).alias("unique_activities"),
        *[events(name.isin(*names)).alias(count_col) for count_col, _, _, names in spec.flag_groups],
        events(is_shift).alias("shift_created_events"),
        first(is_worker).alias("first_worker_ts"),
        first(is_admin).alias("first_admin_ts"),
        first(is_shift).alias("first_shift_created_ts"))


def archetype(worker_events="worker_events", admin_events="admin_events") -> F.Column:
    w, a = F.col(worker_events), F.col(admin_events)
    return (F.when((w > 0) & (a > 0), F.lit(ARCHETYPE_BOTH))
            .when((a > 0) & (w == 0), F.lit(ARCHETYPE_ADMIN_ONLY))
            .otherwise(F.lit(ARCHETYPE_MINIMAL)))


FEATURE_COLUMNS = (
    "organization_id", "converted", "converted_at", "trial_start", "trial_end",
    "total_events", "admin_events", "worker_events", "admin_unique_activities",
    "worker_unique_activities", "admin_active_days", "worker_active_days",
    "punchclock_events", "availability_events", "shift_swap_events",
    "absence_request_events", "mobile_schedule_views", "first_worker_ts", "first_admin_ts",
    "has_any_worker_activity", "has_punchclock", "has_availability", "has_shift_swap",
    "has_absence_request", "has_mobile_view", "worker_event_share", "days_to_conversion",
    "hours_to_first_worker", "hours_to_first_admin", "archetype", "worker_depth_score",
    "is_worker_only",
)


def derive_features(base: DataFrame, spec: Spec = DEFAULT_SPEC, keep=()) -> DataFrame:
    """Script-style derived fields on top of the base aggregates."""
    flags = {script_flag: flag(F.col(count_col) > 0) for count_col, script_flag, _, _ in spec.flag_groups}
    total = F.col("total_events")
    out = base.withColumns({
        "has_any_worker_activity": flag(F.col("worker_events") > 0),
        **flags,
        "worker_event_share": F.col("worker_events") / F.when(total == 0, F.lit(1)).otherwise(total),
        "days_to_conversion": F.when(F.col("converted"), days_between("trial_start", "converted_at")),
        "hours_to_first_worker": F.when(F.col("first_worker_ts").isNotNull(),
                                        hours_between("trial_start", "first_worker_ts")),
        "hours_to_first_admin": clip(hours_between("trial_start", "first_admin_ts"), lower=0.0),
        "archetype": archetype(),
        "is_worker_only": (F.col("worker_events") > 0) & (F.col("admin_events") == 0),
    })
    out = out.withColumn("worker_depth_score", sum_columns(spec.worker_depth_flags).cast("int"))
    return out.select(*FEATURE_COLUMNS, *keep)


def org_features(classified: DataFrame, spec: Spec = DEFAULT_SPEC) -> DataFrame:
    """One row per organisation with volumes, breadth, days, flags and timing."""
    if "activity_type" not in classified.columns:
        classified = classify_events(classified, spec)
    return derive_features(org_rollup(classified, spec), spec)


def org_features_joined(classified: DataFrame, spec: Spec = DEFAULT_SPEC) -> DataFrame:
    """The same features built as metadata + one left join per aggregate.

    Kept as a tested equivalent of :func:`org_features`.  Every part is
    aggregated on ``organization_id``, so the joins reuse that hash
    partitioning; it still scans the events once per part, which is why
    :func:`org_features` is the production form.
    """
    if "activity_type" not in classified.columns:
        classified = classify_events(classified, spec)
    side, name, ts = F.col("activity_type"), F.col("activity_name"), F.col("event_timestamp")
    by = "organization_id"
    admin = classified.where(side == "admin")
    worker = classified.where(side == "worker")
    parts = [
        classified.groupBy(by).agg(F.count(F.lit(1)).alias("total_events")),
        admin.groupBy(by).agg(F.count(F.lit(1)).alias("admin_events")),
        worker.groupBy(by).agg(F.count(F.lit(1)).alias("worker_events")),
        admin.groupBy(by).agg(F.count_distinct(name).alias("admin_unique_activities")),
        worker.groupBy(by).agg(F.count_distinct(name).alias("worker_unique_activities")),
        admin.groupBy(by).agg(F.count_distinct(F.to_date(ts)).alias("admin_active_days")),
        worker.groupBy(by).agg(F.count_distinct(F.to_date(ts)).alias("worker_active_days")),
    ]
    for count_col, _, _, names in spec.flag_groups:
        parts.append(classified.where(name.isin(*names)).groupBy(by).agg(F.count(F.lit(1)).alias(count_col)))
    parts += [
        worker.groupBy(by).agg(F.min(ts).alias("first_worker_ts")),
        admin.groupBy(by).agg(F.min(ts).alias("first_admin_ts")),
    ]
    joined = reduce(lambda acc, p: acc.join(p, by, "left"), parts, org_meta(classified))
    fill = [c for c in joined.columns if c not in (by, *META, "first_worker_ts", "first_admin_ts")]
    return derive_features(joined.fillna(0, subset=fill), spec)


def standardize(df: DataFrame, cols, key: str = "organization_id") -> DataFrame:
    """Zero mean, unit population standard deviation (zero sd -> divide by 1).

    The moments are one global aggregate row, joined back by broadcast.
    """
    stats = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"__m_{c}") for c in cols],
                   *[F.stddev_pop(F.col(c).cast("double")).alias(f"__s_{c}") for c in cols])
    joined = df.crossJoin(F.broadcast(stats))
    out = [F.col(key)]
    for c in cols:
        sd = F.col(f"__s_{c}")
        out.append(((F.col(c).cast("double") - F.col(f"__m_{c}"))
                    / F.when(sd == 0, F.lit(1.0)).otherwise(sd)).alias(c))
    return joined.select(*out)
