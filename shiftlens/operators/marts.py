"""Warehouse-style marts: worker adoption, trial goals, activation, triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.columns import flag, hour_boundaries_between, sum_columns
from shiftlens.operators.classify import classify_events
from shiftlens.operators.features import archetype, org_rollup
from shiftlens.spec import (
    ACTIVATION_TIERS, ARCHETYPE_ADMIN_ONLY, ARCHETYPE_BOTH, AVAILABILITY_SET, DEEP_WORKER_DEPTH,
    DEFAULT_SPEC, GOAL_MIN_ACTIVE_DAYS, GOAL_MIN_ACTIVITY_TYPES, MOBILE_VIEW, NUDGE_HOURS,
    OUTREACH_DAY, SHIFT_CREATED, Spec,
)

MART_COLUMNS = (
    "organization_id", "converted", "converted_at", "days_to_conversion", "trial_start", "trial_end",
    "total_events", "admin_events", "worker_events", "admin_unique_activities",
    "worker_unique_activities", "admin_active_days", "worker_active_days",
    "has_punchclock", "has_availability_set", "has_shift_swap_or_handover", "has_absence_request",
    "has_mobile_schedule_view", "first_admin_event_ts", "first_worker_event_ts",
    "has_any_worker_activity", "worker_depth_score", "worker_event_share", "handoff_gap_hours",
    "adoption_archetype", "flag_admin_only_not_converted", "flag_no_punchclock_not_converted",
    "flag_deep_worker_not_converted",
)


def mart_worker_adoption(stg: DataFrame, spec: Spec = DEFAULT_SPEC, ordered: bool = True) -> DataFrame:
    """Admin-vs-worker mart, one row per organisation.

    ``ordered=True`` applies the model's presentation order (archetype rank,
    depth descending, organisation); writers should pass ``ordered=False`` and
    sort within partitions instead of paying for a global sort.
    """
    classified = classify_events(stg, spec) if "activity_type" not in stg.columns else stg
    return mart_from_rollup(org_rollup(classified, spec), spec, ordered)


def mart_from_rollup(base: DataFrame, spec: Spec = DEFAULT_SPEC, ordered: bool = True) -> DataFrame:
    """The worker-adoption mart from per-organisation base aggregates."""
    flags = {mart_flag: flag(F.col(count_col) > 0) for count_col, _, mart_flag, _ in spec.flag_groups}
    not_converted = ~F.col("converted")
    out = (base.withColumns(flags)
           .withColumnsRenamed({"first_admin_ts": "first_admin_event_ts",
                                "first_worker_ts": "first_worker_event_ts"})
           .withColumns({
               "has_any_worker_activity": F.col("worker_events") > 0,
               "worker_depth_score": sum_columns(spec.mart_flags).cast("int"),
               "worker_event_share": F.round(
                   F.try_divide(F.col("worker_events").cast("double"),
                                F.nullif(F.col("total_events"), F.lit(0)).cast("double")), 3),
               "handoff_gap_hours": F.when(
                   F.col("first_worker_event_ts").isNotNull() & F.col("first_admin_event_ts").isNotNull(),
                   hour_boundaries_between("first_admin_event_ts", "first_worker_event_ts")),
               "adoption_archetype": archetype(),
           })
           .withColumns({
               "flag_admin_only_not_converted":
                   (F.col("admin_events") > 0) & (F.col("worker_events") == 0) & not_converted,
               "flag_no_punchclock_not_converted":
                   (F.col("worker_events") > 0) & (F.col("has_punchclock") == 0) & not_converted,
               "flag_deep_worker_not_converted":
                   (F.col("worker_depth_score") >= DEEP_WORKER_DEPTH) & not_converted,
           })
           .select(*MART_COLUMNS))
    if ordered:
        rank = (F.when(F.col("adoption_archetype") == ARCHETYPE_BOTH, 1)
                .when(F.col("adoption_archetype") == ARCHETYPE_ADMIN_ONLY, 2).otherwise(3))
        out = out.orderBy(rank, F.col("worker_depth_score").desc(), F.col("organization_id"))
    return out


GOAL_COLUMNS = ("goal_shift_created", "goal_mobile_viewed", "goal_availability_set",
                "goal_active_days", "goal_activity_types")


def _goals_from_rollup(base: DataFrame, min_days: int, min_types: int) -> DataFrame:
    goals = {
        "goal_shift_created": flag(F.col("shift_created_events") > 0),
        "goal_mobile_viewed": flag(F.col("mobile_schedule_views") > 0),
        "goal_availability_set": flag(F.col("availability_events") > 0),
        "goal_active_days": flag(F.col("active_days") >= min_days),
        "goal_activity_types": flag(F.col("unique_activities") >= min_types),
    }
    return base.withColumns(goals).withColumn("goals_completed", sum_columns(GOAL_COLUMNS).cast("int"))


def _goal_rollup(stg: DataFrame, spec: Spec) -> DataFrame:
    classified = classify_events(stg, spec) if "activity_type" not in stg.columns else stg
    return org_rollup(classified, spec)


def mart_trial_goals(stg: DataFrame, spec: Spec = DEFAULT_SPEC, min_active_days: int = GOAL_MIN_ACTIVE_DAYS,
                     min_activity_types: int = GOAL_MIN_ACTIVITY_TYPES) -> DataFrame:
    """Five trial goals per organisation (shift, mobile view, availability, days, breadth).

    Names are asserted to exist in the taxonomy so a renamed event fails loudly.
    """
    assert SHIFT_CREATED in spec.admin_activities and MOBILE_VIEW in spec.worker_activities
    assert AVAILABILITY_SET in spec.worker_activities
    return goals_from_rollup(_goal_rollup(stg, spec), min_active_days, min_activity_types)


def goals_from_rollup(rollup: DataFrame, min_active_days: int = GOAL_MIN_ACTIVE_DAYS,
                      min_activity_types: int = GOAL_MIN_ACTIVITY_TYPES) -> DataFrame:
    """The goals mart from per-organisation base aggregates."""
    base = _goals_from_rollup(rollup, min_active_days, min_activity_types)
    return base.select("organization_id", "converted", "converted_at", "trial_start", "trial_end",
                       "active_days", "unique_activities", *GOAL_COLUMNS, "goals_completed")


def activation_tier(goals="goals_completed") -> F.Column:
    g = F.col(goals)
    out = None
    for min_goals, name in ACTIVATION_TIERS:
        out = F.when(g >= min_goals, F.lit(name)) if out is None else out.when(g >= min_goals, F.lit(name))
    return out


def tier_order(goals="goals_completed") -> F.Column:
    g = F.col(goals)
    out = None
    for i, (min_goals, _) in enumerate(ACTIVATION_TIERS, start=1):
        out = F.when(g >= min_goals, F.lit(i)) if out is None else out.when(g >= min_goals, F.lit(i))
    return out


def mart_trial_activation(goals: DataFrame) -> DataFrame:
    """Activation tier and intervention flags from the goals mart."""
    g = F.col("goals_completed")
    not_converted = ~F.col("converted")
    return goals.select(
        "organization_id", "converted", "goals_completed",
        activation_tier().alias("activation_tier"),
        (g == len(GOAL_COLUMNS)).alias("is_activated"),
        ((g >= 3) & not_converted).alias("is_near_activated_not_converted"),
        (g == 0).alias("is_zero_engagement"),
        ((g == len(GOAL_COLUMNS)) & not_converted).alias("is_activated_churned"),
    )


def tier_table(spark) -> DataFrame:
    rows = [(i, name) for i, (_, name) in enumerate(ACTIVATION_TIERS, start=1)]
    return spark.createDataFrame(rows, "tier_order int, activation_tier string")


def activation_tier_summary(activation: DataFrame) -> DataFrame:
    """Organisations and conversion per tier; all four tiers, empty ones with 0."""
    agg = activation.groupBy("activation_tier").agg(
        F.count(F.lit(1)).alias("n_orgs"),
        F.count_if(F.col("converted")).alias("n_converted"),
    )
    tiers = F.broadcast(tier_table(activation.sparkSession))
    return (tiers.join(agg, "activation_tier", "left")
            .select("tier_order", "activation_tier",
                    F.coalesce("n_orgs", F.lit(0)).cast("bigint").alias("n_orgs"),
                    F.coalesce("n_converted", F.lit(0)).cast("bigint").alias("n_converted"),
                    F.round(F.try_divide(F.col("n_converted").cast("double"), F.col("n_orgs").cast("double")), 6)
                    .alias("conv_rate")))


def day14_outreach(stg: DataFrame, spec: Spec = DEFAULT_SPEC, day: int = OUTREACH_DAY) -> DataFrame:
    """Organisations active by day ``day`` and not converted by then.

    Goals are measured on events up to ``trial_start + day`` only, so the list
    is what CS would have seen on that day.  Partially Activated comes first.
    """
    cutoff = F.col("trial_start") + F.make_dt_interval(F.lit(day))
    early = stg.where(F.col("event_timestamp") <= cutoff)
    if "trial_day_number" in stg.columns:
        # Implied by the cutoff (day number = floor(hours / 24) + 1); on a table
        # partitioned by trial day this prunes the later days' files.
        early = early.where(F.col("trial_day_number") <= day + 1)
    base = _goals_from_rollup(_goal_rollup(early, spec), GOAL_MIN_ACTIVE_DAYS, GOAL_MIN_ACTIVITY_TYPES)
    converted_by_day = F.col("converted") & F.col("converted_at").isNotNull() & (F.col("converted_at") <= cutoff)
    tier = activation_tier()
    priority = (F.when(tier == F.lit(ACTIVATION_TIERS[1][1]), 1)
                .when(tier == F.lit(ACTIVATION_TIERS[0][1]), 2)
                .when(tier == F.lit(ACTIVATION_TIERS[2][1]), 3).otherwise(4))
    return (base.where(~F.coalesce(converted_by_day, F.lit(False)))
            .select("organization_id", "converted", "goals_completed",
                    tier.alias("activation_tier"), priority.alias("priority"),
                    F.col("total_events").alias("events_by_day")))


def onboarding_nudge(stg: DataFrame, spec: Spec = DEFAULT_SPEC, hours: int = NUDGE_HOURS) -> DataFrame:
    """Organisations that created a shift and had no worker event by anchor + ``hours``.

    The anchor is the first shift creation.  Expressed as one per-organisation
    aggregate (first shift, first worker event) instead of an anti-join, so
    the events are shuffled once and a hot organisation is combined map-side.
    """
    return nudge_from_rollup(_goal_rollup(stg, spec), hours)


def nudge_from_rollup(base: DataFrame, hours: int = NUDGE_HOURS) -> DataFrame:
    """Nudge targets from per-organisation base aggregates (first shift, first worker event)."""
    due = F.col("first_shift_created_ts") + F.make_dt_interval(F.lit(0), F.lit(hours))
    return (base.where(F.col("first_shift_created_ts").isNotNull()
                       & (F.col("first_worker_ts").isNull() | (F.col("first_worker_ts") > due)))
            .select("organization_id",
                    F.col("first_shift_created_ts").alias("first_shift_created_at"),
                    due.alias("nudge_due_at"), "converted"))
