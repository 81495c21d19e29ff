"""Registered queries: each builds the raw trial log from ``events`` and runs one operator.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose work
grows with the driver's ``events`` table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.operators import classify, features, marts, staging
from shiftlens.plans.tables import landed, landed_path
from shiftlens.sources import quarantine
from shiftlens.sources import coerce_timestamps, events_table, raw_trial_events

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- shared stages

def _events_path(sf_dir: str) -> str:
    return f"{sf_dir.rstrip('/')}/events.parquet"


def raw_path(spark: SparkSession, sf_dir: str) -> str:
    return landed_path(spark, _events_path(sf_dir), "raw-trial-events", lambda: raw_trial_events(spark, sf_dir))


def stg_path(spark: SparkSession, sf_dir: str) -> str:
    # Partitioned by trial day: queries bounded in trial time prune directories.
    return landed_path(spark, _events_path(sf_dir), "stg-trial-events",
                       lambda: staging.stg_trial_events(raw(spark, sf_dir)), partition_by=["trial_day_number"])


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw trial log derived from ``events``, landed once per session."""
    return landed(spark, _events_path(sf_dir), "raw-trial-events", lambda: raw_trial_events(spark, sf_dir))


def stg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged events (de-duplicated, in window, enriched), landed once per session."""
    return landed(spark, _events_path(sf_dir), "stg-trial-events",
                  lambda: staging.stg_trial_events(raw(spark, sf_dir)), partition_by=["trial_day_number"])


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify_events(stg(spark, sf_dir))


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-organisation base aggregates (one shuffle of the staged events), landed once."""
    return landed(spark, _events_path(sf_dir), "org-rollup",
                  lambda: features.org_rollup(classified(spark, sf_dir)))


def org(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisation features: a projection of the landed roll-up."""
    return features.derive_features(rollup(spark, sf_dir))


# ---------------------------------------------------------------- sources, staging

@register("coerce_timestamps")
def q_coerce_timestamps(spark, sf_dir):
    ev = events_table(spark, sf_dir)
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    text = F.when(k % 10 == 0, F.lit("not a date")).otherwise(F.col("ts").cast("string"))
    df = ev.select("event_id", text.alias("event_timestamp"))
    out = coerce_timestamps(df, ["event_timestamp"])
    return out.select("event_id", "event_timestamp",
                      F.col("event_timestamp").isNull().alias("is_unparsed"))


@register("dedup_events")
def q_dedup_events(spark, sf_dir):
    return staging.dedup_events(raw(spark, sf_dir))


@register("stg_trial_events")
def q_stg_trial_events(spark, sf_dir):
    return stg(spark, sf_dir)


def text_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw log as text, landed once; some values, picked by the event's second, do not parse or are blank."""
    second = F.second("event_timestamp")
    bad = {"event_timestamp": {7: "not a date", 8: ""}, "converted": {17: "maybe"}, "converted_at": {27: "31/31/2024"},
           "trial_start": {37: "soon"}, "trial_end": {47: "2024-13-01", 48: " "}}

    def text(c: str):
        out = F.col(c).cast("string")
        for at, value in bad.get(c, {}).items():
            out = F.when(second == at, F.lit(value)).otherwise(out)
        return out.alias(c)
    return landed(spark, _events_path(sf_dir), "text-trial-events",
                  lambda: raw(spark, sf_dir).select(*[text(c) for c in staging.RAW_COLUMNS]))


@register("dq_summary")
def q_dq_summary(spark, sf_dir):
    return staging.dq_summary(quarantine.parse_events(text_log(spark, sf_dir)))


@register("quarantine_rows")
def q_quarantine_rows(spark, sf_dir):
    return quarantine.land_events(quarantine.parse_events(text_log(spark, sf_dir))).rejected


@register("quarantine_counts")
def q_quarantine_counts(spark, sf_dir):
    found = quarantine.land_events(quarantine.parse_events(text_log(spark, sf_dir)))
    return quarantine.count_table(spark, found.counts)


@register("org_meta")
def q_org_meta(spark, sf_dir):
    return staging.org_meta(stg(spark, sf_dir))


# ---------------------------------------------------------------- classification

@register("classify_events")
def q_classify_events(spark, sf_dir):
    return classified(spark, sf_dir)


@register("filter_membership")
def q_filter_membership(spark, sf_dir):
    return classify.filter_membership(classified(spark, sf_dir))


@register("events_by_side")
def q_events_by_side(spark, sf_dir):
    return classify.events_by_side(classified(spark, sf_dir))


@register("worker_activity_breakdown")
def q_worker_activity_breakdown(spark, sf_dir):
    return classify.activity_breakdown(classified(spark, sf_dir), "worker")


@register("admin_activity_breakdown")
def q_admin_activity_breakdown(spark, sf_dir):
    return classify.activity_breakdown(classified(spark, sf_dir), "admin")


# ---------------------------------------------------------------- features, marts

@register("org_features")
def q_org_features(spark, sf_dir):
    return org(spark, sf_dir)


@register("org_features_joined")
def q_org_features_joined(spark, sf_dir):
    return features.org_features_joined(classified(spark, sf_dir))


@register("mart_worker_adoption")
def q_mart_worker_adoption(spark, sf_dir):
    return marts.mart_from_rollup(rollup(spark, sf_dir))


# ---------------------------------------------------------------- reports

from shiftlens.operators import distributions as dist  # noqa: E402
from shiftlens.operators import ml, reports, stats, survival  # noqa: E402
from shiftlens.spec import DISTRIBUTION_METRICS  # noqa: E402


@register("conversion_overview")
def q_conversion_overview(spark, sf_dir):
    return reports.conversion_overview(org(spark, sf_dir))


@register("worker_headline")
def q_worker_headline(spark, sf_dir):
    return reports.worker_headline(org(spark, sf_dir))


@register("crosstab_worker_converted")
def q_crosstab_worker_converted(spark, sf_dir):
    return reports.crosstab_worker_converted(org(spark, sf_dir))


@register("chi_square_flags")
def q_chi_square_flags(spark, sf_dir):
    return reports.chi_square_flags(org(spark, sf_dir))


@register("activity_uplift")
def q_activity_uplift(spark, sf_dir):
    return reports.activity_uplift(org(spark, sf_dir))


@register("archetypes")
def q_archetypes(spark, sf_dir):
    return reports.archetypes(org(spark, sf_dir))


@register("archetype_chart")
def q_archetype_chart(spark, sf_dir):
    return reports.archetype_chart(org(spark, sf_dir))


@register("depth_summary")
def q_depth_summary(spark, sf_dir):
    return reports.depth_summary(org(spark, sf_dir))


@register("adoption_funnel")
def q_adoption_funnel(spark, sf_dir):
    return reports.adoption_funnel(features.derive_features(rollup(spark, sf_dir), keep=("shift_created_events",)))


@register("side_volume_by_outcome")
def q_side_volume_by_outcome(spark, sf_dir):
    return reports.side_volume_by_outcome(org(spark, sf_dir))


# ---------------------------------------------------------------- distributions

@register("worker_timing")
def q_worker_timing(spark, sf_dir):
    return dist.worker_timing(org(spark, sf_dir))


@register("handoff_gap")
def q_handoff_gap(spark, sf_dir):
    return dist.handoff_gap(org(spark, sf_dir))


@register("handoff_buckets")
def q_handoff_buckets(spark, sf_dir):
    return dist.handoff_buckets(org(spark, sf_dir))


@register("adoption_curve")
def q_adoption_curve(spark, sf_dir):
    return dist.adoption_curve(org(spark, sf_dir))


@register("metric_quantiles")
def q_metric_quantiles(spark, sf_dir):
    return dist.metric_quantiles(org(spark, sf_dir))


@register("capped_metrics")
def q_capped_metrics(spark, sf_dir):
    return dist.capped_metrics(org(spark, sf_dir))


@register("hist_total_events")
def q_hist_total_events(spark, sf_dir):
    return dist.hist_total_events(org(spark, sf_dir))


@register("hist_active_days")
def q_hist_active_days(spark, sf_dir):
    return dist.hist_active_days(org(spark, sf_dir))


@register("hist_first_worker")
def q_hist_first_worker(spark, sf_dir):
    return dist.hist_first_worker(org(spark, sf_dir))


@register("hist_worker_share")
def q_hist_worker_share(spark, sf_dir):
    return dist.hist_worker_share(org(spark, sf_dir))


@register("hist_handoff_gap")
def q_hist_handoff_gap(spark, sf_dir):
    return dist.hist_handoff_gap(org(spark, sf_dir))


@register("boxplot_stats")
def q_boxplot_stats(spark, sf_dir):
    return dist.boxplot_stats(org(spark, sf_dir), DISTRIBUTION_METRICS)


@register("scatter_admin_worker")
def q_scatter_admin_worker(spark, sf_dir):
    return dist.scatter_admin_worker(org(spark, sf_dir))


# ---------------------------------------------------------------- tests, models, survival

def _metrics_long(o: DataFrame) -> DataFrame:
    return o.select("converted", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m, _ in DISTRIBUTION_METRICS])))


@register("mann_whitney_metrics")
def q_mann_whitney_metrics(spark, sf_dir):
    return _r6_stats(stats.mann_whitney(_metrics_long(org(spark, sf_dir)), ["metric"], "value"))


@register("mann_whitney_timing")
def q_mann_whitney_timing(spark, sf_dir):
    wt = dist.worker_timing_frame(org(spark, sf_dir)).withColumn("metric", F.lit("days_to_first_worker"))
    return _r6_stats(stats.mann_whitney(wt, ["metric"], "days_to_first_worker"))


def _r6_stats(df: DataFrame) -> DataFrame:
    from shiftlens.functions.columns import r6
    return df.withColumns({c: r6(c) for c in ("u_stat", "z", "p_value")})


AUC_SCORES = ("total_events", "admin_events", "worker_events", "admin_active_days", "worker_active_days",
              "admin_unique_activities", "worker_unique_activities", "worker_depth_score", "worker_event_share")


@register("roc_auc_score_table")
def q_roc_auc_score_table(spark, sf_dir):
    from shiftlens.functions.columns import r6
    o = org(spark, sf_dir)
    long = o.select("converted", F.inline(F.array(*[
        F.struct(F.lit(m).alias("score_name"), F.col(m).cast("double").alias("score")) for m in AUC_SCORES])))
    out = stats.roc_auc(long, ["score_name"], "score", "converted")
    return out.withColumn("auc", r6("auc"))


@register("survival_input")
def q_survival_input(spark, sf_dir):
    return survival.survival_input(org(spark, sf_dir))


@register("kaplan_meier")
def q_kaplan_meier(spark, sf_dir):
    return survival.kaplan_meier(survival.survival_input(org(spark, sf_dir)))


@register("feature_sets")
def q_feature_sets(spark, sf_dir):
    return ml.feature_sets(org(spark, sf_dir))


@register("standardize_features")
def q_standardize_features(spark, sf_dir):
    from shiftlens.functions.columns import r6
    from shiftlens.spec import ADMIN_FEATURES, WORKER_FEATURES
    cols = ADMIN_FEATURES + WORKER_FEATURES
    out = features.standardize(org(spark, sf_dir), cols)
    return out.select("organization_id", *[r6(c).alias(c) for c in cols])


@register("cv_folds")
def q_cv_folds(spark, sf_dir):
    return ml.stratified_folds(org(spark, sf_dir), "converted")


@register("rf_cv_auc")
def q_rf_cv_auc(spark, sf_dir):
    return ml.rf_cv_auc(org(spark, sf_dir))


# ---------------------------------------------------------------- goals, activation, triggers

@register("mart_trial_goals")
def q_mart_trial_goals(spark, sf_dir):
    return marts.goals_from_rollup(rollup(spark, sf_dir))


@register("mart_trial_activation")
def q_mart_trial_activation(spark, sf_dir):
    return marts.mart_trial_activation(marts.goals_from_rollup(rollup(spark, sf_dir)))


@register("activation_tier_summary")
def q_activation_tier_summary(spark, sf_dir):
    return marts.activation_tier_summary(marts.mart_trial_activation(marts.goals_from_rollup(rollup(spark, sf_dir))))


@register("day14_outreach")
def q_day14_outreach(spark, sf_dir):
    return marts.day14_outreach(stg(spark, sf_dir))


@register("onboarding_nudge")
def q_onboarding_nudge(spark, sf_dir):
    return marts.nudge_from_rollup(rollup(spark, sf_dir))


# ---------------------------------------------------------------- streaming and sinks

from shiftlens.sources import write_mart  # noqa: E402
from shiftlens.session import scratch_path  # noqa: E402
from shiftlens.streaming import batches, streams  # noqa: E402

STREAM_WATERMARK = "1 hour"


def _stg_stream(spark, sf_dir):
    """The landed staged table read as a file stream (no extra copy)."""
    return streams.file_stream(spark, stg_path(spark, sf_dir), stg(spark, sf_dir).schema).select(*staging.RAW_COLUMNS)


@register("stream_dedup")
def q_stream_dedup(spark, sf_dir):
    # The landed raw table is the stream's file source (no extra copy).
    sdf = streams.stream_dedup(streams.file_stream(spark, raw_path(spark, sf_dir), raw(spark, sf_dir).schema),
                               STREAM_WATERMARK)
    return streams.run_to_table(sdf, "stream-dedup")


@register("stream_activity_by_day")
def q_stream_activity_by_day(spark, sf_dir):
    sdf = streams.stream_activity_by_day(_stg_stream(spark, sf_dir), STREAM_WATERMARK)
    return streams.run_to_table(sdf, "stream-activity")


@register("stream_onboarding_nudge")
def q_stream_onboarding_nudge(spark, sf_dir):
    sdf = streams.stream_onboarding_nudge(_stg_stream(spark, sf_dir), watermark=STREAM_WATERMARK)
    per_shift = streams.run_to_table(sdf, "stream-nudge")
    return per_shift.groupBy("organization_id").agg(
        F.min("shift_ts").alias("first_unanswered_shift_at"), F.min("nudge_due_at").alias("nudge_due_at"))


STREAM_SLICES = 4


def _ordered(spark, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a stream of time-ordered slices, one a micro-batch."""
    files = batches.files_a_slice(df.count(), STREAM_SLICES)
    path, schema = batches.land_in_order(df, "event_timestamp", STREAM_SLICES, name, files)
    return batches.ordered_stream(spark, path, schema, files)


@register("stream_activity_batches")
def q_stream_activity_batches(spark, sf_dir):
    # Stopped after its second micro-batch and resumed from the checkpoint.
    sdf = streams.stream_activity_by_day(_ordered(spark, stg(spark, sf_dir).select(*staging.RAW_COLUMNS), "activity"),
                                         STREAM_WATERMARK)
    folder = scratch_path(spark, "stream-activity-batches")
    batches.run_batches(sdf, folder, stop_after=2)
    return batches.run_batches(sdf, folder).table


@register("stream_activity_chained")
def q_stream_activity_chained(spark, sf_dir):
    sdf = batches.activity_from_raw(_ordered(spark, raw(spark, sf_dir), "raw"), STREAM_WATERMARK)
    return batches.run_batches(sdf, scratch_path(spark, "stream-activity-chained")).table


@register("stream_nudge_once")
def q_stream_nudge_once(spark, sf_dir):
    source = _ordered(spark, stg(spark, sf_dir).select(*staging.RAW_COLUMNS), "nudge")
    sink = batches.NudgeSink(spark, scratch_path(spark, "nudge-sink"))
    batches.run_batches(streams.stream_onboarding_nudge(source, watermark=STREAM_WATERMARK),
                        scratch_path(spark, "stream-nudge-once"), sink)
    return sink.nudges().select("organization_id", "first_unanswered_shift_at", "nudge_due_at")


@register("write_mart")
def q_write_mart(spark, sf_dir):
    path = scratch_path(spark, "mart-worker-adoption")
    mart = marts.mart_from_rollup(rollup(spark, sf_dir), ordered=False)
    write_mart(mart, path, sort_within=["organization_id"])
    return spark.read.parquet(path)


@register("read_events")
def q_read_events(spark, sf_dir):
    """CSV scan: the derived raw log is landed as CSV with a mixed-case header, then read back."""
    from shiftlens.sources import read_events
    path = scratch_path(spark, "raw-events-csv")
    headers = {"organization_id": "Organization_Id", "activity_name": "Activity_Name",
               "event_timestamp": "TIMESTAMP", "converted": "Converted", "converted_at": "Converted_At",
               "trial_start": "Trial_Start", "trial_end": "Trial_End"}
    raw(spark, sf_dir).select(*[F.col(c).alias(h) for c, h in headers.items()]).write \
        .option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    return read_events(spark, path, fmt="csv")


@register("read_events_mixed_headers")
def q_read_events_mixed_headers(spark, sf_dir):
    """A folder of CSV files with two headers: other order, case and an extra column."""
    from shiftlens.sources import read_events
    path = scratch_path(spark, "raw-events-mixed-csv")
    even = F.pmod(F.xxhash64("organization_id"), F.lit(2)) == 0
    log = raw(spark, sf_dir)
    one = [F.col(c).alias(c.upper()) for c in staging.RAW_COLUMNS]
    two = [F.lit("x").alias("Extra"), F.col("trial_end"), F.col("event_timestamp").alias("Timestamp"),
           *[F.col(c).alias(c.title()) for c in ("converted", "activity_name", "converted_at", "organization_id", "trial_start")]]
    for part, columns in ((log.where(even), one), (log.where(~even), two)):
        (part.select(*columns).write.mode("append").option("header", True)
         .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))
    return read_events(spark, path, fmt="csv")


@register("mart_refreshed")
def q_mart_refreshed(spark, sf_dir):
    """The mart built without its last ten days, which then arrive one refresh a half."""
    from datetime import timedelta

    from shiftlens.plans.layers import AdoptionLayers
    events = stg(spark, sf_dir)
    day = F.to_date("event_timestamp")
    last = events.agg(F.max(day)).first()[0]
    layers = AdoptionLayers(spark, scratch_path(spark, "adoption-layers"))
    if last is None:
        return layers.refresh(events)
    late = [last - timedelta(days=i) for i in range(10)]
    layers.refresh(events.where(~day.isin(late)))
    layers.refresh(events, late[5:])
    return layers.refresh(events, late[:5])
