"""Cleaning and staging: de-duplication, trial-window filter, derived fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.columns import days_between, hours_between
from shiftlens.session import landed_copy
from shiftlens.sources.quarantine import PARSED_COLUMNS, unparsed
from shiftlens.spec import RAW_COLUMNS


def dedup_events(df: DataFrame) -> DataFrame:
    """Exact de-duplication on all raw columns (nulls compare equal).

    The shuffle is keyed on every column, so an organisation holding a large
    share of the log still spreads over many reducers; map-side partial
    aggregation drops most copies before the shuffle.
    """
    return df.select(*RAW_COLUMNS).dropDuplicates()


def with_stage_fields(df: DataFrame) -> DataFrame:
    hours = hours_between("trial_start", "event_timestamp")
    return df.withColumns({
        "trial_day_number": (F.floor(hours / F.lit(24.0)) + F.lit(1)).cast("int"),
        "hours_since_trial_start": hours,
        "days_to_conversion": F.when(F.col("converted"), days_between("trial_start", "converted_at")),
    })


def stg_trial_events(raw: DataFrame, filter_window: bool = True) -> DataFrame:
    """Staging model: de-duplicated, validated, enriched events.

    Keeps events inside ``[trial_start, trial_end]`` (both ends inclusive) and
    rejects rows without an organisation.  ``filter_window=False`` gives the
    script-like path that only de-duplicates.
    """
    out = dedup_events(raw).where(F.col("organization_id").isNotNull())
    if filter_window:
        out = out.where(F.col("event_timestamp").between(F.col("trial_start"), F.col("trial_end")))
    return with_stage_fields(out)


def org_meta(stg: DataFrame) -> DataFrame:
    """One metadata row per organisation (deterministic: MAX per column)."""
    return stg.groupBy("organization_id").agg(
        F.max("converted").alias("converted"),
        F.max("converted_at").alias("converted_at"),
        F.max("trial_start").alias("trial_start"),
        F.max("trial_end").alias("trial_end"),
    )


def dq_summary(raw: DataFrame) -> DataFrame:
    """Data-quality summary of a raw log, one row.

    The log is scanned once: equal rows are combined to one with their number of
    copies, those to (organisation, metadata, activity) sums, which are landed,
    and every figure is a roll-up of that small table.  An organisation has
    conflicting metadata when it has more than one distinct (converted,
    converted_at, trial_start, trial_end) tuple.  ``unparsed_*`` counts values
    that were present and did not parse; a log without a ``rejects`` column (see
    :mod:`shiftlens.sources.quarantine`) has none.
    """
    bad = [f"unparsed_{c}" for c in PARSED_COLUMNS]
    if "rejects" in raw.columns:
        flags = raw.withColumns({b: unparsed(c) for b, c in zip(bad, PARSED_COLUMNS)})
    else:
        flags = raw.withColumns({b: F.lit(0) for b in bad})
    copies = flags.groupBy(*RAW_COLUMNS).agg(F.count(F.lit(1)).alias("copies"),
                                             *[F.sum(b).cast("long").alias(b) for b in bad])
    ts, start, end = F.col("event_timestamp"), F.col("trial_start"), F.col("trial_end")
    timed = ts.isNotNull() & start.isNotNull()
    counted = {
        "raw_rows": F.col("copies"), "distinct_rows": F.lit(1),
        "null_event_timestamps": F.when(ts.isNull(), F.col("copies")),
        "null_organization_ids": F.when(F.col("organization_id").isNull(), F.col("copies")),
        "events_before_window": F.when(timed & (ts < start), 1),
        "events_after_window": F.when(timed & (ts > end), 1),
        "staged_rows": F.when(F.col("organization_id").isNotNull() & ts.between(start, end), 1),
        **{b: F.col(b) for b in bad},
    }
    meta = ("converted", "converted_at", "trial_start", "trial_end")
    sums = (copies.groupBy("organization_id", *meta, "activity_name")
            .agg(*[F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(k) for k, v in counted.items()]))
    sums = landed_copy(sums, "dq-sums")
    totals = sums.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in counted])
    orgs = (sums.where(F.col("organization_id").isNotNull()).select("organization_id", *meta).distinct()
            .groupBy("organization_id").agg(F.count(F.lit(1)).alias("tuples"))
            .agg(F.count(F.lit(1)).alias("organizations"),
                 F.count_if(F.col("tuples") > 1).alias("orgs_with_conflicting_metadata")))
    names = sums.agg(F.count_distinct("activity_name").alias("activity_types"))
    removed = F.col("raw_rows") - F.col("distinct_rows")
    return totals.crossJoin(orgs).crossJoin(names).select(  # one row each
        "raw_rows", "distinct_rows", removed.alias("duplicates_removed"),
        F.round(F.try_divide(removed * F.lit(100.0), F.col("raw_rows")), 6).alias("duplicates_removed_pct"),
        "organizations", "activity_types", "null_event_timestamps", "null_organization_ids",
        "events_before_window", "events_after_window", "staged_rows", "orgs_with_conflicting_metadata", *bad)
