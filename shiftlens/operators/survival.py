"""Kaplan-Meier estimation as grouped aggregation plus distributed running sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.columns import r6
from shiftlens.operators.prefix import BUCKET, null_safe_join, range_buckets, running_sums
from shiftlens.spec import SURVIVAL_MIN_DURATION, TRIAL_DAYS, Z_975


def survival_input(org: DataFrame, trial_days: int = TRIAL_DAYS) -> DataFrame:
    """Duration = days to conversion (30 when not converted or unknown), clipped to [0.5, 30]."""
    dur = F.when(F.col("converted"), F.coalesce("days_to_conversion", F.lit(float(trial_days)))) \
        .otherwise(F.lit(float(trial_days)))
    dur = F.least(F.greatest(dur, F.lit(SURVIVAL_MIN_DURATION)), F.lit(float(trial_days)))
    group = F.when(F.col("has_any_worker_activity") == 1, F.lit("worker_active")).otherwise(F.lit("no_worker_activity"))
    return org.select("organization_id", group.alias("group"), dur.alias("duration"),
                      F.col("converted").cast("int").alias("event"))


def kaplan_meier(df: DataFrame, group: str = "group", duration: str = "duration", event: str = "event",
                 z: float = Z_975) -> DataFrame:
    """Survival curve per group with Greenwood variance and log-log 95% bounds.

    Per distinct (group, time): events ``d`` and removals ``c``.  At-risk
    ``n = N - (removed before t)`` and ``S = exp(sum ln(1 - d/n))`` are
    distributed running sums (:func:`running_sums`).  Once ``d = n`` the
    curve is 0 from there on and its bounds are null.  A time-0 row with
    ``S = 1`` starts every curve.
    """
    base = df.select(F.col(group).alias("group"), F.col(duration).cast("double").alias("time"),
                     F.col(event).cast("bigint").alias("d"), F.lit(1).cast("bigint").alias("c"))
    # Both running sums read the same checkpointed (group, time) keys.
    removed = running_sums(range_buckets(base, ["group"], "time", ["d", "c"]), ["group"], "time", ["d", "c"])
    totals = base.groupBy("group").agg(F.count(F.lit(1)).alias("N"))
    # One row per group: adaptive execution sizes (and broadcasts) this join.
    at = null_safe_join(removed, totals, ["group"]).withColumn("n", F.col("N") - (F.col("c_cum") - F.col("c")))
    dead = F.col("d") == F.col("n")
    dd, nn = F.col("d").cast("double"), F.col("n").cast("double")
    terms = at.select(
        "group", "time", BUCKET, "n", "d", (F.col("c") - F.col("d")).alias("censored"),
        F.when(dead, F.lit(0.0)).otherwise(F.log(F.lit(1.0) - dd / nn)).alias("log_term"),
        F.when(dead, F.lit(0.0)).otherwise(dd / (nn * (nn - dd))).alias("gw_term"),
        F.when(dead, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("zero_term"))
    curve = running_sums(terms, ["group"], "time", ["log_term", "gw_term", "zero_term"]).select(
        "group", "time", "n", "d", "censored", "log_term_cum", "gw_term_cum", "zero_term_cum")
    start = totals.select("group", F.lit(0.0).alias("time"), F.col("N").alias("n"), F.lit(0).cast("bigint").alias("d"),
                          F.lit(0).cast("bigint").alias("censored"), F.lit(0.0).alias("log_term_cum"),
                          F.lit(0.0).alias("gw_term_cum"), F.lit(0).cast("bigint").alias("zero_term_cum"))
    curve = curve.unionByName(start)
    zero = F.col("zero_term_cum") > 0
    surv = F.when(zero, F.lit(0.0)).otherwise(F.exp("log_term_cum"))
    v = F.col("log_term_cum")  # ln S
    spread = F.lit(z) * F.sqrt("gw_term_cum") / v
    upper = F.exp(-F.exp(F.log(-v) + spread))
    lower = F.exp(-F.exp(F.log(-v) - spread))
    return curve.select(
        "group", "time", F.col("n").alias("n_at_risk"), F.col("d").alias("n_events"), "censored",
        r6(surv).alias("survival"),
        F.when(zero, F.lit(None).cast("double")).otherwise(r6(F.exp(2 * v) * F.col("gw_term_cum"))).alias("variance"),
        F.when(zero, F.lit(None).cast("double")).when(v == 0, F.lit(1.0)).otherwise(r6(lower)).alias("ci_lower"),
        F.when(zero, F.lit(None).cast("double")).when(v == 0, F.lit(1.0)).otherwise(r6(upper)).alias("ci_upper"))
