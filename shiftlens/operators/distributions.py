"""Chart-data tables: histograms, box-plot statistics, quantile summaries, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.functions.columns import clip, hours_between, r6, safe_ratio
from shiftlens.operators.prefix import exact_quantiles, null_safe_join, quantile_columns
from shiftlens.session import checkpoint_root
from shiftlens.spec import (
    HANDOFF_BUCKETS, SCATTER_ADMIN_CAP, SCATTER_WORKER_CAP, TRIAL_DAYS, WHISKER_IQR,
)


def histogram(df: DataFrame, value: str, bins: int, lo=None, hi=None, by=None) -> DataFrame:
    """Equal-width histogram with every bin present (empty bins count 0).

    ``lo``/``hi`` are columns that are constant over ``df`` or numbers; when
    omitted the range is the min/max of each group.  Bins are closed-open
    except the last, which includes ``hi``; a zero-width range is widened by
    0.5 on each side.  Values outside the range are not counted.  A null
    group is a group of its own; a group without values has no rows.
    """
    by = list(by or [])
    x = F.col(value).cast("double")
    vals = df.where(F.col(value).isNotNull())
    if lo is None or hi is None:
        vals = vals.select(*by, x.alias("__x"))
        ranges = vals.groupBy(*by).agg(F.min("__x").alias("lo"), F.max("__x").alias("hi")).where("lo is not null")
        # One row per group: adaptive execution sizes (and broadcasts) this join.
        vals = null_safe_join(vals, ranges, by)
    else:
        lo, hi = (c if isinstance(c, Column) else F.lit(float(c)) for c in (lo, hi))
        vals = vals.select(*by, x.alias("__x"), lo.alias("lo"), hi.alias("hi"))
    flat = F.col("lo") == F.col("hi")
    vals = vals.select(*by, "__x", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                       F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    raw_bin = F.floor((F.col("__x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))
    inside = (F.col("__x") >= F.col("lo")) & (F.col("__x") <= F.col("hi"))
    # One aggregate down to at most groups x (bins + 1) rows; bin null gathers what lies outside the range.
    counts = (vals.groupBy(*by, "lo", "hi", F.when(inside, F.least(raw_bin, F.lit(bins - 1))).cast("int").alias("bin"))
              .agg(F.count(F.lit(1)).alias("n")))
    per_bin = counts.groupBy(*by, "lo", "hi").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))).alias("__n"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    return (per_bin.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
            .select(*by, "bin", r6(F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                    r6(F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                    F.coalesce(F.try_element_at("__n", F.col("bin")), F.lit(0)).cast("bigint").alias("n")))


def describe_by(df: DataFrame, by, value: str, probs: dict[str, float], exact: bool = True) -> DataFrame:
    """n, mean and named quantiles of ``value`` per group (null values dropped, a null group kept)."""
    by = list(by or [])
    vals = df.where(F.col(value).isNotNull())
    basic_aggs = [F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")]
    basic = vals.groupBy(*by).agg(*basic_aggs)
    out = null_safe_join(basic, quantile_columns(vals, by, value, probs, exact=exact), by, "left")
    return out.select(*by, "n", r6("mean").alias("mean"), *[r6(k).alias(k) for k in probs])


def with_quantile(df: DataFrame, value: str, p: float, name: str) -> DataFrame:
    """``df`` with one exact quantile of ``value`` as a constant column (null without values).

    The quantile is checkpointed as one row, so its plan is not inlined at every use.
    """
    checkpoint_root(df.sparkSession)
    row = (exact_quantiles(df, [], value, [p]).agg(F.max("quantile").alias(name))).checkpoint(eager=True)
    return df.crossJoin(F.broadcast(row))


def hist_total_events(org: DataFrame, bins: int = 35) -> DataFrame:
    """Total events capped at the 95th percentile, bins over [0, p95], by outcome."""
    capped = with_quantile(org, "total_events", 0.95, "__q").withColumn("__v", clip("total_events", upper=F.col("__q")))
    return histogram(capped, "__v", bins, lo=0.0, hi=F.col("__q"), by=["converted"])


def hist_active_days(org: DataFrame, bins: int = 24) -> DataFrame:
    """Admin active days, bins over [0, overall max], by outcome."""
    top = org.agg(F.max("admin_active_days").cast("double").alias("__top"))
    return histogram(org.crossJoin(F.broadcast(top)), "admin_active_days", bins, lo=0.0, hi=F.col("__top"),
                     by=["converted"])


def worker_timing_frame(org: DataFrame) -> DataFrame:
    return (org.where(F.col("hours_to_first_worker").isNotNull())
            .withColumn("days_to_first_worker", F.col("hours_to_first_worker") / F.lit(24.0)))


def handoff_frame(org: DataFrame) -> DataFrame:
    """Organisations with both sides active; gap clipped at 0, in hours and days."""
    gap = clip(hours_between("first_admin_ts", "first_worker_ts"), lower=0.0)
    return (org.where(F.col("first_worker_ts").isNotNull() & F.col("first_admin_ts").isNotNull())
            .withColumn("handoff_gap_hrs", gap)
            .withColumn("handoff_gap_days", F.col("handoff_gap_hrs") / F.lit(24.0)))


def _capped_auto_hist(frame: DataFrame, value: str, bins: int) -> DataFrame:
    capped = with_quantile(frame, value, 0.95, "__q").withColumn("__v", clip(value, upper=F.col("__q")))
    return histogram(capped, "__v", bins, by=["converted"])


def hist_first_worker(org: DataFrame, bins: int = 25) -> DataFrame:
    """Days to first worker event, capped at p95, auto range per outcome."""
    return _capped_auto_hist(worker_timing_frame(org), "days_to_first_worker", bins)


def hist_handoff_gap(org: DataFrame, bins: int = 25) -> DataFrame:
    """Handoff gap in days, capped at p95, auto range per outcome."""
    return _capped_auto_hist(handoff_frame(org), "handoff_gap_days", bins)


def hist_worker_share(org: DataFrame, bins: int = 20) -> DataFrame:
    """Worker share of events in percent, auto range per outcome."""
    pct = org.withColumn("__v", F.col("worker_event_share") * 100)
    return histogram(pct, "__v", bins, by=["converted"])


def boxplot_stats(org: DataFrame, metrics, by: str = "converted") -> DataFrame:
    """Quartiles, 1.5-IQR whiskers and outlier counts per metric and ``by`` group."""
    long = org.select(by, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m, _ in metrics])))
    long = long.where(F.col("value").isNotNull())
    q = quantile_columns(long, ["metric", by], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    fences = q.select("*", iqr.alias("iqr"), (F.col("q1") - WHISKER_IQR * iqr).alias("__lo"),
                      (F.col("q3") + WHISKER_IQR * iqr).alias("__hi"))
    v = F.col("value")
    # fences: one row per (metric, group); sized by adaptive execution.
    joined = null_safe_join(long, fences, ["metric", by])
    agg = joined.groupBy("metric", by, "q1", "median", "q3", "iqr").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(v >= F.col("__lo"), v)).alias("__wlo"),
        F.max(F.when(v <= F.col("__hi"), v)).alias("__whi"),
        F.count_if((v < F.col("__lo")) | (v > F.col("__hi"))).alias("n_outliers"))
    return agg.select("metric", by, "n", r6("q1").alias("q1"), r6("median").alias("median"),
                      r6("q3").alias("q3"), r6("iqr").alias("iqr"),
                      r6(F.coalesce("__wlo", "q1")).alias("whisker_lo"),
                      r6(F.coalesce("__whi", "q3")).alias("whisker_hi"), "n_outliers")


def scatter_admin_worker(org: DataFrame) -> DataFrame:
    return org.select("organization_id", "converted",
                      F.least("admin_events", F.lit(SCATTER_ADMIN_CAP)).cast("bigint").alias("admin_events_capped"),
                      F.least("worker_events", F.lit(SCATTER_WORKER_CAP)).cast("bigint").alias("worker_events_capped"))


QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def worker_timing(org: DataFrame, exact: bool = True) -> DataFrame:
    """Days from trial start to first worker event, by outcome."""
    return describe_by(worker_timing_frame(org), ["converted"], "days_to_first_worker", QUARTILES, exact)


def handoff_gap(org: DataFrame, exact: bool = True) -> DataFrame:
    """Gap from first admin to first worker event: overall and by outcome (hours)."""
    h = handoff_frame(org)
    scoped = h.select(F.explode(F.array(
        F.lit("all"), F.when(F.col("converted"), F.lit("converted")).otherwise(F.lit("not_converted")))).alias("scope"),
        "handoff_gap_hrs")
    out = describe_by(scoped, ["scope"], "handoff_gap_hrs", QUARTILES, exact)
    return out.withColumn("median_days", r6(F.col("median") / F.lit(24.0)))


def bucket_table(spark, buckets) -> DataFrame:
    return spark.createDataFrame([(i, float(lo), float(hi), label) for i, (lo, hi, label) in enumerate(buckets, 1)],
                                 "bucket_no int, lo double, hi double, label string")


def bucketize_ranges(df: DataFrame, value: str, buckets) -> DataFrame:
    """Attach ``bucket_no, label, lo, hi`` of the closed-open range holding ``value``.

    ``buckets`` is a fixed list of ``(lo, hi, label)``; the table is broadcast
    (its size is the list's) and matched by a range condition.  Rows in no
    range are dropped, as the bucket report counts only matched rows.
    """
    table = bucket_table(df.sparkSession, buckets)
    cond = (df[value] >= table["lo"]) & (df[value] < table["hi"])
    return df.join(F.broadcast(table), cond)


def handoff_buckets(org: DataFrame, buckets=HANDOFF_BUCKETS) -> DataFrame:
    """Organisations and conversion per closed-open gap bucket (range join).

    An empty bucket keeps its row (rate null, chart rate 0).
    """
    table = bucket_table(org.sparkSession, buckets)
    h = handoff_frame(org).select("handoff_gap_hrs", "converted")
    matched = bucketize_ranges(h, "handoff_gap_hrs", buckets).groupBy("bucket_no").agg(
        F.count(F.lit(1)).alias("n_orgs"), F.avg(F.col("converted").cast("int")).alias("__c"))
    return (table.join(matched, "bucket_no", "left")
            .select("bucket_no", "label", "lo", "hi", F.coalesce("n_orgs", F.lit(0)).cast("bigint").alias("n_orgs"),
                    r6("__c").alias("conv_rate"), r6(F.coalesce(F.col("__c") * 100, F.lit(0.0))).alias("conv_rate_pct_chart")))


def adoption_curve(org: DataFrame, days: int = TRIAL_DAYS) -> DataFrame:
    """Share of organisations (per outcome) with a worker event by day d, d = 0..days.

    An organisation first counts on day ``max(0, ceil(days_to_first_worker))``;
    the curve is a running sum over at most ``days + 1`` rows per outcome, so
    its window is bounded by the trial length, never by the data.
    """
    d = F.col("hours_to_first_worker") / F.lit(24.0)
    first_day = F.greatest(F.lit(0), F.ceil(d)).cast("int")
    per_day = (org.where(F.col("hours_to_first_worker").isNotNull())
               .groupBy("converted", first_day.alias("day")).agg(F.count(F.lit(1)).alias("__new")))
    totals = org.groupBy("converted").agg(F.count(F.lit(1)).alias("n_orgs"))
    grid = totals.select("converted", "n_orgs", F.explode(F.sequence(F.lit(0), F.lit(days))).alias("day"))
    running = Window.partitionBy("converted").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    curve = grid.join(per_day, ["converted", "day"], "left").withColumn(
        "n_orgs_reached", F.sum(F.coalesce("__new", F.lit(0))).over(running).cast("bigint"))
    return curve.select("converted", "day", "n_orgs_reached", "n_orgs",
                        r6(safe_ratio("n_orgs_reached", "n_orgs") * 100).alias("cum_pct"))


def metric_quantiles(org: DataFrame, exact: bool = True) -> DataFrame:
    """Median and 95th percentile of the headline metrics."""
    wt = worker_timing_frame(org).select(F.lit("days_to_first_worker").alias("metric"),
                                         F.col("days_to_first_worker").alias("value"))
    hf = handoff_frame(org).select(F.lit("handoff_gap_days").alias("metric"), F.col("handoff_gap_days").alias("value"))
    base = org.select(F.inline(F.array(
        F.struct(F.lit("total_events").alias("metric"), F.col("total_events").cast("double").alias("value")),
        F.struct(F.lit("admin_active_days").alias("metric"), F.col("admin_active_days").cast("double").alias("value")))))
    long = base.unionByName(wt).unionByName(hf)
    q = quantile_columns(long, ["metric"], "value", {"median": 0.5, "p95": 0.95}, exact=exact)
    return q.select("metric", r6("median").alias("median"), r6("p95").alias("p95"))


def capped_metrics(org: DataFrame) -> DataFrame:
    """Per organisation, every capped value the charts plot (nulls stay null)."""
    days_first = F.col("hours_to_first_worker") / F.lit(24.0)
    gap_days = F.when(F.col("first_worker_ts").isNotNull() & F.col("first_admin_ts").isNotNull(),
                      F.greatest(hours_between("first_admin_ts", "first_worker_ts"), F.lit(0.0)) / F.lit(24.0))
    # One pass finds all three caps (nulls of a metric are left out of its quantile).
    long = org.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in (
        ("cap_total", F.col("total_events")), ("cap_first", days_first), ("cap_gap", gap_days))])))
    q = exact_quantiles(long, ["metric"], "value", [0.95])
    caps = q.agg(*[F.max(F.when(F.col("metric") == m, F.col("quantile"))).alias(m)
                   for m in ("cap_total", "cap_first", "cap_gap")])
    return org.crossJoin(F.broadcast(caps)).select(
        "organization_id", "converted",
        r6(clip("total_events", upper=F.col("cap_total"))).alias("total_events_capped"),
        F.least("admin_events", F.lit(SCATTER_ADMIN_CAP)).cast("bigint").alias("admin_events_capped"),
        F.least("worker_events", F.lit(SCATTER_WORKER_CAP)).cast("bigint").alias("worker_events_capped"),
        r6(clip(days_first, upper=F.col("cap_first"))).alias("days_to_first_worker_capped"),
        r6(clip(gap_days, upper=F.col("cap_gap"))).alias("handoff_gap_days_capped"))
