"""Report tables over the organisation features (one small result each).

Each report is a single aggregation over the organisation frame; tables with
a fixed set of rows (flags, stages, archetypes) are aggregated in one pass
and then unpivoted, rather than filtered once per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.functions.columns import r6, safe_ratio
from shiftlens.operators.stats import with_chi_square
from shiftlens.spec import ARCHETYPES, FUNNEL_STAGES, SIGNIFICANCE, UPLIFT_FLAGS


def _rate():
    return F.col("converted").cast("int")


def conversion_overview(org: DataFrame) -> DataFrame:
    """Organisations, conversion rate, and the split by worker activity."""
    w = F.col("has_any_worker_activity") == 1
    agg = org.agg(
        F.count(F.lit(1)).alias("total_orgs"),
        F.count_if(F.col("converted")).alias("converted_orgs"),
        F.count_if(w).alias("orgs_with_worker_activity"),
    )
    return agg.select(
        "total_orgs", "converted_orgs",
        (F.col("total_orgs") - F.col("converted_orgs")).alias("not_converted_orgs"),
        r6(safe_ratio("converted_orgs", "total_orgs")).alias("conversion_rate"),
        "orgs_with_worker_activity",
        (F.col("total_orgs") - F.col("orgs_with_worker_activity")).alias("orgs_without_worker_activity"),
        r6(safe_ratio("orgs_with_worker_activity", "total_orgs")).alias("share_with_worker"),
        r6(safe_ratio(F.col("total_orgs") - F.col("orgs_with_worker_activity"), "total_orgs"))
        .alias("share_without_worker"),
    )


def _flag_cells(org: DataFrame, flags) -> list:
    """Four 2x2 cell counts per flag, as aggregate expressions."""
    o = F.col("converted")
    aggs = []
    for i, (_, col) in enumerate(flags):
        f = F.col(col) == 1
        aggs += [F.count_if(f & o).alias(f"a{i}"), F.count_if(f & ~o).alias(f"b{i}"),
                 F.count_if(~f & o).alias(f"c{i}"), F.count_if(~f & ~o).alias(f"d{i}")]
    return aggs


def _unpivot_flags(org: DataFrame, flags) -> DataFrame:
    """One aggregation pass, then one row per flag: label, column, 4 cells."""
    one = org.agg(*_flag_cells(org, flags))
    rows = [F.struct(F.lit(i + 1).alias("flag_no"), F.lit(label).alias("activity"), F.lit(col).alias("flag"),
                     F.col(f"a{i}").alias("yes_converted"), F.col(f"b{i}").alias("yes_not_converted"),
                     F.col(f"c{i}").alias("no_converted"), F.col(f"d{i}").alias("no_not_converted"))
            for i, (label, col) in enumerate(flags)]
    return one.select(F.inline(F.array(*rows)))


def chi_square_flags(org: DataFrame, flags=UPLIFT_FLAGS) -> DataFrame:
    """Yates chi-square of each worker flag against conversion."""
    cells = with_chi_square(_unpivot_flags(org, flags), "yes_converted", "yes_not_converted", "no_converted",
                            "no_not_converted")
    p = F.col("p_value")
    return cells.select("flag", "yes_converted", "yes_not_converted", "no_converted", "no_not_converted",
                        r6("chi2").alias("chi2"), r6(p).alias("p_value"), (p < SIGNIFICANCE).alias("significant"),
                        "is_2x2")


def activity_uplift(org: DataFrame, flags=UPLIFT_FLAGS) -> DataFrame:
    """Conversion with vs without each worker flag, uplift and significance."""
    cells = with_chi_square(_unpivot_flags(org, flags), "yes_converted", "yes_not_converted", "no_converted",
                            "no_not_converted")
    yes = F.col("yes_converted") + F.col("yes_not_converted")
    no = F.col("no_converted") + F.col("no_not_converted")
    total = yes + no
    conv_yes = safe_ratio("yes_converted", yes) * 100
    conv_no = safe_ratio("no_converted", no) * 100
    p = F.col("p_value")
    out = cells.select(
        "activity", "flag", yes.alias("n_orgs"), r6(safe_ratio(yes, total) * 100).alias("pct_orgs"),
        r6(conv_yes).alias("conv_yes"), r6(conv_no).alias("conv_no"), r6(conv_yes - conv_no).alias("uplift_pp"),
        r6(p).alias("p_value"), (p < SIGNIFICANCE).alias("significant"),
        (conv_yes - conv_no).alias("__u"))
    order = Window.orderBy(F.col("__u").desc_nulls_last(), F.col("activity"))  # six rows
    return out.withColumn("rank", F.row_number().over(order).cast("int")).drop("__u")


def crosstab_worker_converted(org: DataFrame) -> DataFrame:
    """2x2 cross-tabulation of worker activity against conversion (missing -> 0)."""
    piv = org.groupBy("has_any_worker_activity").pivot("converted", [False, True]).count()
    return piv.select("has_any_worker_activity",
                      F.coalesce(F.col("false"), F.lit(0)).cast("bigint").alias("not_converted"),
                      F.coalesce(F.col("true"), F.lit(0)).cast("bigint").alias("converted"))


def worker_headline(org: DataFrame) -> DataFrame:
    """Conversion with and without worker activity, uplift and chi-square."""
    cells = with_chi_square(_unpivot_flags(org, [("Any Worker Activity", "has_any_worker_activity")]),
                            "yes_converted", "yes_not_converted", "no_converted", "no_not_converted")
    yes = F.col("yes_converted") + F.col("yes_not_converted")
    no = F.col("no_converted") + F.col("no_not_converted")
    conv_w, conv_nw = safe_ratio("yes_converted", yes), safe_ratio("no_converted", no)
    chi2, p = F.col("chi2"), F.col("p_value")
    return cells.select(
        yes.alias("n_with_worker"), no.alias("n_without_worker"),
        r6(conv_w).alias("conv_rate_with_worker"), r6(conv_nw).alias("conv_rate_without_worker"),
        r6((conv_w - conv_nw) * 100).alias("uplift_pp"),
        r6(chi2).alias("chi2"), r6(p).alias("p_value"), (p < SIGNIFICANCE).alias("significant"))


def archetypes(org: DataFrame) -> DataFrame:
    """Archetype summary; figures rounded half-to-even to 2 places, rate also raw."""
    agg = org.groupBy("archetype").agg(
        F.count(F.lit(1)).alias("n_orgs"), F.avg(_rate()).alias("__c"),
        F.avg("admin_events").alias("__a"), F.avg("worker_events").alias("__w"),
        F.avg("admin_active_days").alias("__d"))
    return agg.select(
        "archetype", "n_orgs", F.bround("__c", 2).alias("conv_rate"),
        F.bround("__a", 2).alias("avg_admin_events"), F.bround("__w", 2).alias("avg_worker_events"),
        F.bround("__d", 2).alias("avg_admin_active_days"),
        (F.bround("__c", 2) * 100).alias("conv_rate_pct"), r6("__c").alias("conv_rate_raw"))


def archetype_table(spark) -> DataFrame:
    return spark.createDataFrame(list(ARCHETYPES), "archetype_order int, archetype string, short_name string")


def archetype_chart(org: DataFrame) -> DataFrame:
    """Archetype summary re-indexed to the fixed display order (missing -> 0)."""
    summary = archetypes(org)
    cats = F.broadcast(archetype_table(org.sparkSession))
    return cats.join(summary, "archetype", "left").select(
        "archetype_order", "archetype", "short_name",
        F.coalesce("n_orgs", F.lit(0)).cast("bigint").alias("n_orgs"),
        F.coalesce("conv_rate_pct", F.lit(0.0)).alias("conv_rate_pct"),
        F.coalesce("avg_admin_events", F.lit(0.0)).alias("avg_admin_events"),
        F.coalesce("avg_worker_events", F.lit(0.0)).alias("avg_worker_events"))


def depth_summary(org: DataFrame) -> DataFrame:
    agg = org.groupBy("worker_depth_score").agg(F.count(F.lit(1)).alias("n_orgs"), F.avg(_rate()).alias("__c"))
    return agg.select("worker_depth_score", "n_orgs", r6("__c").alias("conv_rate"),
                      r6(F.col("__c") * 100).alias("conv_rate_pct"))


def side_volume_by_outcome(org: DataFrame) -> DataFrame:
    return org.groupBy("converted").agg(
        F.count(F.lit(1)).alias("n_orgs"),
        r6(F.avg("admin_events")).alias("avg_admin_events"),
        r6(F.avg("worker_events")).alias("avg_worker_events"),
        r6(F.avg("worker_event_share")).alias("avg_worker_event_share"))


def adoption_funnel(rollup_features: DataFrame, nested: bool = False) -> DataFrame:
    """Six stage counts, share of all organisations and drop-off.

    By default stages are counted independently (as the analysis does), so a
    later stage can be larger than the one before it and its drop-off
    negative.  ``nested=True`` counts an organisation at a stage only if it
    also reached every earlier stage.
    """
    f = rollup_features
    conds = [F.lit(True), F.col("shift_created_events") > 0, F.col("has_mobile_view") == 1,
             F.col("has_any_worker_activity") == 1, F.col("has_punchclock") == 1,
             F.coalesce(F.col("converted"), F.lit(False))]
    if nested:
        acc, cumulative = F.lit(True), []
        for c in conds:
            acc = acc & c
            cumulative.append(acc)
        conds = cumulative
    one = f.agg(*[F.count_if(c).alias(f"s{i}") for i, c in enumerate(conds, start=1)])
    rows = [F.struct(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), F.col(f"s{i}").alias("count"),
                     F.col("s1").alias("__total"))
            for i, name in enumerate(FUNNEL_STAGES, start=1)]
    stages = one.select(F.inline(F.array(*rows)))
    prev = F.lag("count").over(Window.orderBy("stage_no"))  # six rows
    return stages.select(
        "stage_no", "stage", "count",
        r6(safe_ratio("count", "__total") * 100).alias("pct_total"),
        F.when(F.col("stage_no") == 1, F.lit(0.0))
        .otherwise(r6((F.lit(1.0) - safe_ratio("count", prev)) * 100)).alias("drop_off"))
