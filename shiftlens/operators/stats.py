"""Statistical tests as aggregations: chi-square 2x2 (Yates), Mann-Whitney U, ROC-AUC."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.columns import erfc, normal_two_sided_p
from shiftlens.operators.prefix import global_prefix_sum
from shiftlens.spec import SIGNIFICANCE


def chi_square_from_cells(yes_conv, yes_not, no_conv, no_not):
    """Yates-corrected chi-square statistic and p for a 2x2 table of counts.

    With ``d = |O - E|`` (equal in all four cells) the corrected statistic is
    ``max(d - 0.5, 0)^2 * sum(1/E)``; p for one degree of freedom is
    ``erfc(sqrt(x / 2))``.  A table with an empty row or column is not 2x2:
    statistic null, p = 1.
    """
    a, b, c, d = (F.col(x).cast("double") for x in (yes_conv, yes_not, no_conv, no_not))
    n = a + b + c + d
    r1, r2, c1, c2 = a + b, c + d, a + c, b + d
    is_2x2 = (r1 > 0) & (r2 > 0) & (c1 > 0) & (c2 > 0)
    ea, eb, ec, ed = r1 * c1 / n, r1 * c2 / n, r2 * c1 / n, r2 * c2 / n
    dev = F.greatest(F.abs(a - ea) - F.lit(0.5), F.lit(0.0))
    stat = dev * dev * (F.lit(1.0) / ea + F.lit(1.0) / eb + F.lit(1.0) / ec + F.lit(1.0) / ed)
    chi2 = F.when(is_2x2, stat)
    p = F.when(is_2x2, erfc(F.sqrt(stat / F.lit(2.0)))).otherwise(F.lit(1.0))
    return chi2, p, is_2x2


def with_chi_square(df: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """Adds ``chi2``, ``p_value`` (unrounded) and ``is_2x2`` from four cell columns.

    The statistic is projected before the p-value so ``erfc`` is generated
    over a column reference, keeping the generated code small.
    """
    chi2, _, is_2x2 = chi_square_from_cells(a, b, c, d)
    staged = df.withColumns({"chi2": chi2, "is_2x2": is_2x2})
    return staged.withColumn("p_value", F.when(F.col("is_2x2"), erfc(F.sqrt(F.col("chi2") / F.lit(2.0))))
                             .otherwise(F.lit(1.0)))


def chi_square_2x2(df: DataFrame, flag: str, outcome: str = "converted") -> DataFrame:
    """Chi-square test of independence between a 0/1 flag and a boolean outcome."""
    f, o = F.col(flag) == 1, F.col(outcome)
    cells = df.agg(
        F.count_if(f & o).alias("yes_converted"), F.count_if(f & ~o).alias("yes_not_converted"),
        F.count_if(~f & o).alias("no_converted"), F.count_if(~f & ~o).alias("no_not_converted"))
    out = with_chi_square(cells, "yes_converted", "yes_not_converted", "no_converted", "no_not_converted")
    return out.withColumn("significant", F.col("p_value") < SIGNIFICANCE)


def rank_sums(long: DataFrame, by, value: str, outcome: str) -> DataFrame:
    """Per group: n1, n0, rank sum of the ``outcome`` rows, and the tie term.

    Ranks are average ranks over ties, from a distributed prefix sum over the
    distinct values.  ``long`` holds one row per observation.
    """
    by = list(by)
    counts = long.where(F.col(value).isNotNull() & F.col(outcome).isNotNull()).select(
        *by, F.col(value).cast("double").alias("__v"),
        F.when(F.col(outcome), 1).otherwise(0).cast("bigint").alias("__n1"),
        F.when(F.col(outcome), 0).otherwise(1).cast("bigint").alias("__n0"))
    counts = counts.withColumn("__t", F.col("__n1") + F.col("__n0"))
    ps = global_prefix_sum(counts, by, "__v", ["__n1", "__n0", "__t"])
    avg_rank = (F.col("__t_cum") - F.col("__t")) + (F.col("__t") + F.lit(1.0)) / F.lit(2.0)
    t = F.col("__t").cast("double")
    return ps.groupBy(*by).agg(
        F.sum("__n1").alias("n1"), F.sum("__n0").alias("n0"),
        F.sum(F.col("__n1") * avg_rank).alias("rank_sum_1"),
        F.sum(t * t * t - t).alias("tie_term"))


def mann_whitney(long: DataFrame, by, value: str, outcome: str = "converted") -> DataFrame:
    """Two-sided Mann-Whitney U (asymptotic, tie- and continuity-corrected).

    ``u_stat`` is U of the ``outcome == True`` sample.  ``small_sample`` marks
    groups where an exact test would normally be used (a sample of 8 or fewer).
    """
    by = list(by)
    rs = rank_sums(long, by, value, outcome)
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    u1 = F.col("rank_sum_1") - n1 * (n1 + 1) / 2
    u_big = F.greatest(u1, n1 * n0 - u1)
    sigma = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.col("tie_term") / (n * (n - 1))))
    z = (u_big - n1 * n0 / 2 - F.lit(0.5)) / sigma
    staged = rs.select(*by, "n1", "n0", u1.alias("u_stat"), sigma.alias("__sigma"),
                       F.when(sigma > 0, z).alias("z"))
    p = (F.when((F.col("n1") == 0) | (F.col("n0") == 0), F.lit(None).cast("double"))
         .when(F.col("__sigma") == 0, F.lit(1.0))
         .otherwise(F.least(F.lit(1.0), normal_two_sided_p("z"))))
    return staged.withColumn("p_value", p).select(
        *by, F.col("n1").alias("n_converted"), F.col("n0").alias("n_not_converted"),
        "u_stat", "z", "p_value", (F.col("p_value") < SIGNIFICANCE).alias("significant"),
        ((F.col("n1") <= 8) | (F.col("n0") <= 8)).alias("small_sample"))


def roc_auc(long: DataFrame, by, score: str, label: str) -> DataFrame:
    """Exact ROC-AUC per group: ``U / (n_pos * n_neg)`` with ties counted half."""
    by = list(by)
    rs = rank_sums(long, by, score, label)
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    u1 = F.col("rank_sum_1") - n1 * (n1 + 1) / 2
    return rs.select(*by, F.col("n1").alias("n_pos"), F.col("n0").alias("n_neg"),
                     F.when((n1 > 0) & (n0 > 0), u1 / (n1 * n0)).alias("auc"))
