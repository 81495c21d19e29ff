"""Running sums, ranks and exact quantiles without a single-task window.

A window ordered over a whole column (``Window.orderBy(x)`` with no
partition, or partitioned by a two-valued outcome) sorts every row in one
task.  Here the work is one path for any number of groups and any key type:

1. :func:`range_buckets` aggregates rows to distinct ``(group, order)`` keys (a
   value shared by a third of the rows is then a single row), range-partitions
   the keys and checkpoints them with their range number, so every branch
   of the plan and every recomputation after a lost executor reads the same
   bucket from the shared folder;
2. :func:`running_sums` turns bucket totals (at most groups + buckets rows) into
   offsets and adds them to the running sum inside each ``(group, bucket)``.

Groups are matched null-safe: rows of a null group form a group of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.session import checkpoint_root

BUCKET = "__bucket"


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named columns where null equals null; keeps the left copy of the keys."""
    if not on:
        return left.crossJoin(F.broadcast(right))  # callers pass one-row frames on the right
    renamed = right.select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(on)],
                           *[c for c in right.columns if c not in on])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__r{i}")) for i, c in enumerate(on)])
    return left.join(renamed, same, how).drop(*[f"__r{i}" for i in range(len(on))])


def range_buckets(df: DataFrame, by, order: str, values, buckets: int | None = None) -> DataFrame:
    """Distinct ``(by, order)`` keys with summed ``values`` and their range bucket, checkpointed.

    Buckets ascend with ``(by, order)`` and hold about equally many distinct keys;
    their number follows ``spark.sql.shuffle.partitions``.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = [*(by or []), order]
    checkpoint_root(spark)
    return (df.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
            .repartitionByRange(n, *keys).withColumn(BUCKET, F.spark_partition_id())
            .checkpoint(eager=True))


def _offsets(bucketed: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """``by``, bucket and per value its total in the bucket and before it in the group."""
    totals = bucketed.groupBy(*by, BUCKET).agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    before = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("*", *[F.coalesce(F.sum(f"__t_{v}").over(before), F.lit(0)).alias(f"__o_{v}")
                                for v in values])


def running_sums(bucketed: DataFrame, by, order: str, values) -> DataFrame:
    """All columns of ``bucketed`` plus ``<value>_cum``, the inclusive sum within ``by`` up to ``order``."""
    by = list(by or [])
    offsets = _offsets(bucketed, by, values).select(*by, BUCKET, *[f"__o_{v}" for v in values])
    inside = Window.partitionBy(*by, BUCKET).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return null_safe_join(bucketed, offsets, [*by, BUCKET]).select(
        *bucketed.columns, *[(F.sum(v).over(inside) + F.col(f"__o_{v}")).alias(f"{v}_cum") for v in values])


def global_prefix_sum(df: DataFrame, by, order: str, values, buckets: int | None = None) -> DataFrame:
    """Inclusive running sums of ``values`` within ``by`` groups, ascending ``order``.

    Rows are aggregated to distinct ``(by, order)`` first (values summed).
    Returns ``by, order, values..., <value>_cum...``.
    """
    by = list(by or [])
    values = [values] if isinstance(values, str) else list(values)
    return running_sums(range_buckets(df, by, order, values, buckets), by, order, values).drop(BUCKET)


def exact_quantiles(df: DataFrame, by, value: str, probs) -> DataFrame:
    """Exact linear-interpolation quantiles (pandas/NumPy default) per group.

    The bucket holding each wanted rank is picked from the bucket totals and
    only those buckets are ordered, so no task ever holds a whole group.
    Returns ``by, prob, quantile`` (one row per group and probability).
    """
    by = list(by or [])
    probs = [float(p) for p in probs]
    vals = (df.where(F.col(value).isNotNull())
            .select(*by, F.col(value).cast("double").alias("__v"), F.lit(1).cast("bigint").alias("__n")))
    bucketed = range_buckets(vals, by, "__v", ["__n"])
    offsets = _offsets(bucketed, by, ["__n"])
    total = F.sum("__t___n").over(Window.partitionBy(*by))
    # Ranks count from 0; a quantile lies between its lower and its upper neighbour.
    ranked = (offsets.withColumn("__total", total)
              .withColumn("prob", F.explode(F.array(*[F.lit(p) for p in probs])))
              .withColumn("__h", (F.col("__total") - 1) * F.col("prob"))
              .withColumn("__k", F.explode(F.array_distinct(F.array(F.floor("__h"), F.ceil("__h")))))
              .where((F.col("__k") >= F.col("__o___n")) & (F.col("__k") < F.col("__o___n") + F.col("__t___n"))))
    # Before the join: groups x probs x 2 rows at most; the join reads only the buckets they name.
    wanted = ranked.groupBy(*by, BUCKET).agg(
        F.first("__o___n").alias("__o"), F.collect_list(F.struct("prob", "__h", "__k")).alias("__wanted"))
    inside = Window.partitionBy(*by, BUCKET).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    found = (null_safe_join(bucketed, wanted, [*by, BUCKET])
             .withColumn("__upto", F.sum("__n").over(inside) + F.col("__o"))
             .withColumn("__w", F.explode(F.filter("__wanted", lambda w: (
                 (w["__k"] >= F.col("__upto") - F.col("__n")) & (w["__k"] < F.col("__upto"))))))
             .select(*by, "__v", "__w.*"))
    lower = F.max(F.when(F.col("__k") == F.floor("__h"), F.col("__v")))
    upper = F.max(F.when(F.col("__k") == F.ceil("__h"), F.col("__v")))
    part = F.first("__h") - F.floor(F.first("__h"))
    return found.groupBy(*by, "prob").agg((lower + (upper - lower) * part).alias("quantile"))


def quantile_columns(df: DataFrame, by, value: str, named_probs: dict[str, float], exact: bool = True) -> DataFrame:
    """Quantiles as columns: ``by, <name>...`` (exact, or ``percentile_approx``)."""
    by = list(by or [])
    if not exact:
        return df.groupBy(*by).agg(*[F.percentile_approx(value, p, 10000).cast("double").alias(n)
                                     for n, p in named_probs.items()])
    return exact_quantiles(df, by, value, list(named_probs.values())).groupBy(*by).agg(*[
        F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("quantile"))).alias(n) for n, p in named_probs.items()])
