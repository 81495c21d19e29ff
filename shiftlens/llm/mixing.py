"""Mixing sources to target weights by hierarchical budgeting.

Leaves of a domain-language-source tree get token budgets top-down.  At every
node the children share the node's budget by weight; a child whose subtree
cannot supply its share (supply times ``max_epochs``) gives the rest to its
siblings, and only what the whole sibling group cannot use is left to the
level above.  A leaf's budget is filled by whole epochs of its documents and
the token-prefix of one more epoch in an order seeded per epoch.

The prefix sums run over (leaf, order bucket) groups, so a leaf with a third
of all rows is split over ``BUCKETS`` window groups.  Target weights can be given
per node of any level (``weights``); without them a node weighs a power of its
supply.

Defined results: null source, lang or domain is a leaf of its own; null or
wordless text has 0 tokens and goes with every epoch that reaches it; ties of
the order key fall to the doc_id and then the text digest, and rows equal in both are taken in
any order; a text of any length is counted whole; other columns are not read; a
given weight that is null, zero or negative is none; an empty table gives an
empty mixture.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.operators.prefix import global_prefix_sum

from .common import SPACE, join_groups, landed, split_words

LEVELS = ("domain", "lang", "source")
BUCKETS = 4096  # three hex digits of the order key
BUDGET_SHARE = 0.8
MAX_EPOCHS = 2
ALPHA = 0.5
SEED = 7


def domain_of(source: Column) -> Column:
    """Default domain: the site family a source id hashes to (four families)."""
    return F.concat(F.lit("family"), F.pmod(F.crc32(F.coalesce(source, F.lit("")).cast("binary")), F.lit(4)).cast("string"))


def _key(columns: list[str]) -> Column:
    """One string per combination of values, null kept apart from any text."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _share(children: DataFrame, parent: list[str], budget: str, out: str) -> DataFrame:
    """Split ``budget`` of each parent among children by ``w`` up to ``cap``.

    Children saturate in the order of cap/weight; the level of the rest is the
    highest one that the first child it covers allows.  The running sums are
    distributed over range buckets, so siblings of any number meet no single task.
    """
    keyed = landed(children.withColumn("__p", _key(parent) if parent else F.lit("")).withColumn(
        "__ratio", F.col("cap") / F.col("w")), "siblings")
    # Equal ratios saturate together, so they count as one child.
    sums = global_prefix_sum(keyed.select("__p", "__ratio", "cap", "w"), ["__p"], "__ratio", ["cap", "w"])
    whole = keyed.groupBy("__p").agg(F.max(budget).alias("__b"), F.sum("w").alias("__w"),
                                     F.count(F.lit(1)).alias("__n"))
    level = ((F.col("__b") - (F.col("cap_cum") - F.col("cap")))
             / (F.col("__w") - (F.col("w_cum") - F.col("w"))))
    levels = (sums.join(whole, "__p").withColumn("__level", level).groupBy("__p", "__n")
              .agg(F.max(F.when(F.col("__level") <= F.col("__ratio"), F.col("__level"))).alias("__open")))
    return (join_groups(keyed, landed(levels, "levels"), "__p", "__n")
            .withColumn(out, F.when(F.col("__open").isNull(), F.col("cap"))
                        .otherwise(F.least(F.col("cap"), F.col("__open") * F.col("w"))))
            .drop("__p", "__ratio", "__n", "__open"))


def _given(leaves: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Leaves whose node at ``keys`` has a positive given weight, with it as ``g_<level>``."""
    given = (weights.groupBy(*[F.col(k).alias(f"g__{k}") for k in keys])
             .agg(F.sum(F.col("weight").cast("double")).alias(f"g_{keys[-1]}")).where(F.col(f"g_{keys[-1]}") > 0))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"g__{k}")) for k in keys])
    return leaves.join(given, same).drop(*[f"g__{k}" for k in keys])


def budgets(leaves: DataFrame, total_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS,
            alpha: float = ALPHA, weights: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per leaf (domain, lang, source, supply) with its token budget.

    ``weights`` gives target weights by level: the table of a level holds the
    columns of the path down to it (``domain``; ``domain, lang``; all three) and
    ``weight``, in any unit, compared among siblings only.  Repeated entries add
    up.  At a level with a table, a node without a positive weight gets nothing
    and its leaves leave the tree.  At the other levels a node's weight is the
    ``alpha`` power of its token supply.  The whole budget is ``total_share`` of
    the supply of the leaves that stay.
    """
    weights = weights or {}
    unknown = set(weights) - set(LEVELS)
    if unknown:
        raise ValueError(f"no such level: {sorted(unknown)}")
    leaves = leaves.where("supply > 0").withColumn("supply", F.col("supply").cast("double"))
    for depth, level in enumerate(LEVELS):
        if level in weights:
            leaves = _given(leaves, weights[level], list(LEVELS[:depth + 1]))
    leaves = landed(leaves, "leaves")
    total = leaves.agg(F.sum("supply")).first()[0] or 0.0
    keys: list[str] = []
    shared = None
    for level in LEVELS:
        given = [F.max(f"g_{level}").alias("w")] if level in weights else []
        nodes = leaves.groupBy(*keys, level).agg(F.sum("supply").alias("supply"), *given)
        weight = F.col("w") if given else F.pow("supply", F.lit(alpha))
        # Multiples of 2^-10 add up alike in any order.
        nodes = nodes.withColumn("w", F.greatest(F.round(weight * 1024), F.lit(1.0)) / 1024).withColumn(
            "cap", F.col("supply") * float(max_epochs))
        if shared is None:
            nodes = nodes.withColumn("__b", F.lit(total * total_share))
        else:
            cond = [nodes[k].eqNullSafe(shared[k]) for k in keys]
            nodes = nodes.join(shared, cond).select(*[nodes[c] for c in nodes.columns], shared["__b"])
        nodes = landed(_share(nodes, keys, "__b", "budget"), "nodes")
        keys = [*keys, level]
        shared = nodes.select(*keys, F.col("budget").alias("__b"))
    return nodes.select(*LEVELS, "supply", "w", "budget")


def mix(docs: DataFrame, seed: int = SEED, total_share: float = BUDGET_SHARE,
        max_epochs: int = MAX_EPOCHS, alpha: float = ALPHA, weights: dict[str, DataFrame] | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, epoch, __digest) per selected document copy.

    ``weights`` as in :func:`budgets`.
    """
    text = F.col("text")
    rows = landed(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), domain_of(F.col("source")).alias("domain"), "lang", "source",
        F.size(split_words(text, SPACE)).cast("long").alias("tokens"),
        F.md5(F.coalesce(text, F.lit(""))).alias("__digest")), "mix-rows")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply"))
    plan = landed(budgets(leaves, total_share, max_epochs, alpha, weights)
                  .withColumn("whole", F.floor(F.col("budget") / F.col("supply")).cast("int"))
                  .withColumn("rest", F.floor(F.col("budget") - F.col("whole") * F.col("supply")).cast("long"))
                  .select(*[F.col(c).alias(f"p_{c}") for c in LEVELS], "whole", "rest"), "mix-plan")
    match = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in LEVELS]
    planned = rows.join(plan, match).drop(*[f"p_{c}" for c in LEVELS])
    whole = planned.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("whole"))))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), (F.col("whole") + 1).cast("string"),
                            F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    keyed = landed(planned.where("rest > 0").withColumn("__key", key)
                   .withColumn("__bucket", F.substring("__key", 1, 3)), "mix-keys")
    upto = Window.partitionBy(*LEVELS).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = (keyed.groupBy(*LEVELS, "__bucket").agg(F.sum("tokens").alias("__n"))
            .withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0)))
            .select(*[F.col(c).alias(f"p_{c}") for c in LEVELS], F.col("__bucket").alias("p_bucket"), "__before"))
    inside = (Window.partitionBy(*LEVELS, "__bucket").orderBy("__key", "doc_id", "__digest")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    partial = (keyed.withColumn("__in", F.sum("tokens").over(inside))
               .join(sums, [*match, F.col("__bucket") == F.col("p_bucket")])
               .where(F.col("__before") + F.col("__in") <= F.col("rest"))
               .withColumn("epoch", F.col("whole") + 1))
    cols = ["doc_id", "domain", *LEVELS[1:], "tokens", "epoch", "__digest"]
    return whole.select(*cols).unionByName(partial.select(*cols))
