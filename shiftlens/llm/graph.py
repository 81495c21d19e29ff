"""Connected components over tables landed after every round.

Labels fall to the smallest node by neighbour minima and pointer jumping.  Both
joins go through :func:`join_groups`, so a hub or a root that a third of all
rows name is broadcast and its rows never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, join_groups, landed


def components(edges: DataFrame) -> DataFrame:
    """(node, root, degree) of every node of undirected long edges (a, b); root is the smallest node reachable."""
    both = landed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .distinct(), "edges")
    label = landed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree"))
                   .select("node", F.least("node", "m").alias("root"), "degree"), "labels")
    while True:
        near = (join_groups(both, label.select(F.col("node").alias("b"), "root", "degree"), "b", "degree")
                .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m")))
        step = landed(label.join(near, "node").select("node", F.least("root", "m").alias("root"), "degree",
                                                      (F.col("m") < F.col("root")).alias("moved")), "labels")
        if not step.where("moved").limit(1).count():
            dropped(both, step)
            return label
        dropped(label)
        label = _jump(step.drop("moved"))
        dropped(step)


def _jump(label: DataFrame) -> DataFrame:
    """Every node takes its root's root."""
    named = label.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    roots = landed(named.join(label.select(F.col("node").alias("root"), F.col("root").alias("next")), "root"), "roots")
    after = landed(join_groups(label, roots, "root", "members").select("node", F.col("next").alias("root"), "degree"),
                   "jumped")
    dropped(roots)
    return after
