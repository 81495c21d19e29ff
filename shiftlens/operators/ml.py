"""Feature sets, stratified folds and cross-validated random forests (MLlib)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.columns import r6
from shiftlens.operators.prefix import global_prefix_sum, null_safe_join
from shiftlens.operators.stats import roc_auc
from shiftlens.session import landed_copy
from shiftlens.spec import FEATURE_SETS

MIN_PARTITIONS = 8          # of a training table
ROWS_A_PARTITION = 50_000   # of a training table, at most


def feature_sets(org: DataFrame, sets=FEATURE_SETS) -> DataFrame:
    """Each organisation's assembled feature vectors, in long form.

    The vectors come from ``VectorAssembler`` (nulls -> 0 as the model input
    does); one row per organisation, set and feature position.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    parts = []
    for name, cols in sets:
        filled = org.select("organization_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
        vec = VectorAssembler(inputCols=list(cols), outputCol="features").transform(filled)
        names = F.array(*[F.lit(c) for c in cols])
        parts.append(vec.select("organization_id", F.lit(name).alias("feature_set"),
                                F.posexplode(vector_to_array("features")).alias("feature_index", "value"))
                     .withColumn("feature_name", F.element_at(names, F.col("feature_index") + 1)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("organization_id", "feature_set", F.col("feature_index").cast("int").alias("feature_index"),
                      "feature_name", "value")


def stratified_folds(df: DataFrame, label: str, key: str = "organization_id", k: int = 5) -> DataFrame:
    """``fold = ntile(k) - 1`` within each label class, ordered by ``key``.

    The position of a row inside its class is a distributed running count, so
    neither class is sorted in a single task.  Rows with a null label form a
    class of their own.
    """
    base = df.select(key, F.col(label).cast("int").alias("label"), F.lit(1).cast("bigint").alias("__one"))
    pos = global_prefix_sum(base, ["label"], key, ["__one"])
    sizes = base.groupBy("label").agg(F.count(F.lit(1)).alias("__n"))
    r = F.col("__one_cum")
    n = F.col("__n")
    q = (n / F.lit(k)).cast("bigint")
    rem = n % F.lit(k)
    big = rem * (q + 1)
    bucket = (F.when(r <= big, ((r - 1) / (q + 1)).cast("bigint"))
              .otherwise(F.when(q > 0, rem + ((r - big - 1) / q).cast("bigint"))))
    # One row per label value: adaptive execution sizes (and broadcasts) this join.
    return null_safe_join(pos, sizes, ["label"]).select(key, "label", bucket.cast("int").alias("fold"))


def _fit_fold(train: DataFrame, test: DataFrame, cols, num_trees: int, max_depth: int, seed: int) -> DataFrame:
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    assembler = VectorAssembler(inputCols=list(cols), outputCol="features")
    # Balanced class weights computed on the training fold: n / (2 * n_class).
    counts = train.groupBy("label").agg(F.count(F.lit(1)).alias("__c"))
    total = train.agg(F.count(F.lit(1)).alias("__t"))
    weights = counts.crossJoin(total).select("label", (F.col("__t") / (F.lit(2.0) * F.col("__c"))).alias("w"))
    tr = assembler.transform(train.join(F.broadcast(weights), "label"))
    rf = RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth, seed=seed, weightCol="w",
                                labelCol="label", featuresCol="features")
    # The copy leaves the training summary behind: that one holds the session, which tasks cannot
    # take along once any query of the session has observed metrics.
    model = rf.fit(tr).copy()
    scored = model.transform(assembler.transform(test))
    return scored.select("organization_id", "label", vector_to_array("probability")[1].alias("score"))


def training_partitions(rows: int) -> int:
    """Partitions of a training table, from its rows alone.

    In every pass over a level each partition of a forest's input builds and sends the
    histograms of all open nodes of all trees, however few rows it holds: work and shuffle
    of a fit grow with partitions times nodes.
    """
    return max(MIN_PARTITIONS, -(-rows // ROWS_A_PARTITION))


def rf_cv_auc(org: DataFrame, sets=FEATURE_SETS, k: int = 5, num_trees: int = 100, max_depth: int = 10,
              seed: int = 42, parallelism: int = 8, train_partitions: int | None = None) -> DataFrame:
    """Mean and population sd of the out-of-fold ROC-AUC per feature set.

    Folds are stratified (:func:`stratified_folds`); each of ``k x sets`` fits
    is an MLlib job, submitted ``parallelism`` at a time.  AUC is exact (rank
    based) on the held-out probabilities.
    """
    all_cols = sorted({c for _, cols in sets for c in cols})
    data = org.where(F.col("converted").isNotNull()).select(
        "organization_id", F.col("converted").cast("int").alias("label"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in all_cols])
    folds = stratified_folds(data, "label", "organization_id", k)
    # One reliable checkpoint of the (organisation-sized) training table: every
    # fit reads it instead of re-running the event roll-up, and a lost
    # executor re-reads it from the shared folder.
    # Bagging depends on row order and partition count: the order is fixed by the key, the count by the number of rows.
    train_partitions = train_partitions or training_partitions(data.count())
    data = _materialise(data.join(folds.select("organization_id", "fold"), "organization_id")
                        .repartition(train_partitions, "organization_id").sortWithinPartitions("organization_id"))
    jobs = [(name, cols, f) for name, cols in sets for f in range(k)]

    def run(job):
        name, cols, f = job
        scored = _fit_fold(data.where(F.col("fold") != f), data.where(F.col("fold") == f), cols,
                           num_trees, max_depth, seed)
        # Scored and landed here: a task carries the one model it scores with, not those of all fits.
        return landed_copy(scored.select(F.lit(name).alias("feature_set"), F.lit(f).alias("fold"), "label", "score"),
                           "fold-scores")

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        scored = list(pool.map(run, jobs))
    preds = scored[0]
    for s in scored[1:]:
        preds = preds.unionByName(s)
    aucs = roc_auc(preds.withColumn("label", F.col("label") == 1), ["feature_set", "fold"], "score", "label")
    result = aucs.groupBy("feature_set").agg(
        F.count(F.lit(1)).alias("n_folds"), r6(F.avg("auc")).alias("mean_auc"),
        r6(F.stddev_pop("auc")).alias("std_auc"))
    result = result.select("feature_set", "n_folds", "mean_auc", "std_auc",
                           F.lit(num_trees).alias("num_trees"), F.lit(max_depth).alias("max_depth"))
    return _materialise(result)


def _materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared checkpoint folder."""
    from shiftlens.session import checkpoint_root

    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
