"""Cross-validated forests: any session, any shuffle setting."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from shiftlens.llm import secrets
from shiftlens.operators import ml

SETS = (("one", ("a",)), ("two", ("a", "b")))


def orgs(spark, n=120):
    return spark.createDataFrame([(f"o{i:03d}", (i * 7919) % 11 > 4, float((i * 31) % 17), float((i * 7919) % 11 + i % 5))
                                  for i in range(n)], "organization_id string, converted boolean, a double, b double")


def aucs(spark, **kw):
    return sorted(map(tuple, ml.rf_cv_auc(orgs(spark), SETS, k=2, num_trees=5, max_depth=3, **kw).collect()))


def observed(spark):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).count()
    assert seen.get == {"n": 3}


def test_forests_fit_in_a_session_that_has_observed_metrics(spark):
    observed(spark)
    got = aucs(spark)
    assert [(r[0], r[1]) for r in got] == [("one", 2), ("two", 2)] and got[1][2] > 0.6


def test_forests_do_not_depend_on_the_shuffle_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for parts in ("8", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append(aucs(spark))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
    assert [ml.training_partitions(n) for n in (0, 9000, 400_000, 540_000)] == [8, 8, 8, 11]


def test_secret_forest_scores_in_a_session_that_has_observed_metrics(spark):
    observed(spark)
    rows = [(i, f'password = "a8Kq2ZxP9vLm{i}TwRb47"' if i % 2 else f'see "lowercaseletterswithoutanydigit{chr(97 + i % 26) * 3}"')
            for i in range(40)]
    out = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.is_secret for r in out} == {True, False}
