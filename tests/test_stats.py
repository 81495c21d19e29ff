"""Quantiles, histograms, tests and survival against hand-computed answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from shiftlens.operators.distributions import histogram
from shiftlens.operators.prefix import exact_quantiles, global_prefix_sum
from shiftlens.operators.stats import chi_square_2x2, mann_whitney, roc_auc
from shiftlens.operators.survival import kaplan_meier


def test_percentiles_linear(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0)], "x double")
    q = {r.prob: r.quantile for r in exact_quantiles(df, [], "x", [0.25, 0.5, 0.75, 0.95]).collect()}
    assert q[0.25] == pytest.approx(1.75) and q[0.5] == pytest.approx(2.5)
    assert q[0.75] == pytest.approx(4.75) and q[0.95] == pytest.approx(8.95)


def test_prefix_sum_matches_brute_force(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice("ab"), float(rnd.randint(0, 40)), rnd.randint(1, 5)) for _ in range(2000)]
    rows += [("a", 7.0, 1)] * 700  # a hot value holding a quarter of the rows
    df = spark.createDataFrame(rows, "g string, v double, w long")
    got = {(r.g, r.v): r.w_cum for r in global_prefix_sum(df, ["g"], "v", ["w"], buckets=6).collect()}
    want = {}
    for g in "ab":
        acc = 0
        for v in sorted({r[1] for r in rows if r[0] == g}):
            acc += sum(r[2] for r in rows if r[0] == g and r[1] == v)
            want[(g, v)] = acc
    assert got == want


def test_prefix_sum_string_keys(spark):
    keys = [f"org_{i}" for i in range(300)]
    df = spark.createDataFrame([(k, 1) for k in keys], "k string, one long")
    got = {r.k: r.one_cum for r in global_prefix_sum(df, [], "k", ["one"], buckets=5).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}


def test_histogram_top_edge_and_totals(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (10.0,)], "x double")
    h = {r.bin: r.n for r in histogram(df, "x", 5, lo=0.0, hi=10.0).collect()}
    assert h[4] == 2 and sum(h.values()) == 4 and len(h) == 5


def test_chi_square_yates(spark):
    rows = ([(1, True)] * 30 + [(1, False)] * 10 + [(0, True)] * 20 + [(0, False)] * 20)
    df = spark.createDataFrame(rows, "f int, converted boolean")
    r = chi_square_2x2(df, "f").collect()[0]
    assert r.chi2 == pytest.approx(4.32, abs=1e-9) and r.p_value == pytest.approx(0.0377, abs=1e-4)


def test_chi_square_single_outcome(spark):
    df = spark.createDataFrame([(1, False), (0, False)], "f int, converted boolean")
    r = chi_square_2x2(df, "f").collect()[0]
    assert r.p_value == 1.0 and r.chi2 is None


def test_mann_whitney_properties(spark):
    rnd = random.Random(3)
    rows = [("m", float(rnd.randint(0, 20)), rnd.random() < 0.4) for _ in range(400)]
    df = spark.createDataFrame(rows, "metric string, value double, converted boolean")
    r = mann_whitney(df, ["metric"], "value").collect()[0]
    x = [v for _, v, c in rows if c]
    y = [v for _, v, c in rows if not c]
    u = sum((xi > yi) + 0.5 * (xi == yi) for xi in x for yi in y)
    assert r.u_stat == pytest.approx(u)
    assert 0 <= r.p_value <= 1


def test_auc_symmetry(spark):
    rnd = random.Random(5)
    rows = [(rnd.random(), rnd.random() < 0.5) for _ in range(300)]
    df = spark.createDataFrame(rows, "s double, y boolean").withColumn("g", F.lit("x"))
    a = roc_auc(df, ["g"], "s", "y").collect()[0].auc
    b = roc_auc(df.withColumn("s", -F.col("s")), ["g"], "s", "y").collect()[0].auc
    assert a + b == pytest.approx(1.0)


def test_kaplan_meier_censored_and_extinct(spark):
    rows = [("all_censored", 30.0, 0)] * 3 + [("dies", 1.0, 1), ("dies", 2.0, 1), ("dies", 2.0, 0), ("dies", 3.0, 1)]
    km = kaplan_meier(spark.createDataFrame(rows, "group string, duration double, event int"))
    got = {(r.group, r.time): r for r in km.collect()}
    assert all(r.survival == 1.0 for (g, _), r in got.items() if g == "all_censored")
    assert got[("dies", 1.0)].survival == pytest.approx(0.75)
    assert got[("dies", 2.0)].survival == pytest.approx(0.75 * 2 / 3)
    assert got[("dies", 3.0)].survival == 0.0 and got[("dies", 3.0)].ci_lower is None
    s = [got[("dies", t)].survival for t in (0.0, 1.0, 2.0, 3.0)]
    assert s == sorted(s, reverse=True)
    # log-log bounds for S = 0.75 at n = 4, d = 1 (hand-computed)
    assert math.isclose(got[("dies", 1.0)].ci_lower, 0.12795, abs_tol=1e-4)
    assert math.isclose(got[("dies", 1.0)].ci_upper, 0.96055, abs_tol=1e-4)


def test_funnel_nested_is_monotone(spark):
    from shiftlens.operators import features, reports
    from shiftlens.plans.catalog import rollup
    f = features.derive_features(rollup(spark, "/root/testdata/sf0.001"), keep=("shift_created_events",))
    counts = [r["count"] for r in reports.adoption_funnel(f, nested=True).orderBy("stage_no").collect()]
    assert counts == sorted(counts, reverse=True)
    free = {r.stage_no: r["count"] for r in reports.adoption_funnel(f).collect()}
    assert free[1] == counts[0] and all(free[i + 1] >= c for i, c in enumerate(counts))


def test_null_outcome_excluded_from_ranks(spark):
    rows = [("m", 1.0, True), ("m", 2.0, False), ("m", 3.0, None), ("m", 4.0, True)]
    df = spark.createDataFrame(rows, "metric string, value double, converted boolean")
    r = mann_whitney(df, ["metric"], "value").collect()[0]
    assert (r.n_converted, r.n_not_converted) == (2, 1)
    assert r.u_stat == pytest.approx(1.0)


def test_prefix_sum_many_groups(spark):
    """The same path serves thousands of groups."""
    df = spark.range(60_000).selectExpr("id % 6000 as g", "cast(id as double) as v", "1L as w")
    got = global_prefix_sum(df, ["g"], "v", ["w"])
    assert got.count() == 60_000
    assert got.where("w_cum != floor(v / 6000) + 1").count() == 0


def test_prefix_sum_keeps_null_group(spark):
    df = spark.createDataFrame([(None, 1.0, 2), (None, 3.0, 5), ("a", 2.0, 7)], "g string, v double, w long")
    got = {(r.g, r.v): r.w_cum for r in global_prefix_sum(df, ["g"], "v", ["w"]).collect()}
    assert got == {(None, 1.0): 2, (None, 3.0): 7, ("a", 2.0): 7}


def test_null_outcome_is_a_group_of_its_own(spark):
    from shiftlens.operators.distributions import boxplot_stats, describe_by
    from shiftlens.operators.ml import stratified_folds
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (True, 5.0), (True, None)], "converted boolean, x double")
    hist = {}
    for r in histogram(df, "x", 2, by=["converted"]).collect():
        hist.setdefault(r.converted, []).append(r.n)
    assert {k: sum(v) for k, v in hist.items()} == {None: 2, True: 1}
    assert {k: len(v) for k, v in hist.items()} == {None: 2, True: 2}
    described = {r.converted: (r.n, r.median) for r in describe_by(df, ["converted"], "x", {"median": 0.5}).collect()}
    assert described == {None: (2, 2.0), True: (1, 5.0)}
    boxes = {r.converted: (r.n, r.median) for r in boxplot_stats(df, [("x", "x")]).collect()}
    assert boxes == {None: (2, 2.0), True: (1, 5.0)}
    orgs = spark.createDataFrame([("a", None), ("b", None), ("c", True)], "organization_id string, y boolean")
    folds = {r.organization_id: r.fold for r in stratified_folds(orgs, "y", k=2).collect()}
    assert folds == {"a": 0, "b": 1, "c": 0}


def test_quantiles_of_empty_frame(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert exact_quantiles(df, ["g"], "x", [0.5]).collect() == []
    assert histogram(df, "x", 3, by=["g"]).collect() == []


def test_describe_by_approximate_path(spark):
    from shiftlens.operators.distributions import describe_by
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 101)], "g string, x double")
    exact = describe_by(df, ["g"], "x", {"median": 0.5}, exact=True).collect()[0]
    approx = describe_by(df, ["g"], "x", {"median": 0.5}, exact=False).collect()[0]
    assert exact.median == pytest.approx(50.5) and exact.n == approx.n == 100
    assert abs(approx.median - exact.median) <= 1.0


def test_erfc_to_double_precision(spark):
    import math
    from shiftlens.functions.columns import erfc
    xs = [i / 50 for i in range(-300, 1301)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erfc("x").alias("e")).collect()
    assert max(abs(r.e - math.erfc(r.x)) for r in got) < 1e-13
    assert max(abs(r.e / math.erfc(r.x) - 1) for r in got if r.x < 25) < 1e-11


def test_oracle_erfc_is_an_expansion_of_its_own():
    import math
    import duckdb
    from shiftlens.plans.oracle_base import erfc_sql
    for x in (-2.5, -0.3, 0.0, 0.7, 1.9, 2.1, 5.0):
        assert abs(duckdb.sql(f"SELECT {erfc_sql(f"({x})")}").fetchall()[0][0] - math.erfc(x)) < 1e-11
