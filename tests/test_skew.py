"""A hot organisation holding a third of all rows: exact results, combined map-side."""

import random
from datetime import timedelta

from pyspark.sql import functions as F

from helpers import T0, raw_rows
from shiftlens.operators import classify, features, staging
from shiftlens.operators.prefix import global_prefix_sum

NAMES = ["Scheduling.Shift.Created", "Mobile.Schedule.Loaded", "PunchClock.PunchedIn", "Foo.Bar"]


def test_hot_org_rollup_exact_and_partial(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(9000):
        org = "hot" if i % 3 == 0 else f"o{rnd.randint(0, 400)}"
        rows.append((org, rnd.choice(NAMES), T0 + timedelta(minutes=rnd.randint(0, 60 * 24 * 29)), False, None))
    stg = staging.stg_trial_events(raw_rows(spark, rows))
    base = features.org_rollup(classify.classify_events(stg))
    hot = base.where(F.col("organization_id") == "hot").collect()[0]
    distinct_hot = {(o, a, t) for o, a, t, _, _ in rows if o == "hot"}
    assert hot.total_events == len(distinct_hot)
    assert hot.worker_events == sum(1 for _, a, _ in distinct_hot if a in NAMES[1:3])
    assert hot.active_days == len({t.date() for _, _, t in distinct_hot})
    plan = base._jdf.queryExecution().executedPlan().toString()
    assert "partial_" in plan  # map-side combine before the organisation shuffle


def test_prefix_sum_with_dominant_value(spark):
    rows = [(0.0, 1)] * 3000 + [(float(v), 1) for v in range(1, 6001)]
    df = spark.createDataFrame(rows, "v double, one long")
    got = {r.v: r.one_cum for r in global_prefix_sum(df, [], "v", ["one"], buckets=16).collect()}
    assert got[0.0] == 3000 and got[1.0] == 3001 and got[6000.0] == 9000
