"""Streams against their batch definitions on inline rows."""

from datetime import timedelta

from pyspark.sql import functions as F

from helpers import T0, raw_rows, ts
from shiftlens.operators import marts, staging
from shiftlens.operators.distributions import bucketize_ranges
from shiftlens.spec import HANDOFF_BUCKETS
from shiftlens.streaming import streams

SHIFT = "Scheduling.Shift.Created"
MOBILE = "Mobile.Schedule.Loaded"


def _run(spark, df, fn, name):
    path, schema = streams.write_source(df, name)
    return streams.run_to_table(fn(streams.file_stream(spark, path, schema)), name)


def test_stream_nudge_matches_batch_once_closed(spark):
    rows = [("late", SHIFT, ts(1), False, None), ("late", MOBILE, ts(50), False, None),
            ("quick", SHIFT, ts(1), False, None), ("quick", MOBILE, ts(48), False, None),
            ("none", SHIFT, ts(1), False, None),
            # a later event moves the watermark past every deadline above
            ("clock", "Foo.Bar", ts(24 * 10), False, None), ("clock", MOBILE, ts(24 * 10), False, None),
            ("clock", SHIFT, ts(24 * 10), False, None)]
    stg = staging.stg_trial_events(raw_rows(spark, rows)).select(*staging.RAW_COLUMNS)
    out = _run(spark, stg, lambda s: streams.stream_onboarding_nudge(s, watermark="1 hour"), "t-nudge")
    assert {r.organization_id for r in out.collect()} == {"late", "none"}
    batch = {r.organization_id for r in marts.onboarding_nudge(stg).collect()}
    assert batch == {"late", "none"}


def test_stream_activity_by_day_closed_days(spark):
    rows = [("o", SHIFT, ts(1), False, None), ("o", SHIFT, ts(2), False, None), ("o", MOBILE, ts(3), False, None),
            ("o", SHIFT, ts(30), False, None), ("o", SHIFT, ts(24 * 5), False, None)]
    stg = staging.stg_trial_events(raw_rows(spark, rows)).select(*staging.RAW_COLUMNS)
    out = _run(spark, stg, lambda s: streams.stream_activity_by_day(s, "1 hour"), "t-activity")
    got = {(r.day_start, r.activity_type): r.n_events for r in out.collect()}
    assert got == {(T0, "admin"): 2, (T0, "worker"): 1, (T0 + timedelta(days=1), "admin"): 1}


def test_bucketize_ranges_closed_open(spark):
    df = spark.createDataFrame([(0.0,), (23.99,), (24.0,), (168.0,), (9999.0,)], "g double")
    got = sorted((r.g, r.bucket_no) for r in bucketize_ranges(df, "g", HANDOFF_BUCKETS).collect())
    assert got == [(0.0, 1), (23.99, 1), (24.0, 2), (168.0, 4)]


def test_expired_stream_limit_raises(spark, tmp_path):
    import time

    import pytest
    from pyspark.sql import functions as F

    from shiftlens.streaming.streams import file_stream, run_to_table

    spark.range(20).write.parquet(str(tmp_path / "in"))

    @F.udf("long")
    def slow(x):
        time.sleep(1)
        return x

    stream = file_stream(spark, str(tmp_path / "in"), "id long").select(slow("id").alias("id"))
    with pytest.raises(TimeoutError):
        run_to_table(stream, "slow", timeout_s=1)
