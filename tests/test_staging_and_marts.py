"""Inline-row cases for cleaning, classification, features and marts."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import T0, raw_rows, ts
from shiftlens.operators import classify, features, marts, staging
from shiftlens.sources import read_events

SHIFT = "Scheduling.Shift.Created"
MOBILE = "Mobile.Schedule.Loaded"
PUNCH = "PunchClock.PunchedIn"


def test_exact_duplicate_kept_once(spark):
    df = raw_rows(spark, [("o1", SHIFT, ts(1), False, None), ("o1", SHIFT, ts(1), False, None)])
    assert staging.dedup_events(df).count() == 1


def test_unknown_and_null_activity_are_shared(spark):
    df = raw_rows(spark, [("o1", "Foo.Bar", ts(1), False, None), ("o1", None, ts(2), False, None),
                          ("o1", MOBILE, ts(3), False, None), ("o1", SHIFT, ts(4), False, None)])
    sides = dict((r.activity_name, r.activity_type) for r in classify.classify_events(df).collect())
    assert sides["Foo.Bar"] == "shared" and sides[None] == "shared"
    assert sides[MOBILE] == "worker" and sides[SHIFT] == "admin"


def test_window_edges_kept_and_outside_dropped(spark):
    end = T0 + timedelta(days=30)
    df = raw_rows(spark, [("o1", SHIFT, T0, False, None), ("o1", SHIFT, end, False, None),
                          ("o1", SHIFT, T0 - timedelta(seconds=1), False, None),
                          ("o1", SHIFT, end + timedelta(seconds=1), False, None)])
    stg = staging.stg_trial_events(df).collect()
    assert sorted(r.event_timestamp for r in stg) == [T0, end]
    assert sorted(r.trial_day_number for r in stg) == [1, 31]


def _org(spark, rows):
    stg = staging.stg_trial_events(raw_rows(spark, rows))
    return {r.organization_id: r for r in features.org_features(classify.classify_events(stg)).collect()}, \
        {r.organization_id: r for r in marts.mart_worker_adoption(stg).collect()}


def test_worker_only_and_shared_only_are_minimal(spark):
    f, m = _org(spark, [("w", MOBILE, ts(1), False, None), ("w", PUNCH, ts(2), False, None),
                        ("w", MOBILE, ts(3), False, None), ("s", "Foo.Bar", ts(1), False, None)])
    assert f["w"].archetype == "Minimal / No Engagement" and f["w"].has_any_worker_activity == 1
    assert f["w"].is_worker_only is True
    assert m["w"].adoption_archetype == "Minimal / No Engagement" and m["w"].has_any_worker_activity is True
    assert f["s"].archetype == "Minimal / No Engagement" and f["s"].worker_event_share == 0.0
    assert m["s"].worker_event_share == 0.0


def test_hour_boundary_gap(spark):
    f, m = _org(spark, [("o", SHIFT, ts(0, 59), False, None), ("o", MOBILE, ts(1, 1), False, None)])
    assert m["o"].handoff_gap_hours == 1
    from shiftlens.operators.distributions import handoff_frame
    org = features.org_features(classify.classify_events(staging.stg_trial_events(raw_rows(
        spark, [("o", SHIFT, ts(0, 59), False, None), ("o", MOBILE, ts(1, 1), False, None)]))))
    gap = handoff_frame(org).collect()[0].handoff_gap_hrs
    assert gap == pytest.approx(2 / 60)


def test_worker_before_admin_negative_mart_gap_clipped_feature(spark):
    rows = [("o", SHIFT, ts(5), False, None), ("o", MOBILE, ts(3), False, None)]
    f, m = _org(spark, rows)
    assert m["o"].handoff_gap_hours == -2
    from shiftlens.operators.distributions import handoff_frame
    org = features.org_features(classify.classify_events(staging.stg_trial_events(raw_rows(spark, rows))))
    assert handoff_frame(org).collect()[0].handoff_gap_hrs == 0.0


def test_one_side_missing_gap_null(spark):
    f, m = _org(spark, [("o", SHIFT, ts(5), False, None)])
    assert m["o"].handoff_gap_hours is None and f["o"].hours_to_first_worker is None


def test_mart_flags_and_depth(spark):
    rows = [("o", SHIFT, ts(1), False, None), ("o", MOBILE, ts(2), False, None),
            ("o", PUNCH, ts(3), False, None), ("o", "Scheduling.Availability.Set", ts(4), False, None)]
    f, m = _org(spark, rows)
    r = m["o"]
    assert r.worker_depth_score == 3 == f["o"].worker_depth_score
    assert r.flag_deep_worker_not_converted is True and r.flag_no_punchclock_not_converted is False
    assert r.worker_event_share == 0.75


def test_joined_form_equals_single_pass(spark):
    from shiftlens.plans.catalog import classified
    c = classified(spark, "/root/testdata/sf0.001")
    a = features.org_features(c)
    b = features.org_features_joined(c)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_properties_on_sf0001(spark):
    from shiftlens.plans.catalog import classified
    c = classified(spark, "/root/testdata/sf0.001")
    org = features.org_features(c)
    bad = org.where((F.col("admin_events") + F.col("worker_events") > F.col("total_events"))
                    | (F.col("worker_depth_score") != F.col("has_punchclock") + F.col("has_availability")
                       + F.col("has_shift_swap") + F.col("has_absence_request") + F.col("has_mobile_view")))
    assert bad.count() == 0
    sides = {r.activity_type: r.event_count for r in classify.events_by_side(c).collect()}
    assert sum(sides.values()) == c.count()


def test_staging_idempotent(spark):
    from shiftlens.plans.catalog import raw_trial_events
    raw = raw_trial_events(spark, "/root/testdata/sf0.001")
    once = staging.stg_trial_events(raw)
    twice = staging.stg_trial_events(once.select(*staging.RAW_COLUMNS))
    assert once.exceptAll(twice).count() == 0 and twice.count() == once.count()


def test_dq_summary_counts_bad_timestamps(spark, tmp_path):
    p = tmp_path / "log.csv"
    p.write_text(
        "Organization_ID,Activity_Name,TIMESTAMP,Converted,Converted_At,Trial_Start,Trial_End\n"
        "o1,Scheduling.Shift.Created,2024-01-02 10:00:00,false,,2024-01-01 00:00:00,2024-01-31 00:00:00\n"
        "o1,Scheduling.Shift.Created,2024-01-02 10:00:00,false,,2024-01-01 00:00:00,2024-01-31 00:00:00\n"
        "o1,Mobile.Schedule.Loaded,not a date,false,,2024-01-01 00:00:00,2024-01-31 00:00:00\n")
    raw = read_events(spark, str(p))
    assert raw.columns[2] == "event_timestamp"
    dq = staging.dq_summary(raw).collect()[0]
    assert dq.raw_rows == 3 and dq.distinct_rows == 2 and dq.null_event_timestamps == 1
    assert dq.staged_rows == 1


def test_goals_and_activation(spark):
    rows = [("o", SHIFT, ts(1), True, ts(100)), ("o", MOBILE, ts(30), True, ts(100)),
            ("o", "Scheduling.Availability.Set", ts(60), True, ts(100))]
    stg = staging.stg_trial_events(raw_rows(spark, rows))
    g = marts.mart_trial_goals(stg).collect()[0]
    assert (g.goal_shift_created, g.goal_mobile_viewed, g.goal_availability_set,
            g.goal_active_days, g.goal_activity_types) == (1, 1, 1, 1, 1)
    a = marts.mart_trial_activation(marts.mart_trial_goals(stg)).collect()[0]
    assert a.activation_tier == "Fully Activated" and a.is_activated_churned is False


def test_nudge_batch(spark):
    rows = [("late", SHIFT, ts(1), False, None), ("late", MOBILE, ts(50), False, None),
            ("quick", SHIFT, ts(1), False, None), ("quick", MOBILE, ts(48), False, None),
            ("none", SHIFT, ts(1), False, None)]
    out = {r.organization_id for r in marts.onboarding_nudge(staging.stg_trial_events(raw_rows(spark, rows))).collect()}
    assert out == {"late", "none"}


def test_write_mart_roundtrip(spark, tmp_path):
    from shiftlens.plans.catalog import stg
    from shiftlens.sources import write_mart
    mart = marts.mart_worker_adoption(stg(spark, "/root/testdata/sf0.001"), ordered=False)
    path = write_mart(mart, str(tmp_path / "mart"), sort_within=["organization_id"])
    back = spark.read.parquet(path)
    assert back.count() == mart.count() and back.exceptAll(mart).count() == 0


def test_funnel_stage_after_zero_has_null_drop_off(spark):
    from shiftlens.operators import reports
    # No organisation created a shift, mobile-viewed or punched: stages 2, 3 and 5 are 0.
    rows = [("o1", "Absence.Request.Created", ts(1), False, None),
            ("o2", "Timesheets.BulkApprove.Confirmed", ts(1), True, ts(5))]
    stg = staging.stg_trial_events(raw_rows(spark, rows))
    f = features.derive_features(features.org_rollup(classify.classify_events(stg)), keep=("shift_created_events",))
    out = {r.stage_no: r for r in reports.adoption_funnel(f).collect()}
    assert out[2]["count"] == 0 and out[3]["count"] == 0
    assert out[3].drop_off is None and out[4].drop_off is None
    assert out[6].drop_off is None and out[1].drop_off == 0.0


def test_read_events_by_header_name(spark, tmp_path):
    """Column order, header case and extra columns of a CSV do not matter."""
    from shiftlens.sources import read_events
    (tmp_path / "log.csv").write_text(
        "Extra,Converted,TIMESTAMP,Activity_Name,trial_end,Organization_Id,converted_at,trial_start\n"
        "x,True,2024-01-02 03:04:05,Foo.Bar,2024-01-31 00:00:00,o1,,2024-01-01 00:00:00\n"
        "y,maybe,not a date,Foo.Baz,2024-01-31 00:00:00,o2,,2024-01-01 00:00:00\n")
    rows = {r.organization_id: r for r in read_events(spark, str(tmp_path / "log.csv")).collect()}
    assert rows["o1"].activity_name == "Foo.Bar" and rows["o1"].converted is True
    assert str(rows["o1"].event_timestamp) == "2024-01-02 03:04:05"
    assert rows["o2"].converted is None and rows["o2"].event_timestamp is None
    assert "extra" not in rows["o1"].asDict()
