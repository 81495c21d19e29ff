"""Streams over several micro-batches: moving watermarks, restarts, chained state and the nudge sink."""

from helpers import raw_rows, ts
from shiftlens.operators import classify, staging
from shiftlens.plans import catalog
from shiftlens.session import scratch_path
from shiftlens.streaming import batches, streams

SMALL = "/root/testdata/sf0.001"
SHIFT = "Scheduling.Shift.Created"
MOBILE = "Mobile.Schedule.Loaded"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def staged(spark):
    return catalog.stg(spark, SMALL).select(*staging.RAW_COLUMNS)


def closed_days(classified, end):
    daily = (classified.groupBy("organization_id", "activity_type", classified["event_timestamp"].cast("date").alias("d"))
             .count().collect())
    return sorted((r.organization_id, r.activity_type, str(r.d), r["count"]) for r in daily if str(r.d) < str(end.date()))


def test_several_batches_a_stop_and_a_restart_equal_the_batch_answer(spark):
    path, schema = batches.land_in_order(staged(spark), "event_timestamp", 4, "t")
    sdf = streams.stream_activity_by_day(batches.ordered_stream(spark, path, schema))
    folder = scratch_path(spark, "t-run")
    first = batches.run_batches(sdf, folder, stop_after=2)
    again = batches.run_batches(sdf, folder)
    assert again.ended
    seen = [r for run in (first, again) for r in run.batches.collect()]
    marks = [r.watermark for r in seen if r.input_rows]
    assert len({r.batch_id for r in seen if r.input_rows}) >= 3 and marks == sorted(marks) and len(set(marks)) >= 3
    assert sum(r.late_rows for r in seen) == 0
    whole = streams.run_to_table(streams.stream_activity_by_day(streams.file_stream(spark, path, schema)), "t-whole")
    assert rows_of(again.table) == rows_of(whole)
    assert rows_of(batches.run_batches(sdf, folder).table) == rows_of(whole)  # nothing new: nothing changes


def test_later_files_go_on_from_the_checkpoint_and_late_rows_are_counted(spark, tmp_path):
    def add(rows):
        raw_rows(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    add([("o", SHIFT, ts(1), False, None)])
    schema = raw_rows(spark, []).schema
    sdf = streams.stream_activity_by_day(batches.ordered_stream(spark, str(tmp_path / "in"), schema))
    folder = scratch_path(spark, "t-late")
    assert batches.run_batches(sdf, folder).table.count() == 0
    add([("o", SHIFT, ts(2), False, None), ("o", SHIFT, ts(24 * 3), False, None)])
    assert [r.n_events for r in batches.run_batches(sdf, folder).table.collect()] == [2]
    add([("o", SHIFT, ts(3), False, None), ("o", SHIFT, ts(24 * 6), False, None)])  # ts(3) is behind the watermark
    run = batches.run_batches(sdf, folder)
    assert sum(r.late_rows for r in run.batches.collect()) >= 1
    assert sorted((str(r.day_start)[:10], r.n_events) for r in run.table.collect()) == [("2024-01-01", 2), ("2024-01-04", 1)]


def test_chained_state_on_the_raw_stream_equals_the_batch_rollup(spark):
    raw = catalog.raw(spark, SMALL)
    path, schema = batches.land_in_order(raw, "event_timestamp", 3, "t-raw")
    run = batches.run_batches(batches.activity_from_raw(batches.ordered_stream(spark, path, schema)),
                              scratch_path(spark, "t-chain"))
    end = raw.agg({"event_timestamp": "max"}).first()[0]
    got = sorted((r.organization_id, r.activity_type, str(r.day_start)[:10], r.n_events) for r in run.table.collect())
    assert got == closed_days(classify.classify_events(staging.stg_trial_events(raw)), end)
    assert sum(r.input_rows for r in run.batches.collect()) == raw.count() > staged(spark).count()


def test_replayed_batches_nudge_nobody_twice(spark):
    kind = "organization_id string, shift_ts timestamp_ntz, nudge_due_at timestamp_ntz"
    sink = batches.NudgeSink(spark, scratch_path(spark, "t-sink"))
    one = spark.createDataFrame([("a", ts(2), ts(50)), ("a", ts(1), ts(49)), ("b", ts(3), ts(51)), (None, ts(3), ts(51))], kind)
    two = spark.createDataFrame([("a", ts(5), ts(53)), ("c", ts(6), ts(54)), (None, ts(9), ts(57))], kind)
    for frame, batch in ((one, 0), (two, 1), (one, 0), (two, 1), (two, 2)):
        sink(frame, batch)
        if batch == 0:
            assert {r.organization_id for r in sink.nudges().where("batch_id = 0").collect()} == {"a", "b", None}
    got = {(r.organization_id, r.first_unanswered_shift_at, r.batch_id) for r in sink.nudges().collect()}
    assert got == {("a", ts(1), 0), ("b", ts(3), 0), (None, ts(3), 0), ("c", ts(6), 1)}
    assert {(r.batch_id, r.received, r.nudged) for r in sink.ledger().where("batch_id >= 0").collect()} == {
        (0, 4, 3), (1, 1, 1), (2, 0, 0)}


def test_uncommitted_batch_is_not_read_and_its_replay_is(spark):
    sink = batches.NudgeSink(spark, scratch_path(spark, "t-crash"))
    row = spark.createDataFrame([("a", ts(1), ts(49), 1)], batches.NUDGE)
    row.write.parquet(f"{sink.folder}/nudges/batch_id=0")  # the run died before its ledger entry
    assert sink.nudges().count() == 0
    sink(spark.createDataFrame([("b", ts(1), ts(49))], "organization_id string, shift_ts timestamp_ntz, nudge_due_at timestamp_ntz"), 0)
    assert [r.organization_id for r in sink.nudges().collect()] == ["b"]


def test_nudge_stream_through_the_sink_equals_the_batch_nudges(spark):
    rows = [(o, SHIFT, ts(1 + i), False, None) for i, o in enumerate("abc")] + [("a", SHIFT, ts(70), False, None)]
    rows += [("b", MOBILE, ts(20), False, None)]
    rows += [("clock", name, ts(24 * d), False, None) for d in range(1, 12) for name in (SHIFT, MOBILE)]
    path, schema = batches.land_in_order(raw_rows(spark, rows), "event_timestamp", 5, "t-nudge")
    sdf = streams.stream_onboarding_nudge(batches.ordered_stream(spark, path, schema))
    folder, sink = scratch_path(spark, "t-nudges"), batches.NudgeSink(spark, scratch_path(spark, "t-nudge-sink"))
    batches.run_batches(sdf, folder, sink, stop_after=2)
    assert batches.run_batches(sdf, folder, sink).ended
    got = sorted((r.organization_id, r.first_unanswered_shift_at) for r in sink.nudges().collect())
    assert got == [("a", ts(1)), ("c", ts(3))]


def test_a_slice_of_many_files_is_one_micro_batch(spark):
    # Four times, one of them held by two rows only: three files a slice take an empty one.
    rows = [(f"o{i}", SHIFT, ts(24 * day), False, None) for day, n in ((1, 40), (2, 40), (4, 2), (9, 40)) for i in range(n)]
    path, schema = batches.land_in_order(raw_rows(spark, rows), "event_timestamp", 3, "t-files", 5)
    sizes = [spark.read.schema(schema).parquet(f).count() for f in spark.read.schema(schema).parquet(path).inputFiles()]
    assert sum(sizes) == len(rows) and sum(n > 0 for n in sizes) > 4
    sdf = streams.stream_activity_by_day(batches.ordered_stream(spark, path, schema, 5))
    run = batches.run_batches(sdf, scratch_path(spark, "t-files-run"))
    seen = [r for r in run.batches.collect() if r.input_rows]
    assert sum(r.input_rows for r in seen) == len(rows) and sum(r.late_rows for r in seen) == 0 and len(seen) >= 2
    assert sum(r.n_events for r in run.table.collect()) == 82  # the last day is not closed
    assert [batches.files_a_slice(n, 4) for n in (0, 400_000, 400_001, 10 ** 10)] == [1, 1, 2, batches.MAX_FILES]


def test_slices_without_enough_rows_are_filled_up_with_empty_files(spark):
    rows = [("o", SHIFT, ts(24 * day), False, None) for day in range(1, 9)]
    path, schema = batches.land_in_order(raw_rows(spark, rows), "event_timestamp", 4, "t-empty", 4)
    assert len(spark.read.schema(schema).parquet(path).inputFiles()) >= 13
    run = batches.run_batches(streams.stream_activity_by_day(batches.ordered_stream(spark, path, schema, 4)),
                              scratch_path(spark, "t-empty-run"))
    seen = [r.input_rows for r in run.batches.collect() if r.input_rows]
    assert seen == [2, 2, 2, 2]
    assert sum(r.n_events for r in run.table.collect()) == 6  # the last two days are not closed


def test_a_run_is_stopped_well_before_the_last_batch(spark):
    rows = [("o", SHIFT, ts(24 * day), False, None) for day in range(1, 9)]
    path, schema = batches.land_in_order(raw_rows(spark, rows), "event_timestamp", 8, "t-stop")
    sdf, folder = streams.stream_activity_by_day(batches.ordered_stream(spark, path, schema)), scratch_path(spark, "t-stop-run")
    first = batches.run_batches(sdf, folder, stop_after=1)
    assert not first.ended and sum(r.input_rows > 0 for r in first.batches.collect()) <= 2
    assert sum(r.n_events for r in batches.run_batches(sdf, folder).table.collect()) == 6
