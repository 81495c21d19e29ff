"""The raw trial log derived from ``events``."""

from datetime import datetime, timedelta

from shiftlens.sources import fixture_ctes, raw_trial_events


def events(spark, folder, n=400):
    kinds = ["view", "click", "purchase", "signup", "error", None, "other"]
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i), None if i % 23 == 0 else i % 17, kinds[i % 7],
             float(i % 9 * 50), None if i % 31 == 0 else f'{{"k": {i * 37 % 100}}}') for i in range(n)]
    df = spark.createDataFrame(rows + rows[:20], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_landed_activities_give_the_rows_of_the_one_statement(spark, tmp_path):
    d = events(spark, tmp_path)
    whole = spark.sql("WITH " + fixture_ctes("TIMESTAMP_NTZ", "{events}") + " SELECT * FROM raw",
                      events=spark.read.parquet(f"{d}/events.parquet"))
    got = raw_trial_events(spark, d)
    assert got.schema.simpleString() == whole.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect())) and got.count() > 200


def test_the_regular_expression_is_not_repeated_in_the_plan(spark, tmp_path):
    plan = raw_trial_events(spark, events(spark, tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract") <= 1
