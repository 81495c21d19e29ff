"""Rejected values, observed counts and CSV folders whose files differ in their headers."""

import gzip

from pyspark.sql import functions as F

from shiftlens.operators import staging
from shiftlens.plans import tables
from shiftlens.sources import quarantine, read_events
from shiftlens.spec import RAW_COLUMNS

TEXT = ", ".join(f"{c} string" for c in RAW_COLUMNS)
GOOD = ("o1", "Foo.Bar", "2024-01-02 10:00:00", "True", None, "2024-01-01 00:00:00", "2024-01-31 00:00:00")


def log(spark, *rows):
    return spark.createDataFrame([GOOD, *rows], TEXT)


def test_rejects_are_told_apart_from_missing_values(spark):
    df = log(spark, ("o1", "Foo.Bar", "not a date", "maybe", "", " ", "2024-13-01"), (None,) * 7,
             ("o2", "Foo.Bar", "2024-01-02 10:00:00", "0", "never", "2024-01-01", "2024-01-31 00:00:00"))
    found = quarantine.land_events(quarantine.parse_events(df))
    got = sorted((r.organization_id, r.column_name, r.raw_text, r.reason) for r in found.rejected.collect())
    assert got == [("o1", "converted", "maybe", "not a boolean"), ("o1", "event_timestamp", "not a date", "not a timestamp"),
                   ("o1", "trial_end", "2024-13-01", "not a timestamp"), ("o2", "converted_at", "never", "not a timestamp")]
    assert found.clean.count() == 4 and found.clean.columns == list(RAW_COLUMNS)
    assert found.counts == {"rows": 4, "converted": 1, "event_timestamp": 1, "trial_end": 1, "converted_at": 1, "trial_start": 0}
    by_org = {r.organization_id: r for r in found.clean.where("activity_name is not null").collect()}
    assert by_org["o2"].converted is False and str(by_org["o2"].trial_start) == "2024-01-01 00:00:00"


def test_summary_counts_values_of_every_copy(spark):
    bad = ("o1", "Foo.Bar", "not a date", "true", None, "2024-01-01 00:00:00", "soon")
    dq = staging.dq_summary(quarantine.parse_events(log(spark, bad, bad, GOOD))).first()
    assert (dq.raw_rows, dq.distinct_rows, dq.staged_rows, dq.organizations, dq.orgs_with_conflicting_metadata) == (4, 2, 1, 1, 1)
    assert (dq.unparsed_event_timestamp, dq.unparsed_trial_end, dq.unparsed_converted) == (2, 2, 0)
    typed = quarantine.parse_events(log(spark)).drop("rejects")
    assert staging.dq_summary(typed).first().unparsed_event_timestamp == 0


def test_empty_log(spark):
    found = quarantine.land_events(quarantine.parse_events(log(spark).limit(0)))
    assert found.clean.count() == 0 and found.rejected.count() == 0
    assert set(found.counts.values()) == {0} and quarantine.count_table(spark, found.counts).count() == 5
    assert staging.dq_summary(quarantine.parse_events(log(spark).limit(0))).first().raw_rows == 0


def test_summary_reads_the_log_once(spark, tmp_path):
    log(spark).write.parquet(str(tmp_path / "log"))
    parsed = quarantine.parse_events(spark.read.parquet(str(tmp_path / "log")))
    plan = staging.dq_summary(parsed)._jdf.queryExecution().toString()
    assert str(tmp_path) not in plan  # only the landed sums are read by the roll-ups


def test_files_of_one_folder_with_different_headers(spark, tmp_path):
    folder = tmp_path / "log"
    (folder / "_temporary").mkdir(parents=True)
    (folder / "_temporary" / "x.csv").write_text("Organization_Id\nlost\n")
    (folder / "a.csv").write_text("Extra,Converted,TIMESTAMP,Activity_Name,trial_end,Organization_Id,converted_at,trial_start\n"
                                  "x,yes,2024-01-02 03:04:05,Foo.Bar,2024-01-31,o1,,2024-01-01\n")
    (folder / "b.csv").write_text("﻿organization_id,activity_name,event_timestamp,converted,converted_at,trial_start,trial_end\n"
                                  'o2,"Foo, Baz",2024-01-03 00:00:00,no,,2024-01-01,2024-01-31\n', encoding="utf-8")
    (folder / "c.csv").write_text("ACTIVITY_NAME,organization_id,activity_name\nFoo.First,o3,Foo.Second\n")
    (folder / "sub").mkdir()
    with gzip.open(folder / "sub" / "d.csv.gz", "wt") as f:
        f.write("organization_id,converted\no4,perhaps\n")
    (folder / "empty.csv").write_text("")
    rows = {r.organization_id: r for r in read_events(spark, str(folder), with_rejects=True).collect()}
    assert set(rows) == {"o1", "o2", "o3", "o4"}
    assert rows["o1"].converted is True and str(rows["o1"].event_timestamp) == "2024-01-02 03:04:05"
    assert rows["o2"].activity_name == "Foo, Baz" and str(rows["o2"].trial_end) == "2024-01-31 00:00:00"
    assert rows["o3"].activity_name == "Foo.First" and rows["o3"].event_timestamp is None
    assert [r.raw_text for r in rows["o4"].rejects] == ["perhaps"]
    (tmp_path / "none").mkdir()
    assert read_events(spark, str(tmp_path / "none")).count() == 0


def test_layer_is_landed_once_and_again_when_a_file_changes(spark, tmp_path):
    source, built = tmp_path / "in", []
    spark.range(3).write.parquet(str(source))

    def build():
        built.append(1)
        return spark.read.parquet(str(source)).select(F.col("id"), (F.col("id") % 2).alias("part"))
    for _ in range(2):
        assert tables.landed(spark, str(source), "layer", build, ["part"]).count() == 3
    assert len(built) == 1
    spark.range(1).write.mode("append").parquet(str(source))
    assert tables.landed(spark, str(source), "layer", build, ["part"]).count() == 4 and len(built) == 2
