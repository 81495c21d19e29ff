"""A refreshed mart equals a rebuilt one, and a refresh rewrites its days alone."""

import os
from datetime import date, timedelta

from pyspark.sql import functions as F

from shiftlens.operators import marts
from shiftlens.plans import catalog
from shiftlens.plans.layers import AdoptionLayers

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(str, df.select(*marts.MART_COLUMNS).collect()))


def files(folder, day):
    at = folder / "daily" / f"day={day}"
    return {f: os.stat(at / f).st_mtime_ns for f in os.listdir(at)} if at.exists() else {}


def test_one_day_rewrites_one_partition_and_equals_a_rebuild(spark, tmp_path):
    stg = catalog.stg(spark, SMALL)
    day = F.to_date("event_timestamp")
    days = [r[0] for r in stg.select(day).distinct().orderBy(day).collect()]
    late = days[-3]
    layers = AdoptionLayers(spark, str(tmp_path))
    layers.refresh(stg.where(day != late))
    assert rows_of(layers.mart()) == rows_of(marts.mart_worker_adoption(stg.where(day != late), ordered=False))
    before = {d: files(tmp_path, d) for d in days}
    assert rows_of(layers.refresh(stg, [late])) == rows_of(marts.mart_worker_adoption(stg, ordered=False))
    after = {d: files(tmp_path, d) for d in days}
    assert before[late] == {} and after[late] and all(before[d] == after[d] for d in days if d != late)
    corrected = stg.where((day != late) | (F.col("organization_id") > "org_5"))  # the day comes again with fewer events
    assert rows_of(layers.refresh(corrected, [late])) == rows_of(marts.mart_worker_adoption(corrected, ordered=False))
    gone = stg.where(day != late)
    assert rows_of(layers.refresh(gone, [late, date(1999, 1, 1)])) == rows_of(marts.mart_worker_adoption(gone, ordered=False))
    assert layers.version() == 4 and files(tmp_path, late) == {}


def test_unfinished_version_is_not_read(spark, tmp_path):
    stg = catalog.stg(spark, SMALL)
    layers = AdoptionLayers(spark, str(tmp_path))
    assert layers.version() == 0
    whole = rows_of(layers.refresh(stg))
    layers.mart().limit(1).write.parquet(str(tmp_path / "mart-2"))  # a refresh that died before its entry
    assert rows_of(layers.mart()) == whole
    assert rows_of(layers.refresh(stg, [date(2024, 1, 2) + timedelta(days=i) for i in range(2)])) == whole
