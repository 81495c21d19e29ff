"""Typed parsing of a text event log with a side output of rejected values.

One pass turns text columns into typed ones and collects, per row, every value
that was present and did not parse.  The parsed rows are landed once, with the
rejects beside them and the counts taken on the way by observed metrics, so
clean rows, reject table and counts cost one scan of the raw log together.

A value is *missing* when it is null or blank and *rejected* when it is neither
and does not parse; both give null in the typed column.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shiftlens.session import scratch_path
from shiftlens.spec import RAW_COLUMNS, TIMESTAMP_COLUMNS

# FIXED VALUES: texts read as true and as false.
TRUE_TEXTS = ("true", "1", "t", "yes")
FALSE_TEXTS = ("false", "0", "f", "no")
PARSED_COLUMNS = ("converted", *TIMESTAMP_COLUMNS)
REASONS = {"converted": "not a boolean", **{c: "not a timestamp" for c in TIMESTAMP_COLUMNS}}
REJECT = "struct<column_name:string,raw_text:string,reason:string>"


def parse_boolean(c: str) -> Column:
    text = F.lower(F.trim(F.col(c).cast("string")))
    return F.when(text.isin(*TRUE_TEXTS), F.lit(True)).when(text.isin(*FALSE_TEXTS), F.lit(False))


def parse_timestamp(c: str) -> Column:
    """``try_cast`` keeps ANSI mode from failing the job on a bad value."""
    return F.expr(f"try_cast(`{c}` AS TIMESTAMP_NTZ)")


def parse_events(text: DataFrame) -> DataFrame:
    """The canonical typed columns plus ``rejects``, an array of (column_name, raw_text, reason).

    Columns that already have their type pass unchanged and reject nothing; a
    column that the log lacks is null.
    """
    types = dict(text.dtypes)
    typed, rejects = [], []
    for c in RAW_COLUMNS:
        if c not in types:
            kind = "string" if c not in PARSED_COLUMNS else "boolean" if c == "converted" else "timestamp_ntz"
            typed.append(F.lit(None).cast(kind).alias(c))
        elif c not in PARSED_COLUMNS or types[c] in ("boolean", "timestamp_ntz"):
            typed.append(F.col(c))
        else:
            parsed = parse_boolean(c) if c == "converted" else parse_timestamp(c)
            raw = F.col(c).cast("string")
            typed.append(parsed.alias(c))
            rejects.append(F.when(parsed.isNull() & (F.trim(raw) != ""), F.struct(
                F.lit(c).alias("column_name"), raw.alias("raw_text"), F.lit(REASONS[c]).alias("reason"))))
    found = F.filter(F.array(*rejects), lambda r: r.isNotNull()) if rejects else F.array()
    return text.select(*typed, found.cast(f"array<{REJECT}>").alias("rejects"))


def unparsed(c: str) -> Column:
    """1 where the value of column ``c`` was rejected, else 0."""
    return F.exists("rejects", lambda r: r["column_name"] == c).cast("int")


class Landed(NamedTuple):
    """Clean rows, rejected values and counts of one landed log."""

    clean: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def land_events(parsed: DataFrame, name: str = "parsed-events") -> Landed:
    """Write parsed rows once; counts are observed during that write.

    ``clean`` holds every row in the canonical schema (rejected values are null,
    no row is dropped); ``rejected`` has one row per rejected value.
    """
    spark = parsed.sparkSession
    path, seen = scratch_path(spark, name), Observation(name)
    (parsed.observe(seen, F.count(F.lit(1)).alias("rows"),
                    *[F.coalesce(F.sum(unparsed(c)), F.lit(0)).cast("long").alias(c) for c in PARSED_COLUMNS])
     .withColumn("has_rejects", F.size("rejects") > 0).write.parquet(path))
    table = spark.read.parquet(path)
    rejected = (table.where("has_rejects")  # pushed down: row groups without rejects are skipped
                .select("organization_id", "activity_name", F.inline("rejects")))
    return Landed(table.select(*RAW_COLUMNS), rejected, dict(seen.get))


def count_table(spark, counts: dict[str, int]) -> DataFrame:
    """The observed counts as rows (column_name, rows, rejected)."""
    rows = [(c, counts["rows"], counts[c]) for c in PARSED_COLUMNS]
    return spark.createDataFrame(rows, "column_name string, rows long, rejected long")
