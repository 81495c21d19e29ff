"""The raw trial-event view derived from the driver's ``events`` table.

One SQL text serves Spark and DuckDB; ``{TS}`` is the engine's naive
timestamp type.  An organisation is a user, a purchase of at least 200 in the
trial window is the conversion, rows with ``k % 3 <> 0`` are doubled so that
de-duplication has work, and the trial windows are staggered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shiftlens.session import landed_copy

# FIXED VALUES: the fixture definition (CTE bodies), kept verbatim for both engines.
_EV = """
ev AS (
  SELECT user_id, ts, event_type, value,
         CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k
  FROM {EVENTS}
), """
_ORG = """org_window AS (
  SELECT user_id,
         CAST('2023-12-30 00:00:00' AS {TS}) + CAST(user_id % 5 AS INT) * INTERVAL '1' DAY AS trial_start,
         CAST('2024-01-29 00:00:00' AS {TS}) + CAST(user_id % 5 AS INT) * INTERVAL '1' DAY AS trial_end
  FROM (SELECT DISTINCT user_id FROM ev) u
), org AS (
  SELECT w.user_id, w.trial_start, w.trial_end,
         MIN(CASE WHEN e.event_type = 'purchase' AND e.value >= 200
                   AND e.ts >= w.trial_start AND e.ts <= w.trial_end THEN e.ts END) AS converted_at
  FROM org_window w JOIN ev e ON e.user_id = w.user_id
  GROUP BY w.user_id, w.trial_start, w.trial_end
), """
_MAPPED = """mapped AS (
  SELECT user_id, ts, k,
    CASE
      WHEN event_type = 'view'     AND k < 60 THEN 'Mobile.Schedule.Loaded'
      WHEN event_type = 'view'     AND k < 65 THEN 'ShiftDetails.View.Opened'
      WHEN event_type = 'view'                THEN 'Scheduling.Calendar.Viewed'
      WHEN event_type = 'click'    AND k < 50 THEN 'Scheduling.Shift.Created'
      WHEN event_type = 'click'    AND k < 90 THEN 'Scheduling.Shift.AssignmentChanged'
      WHEN event_type = 'click'               THEN 'Communication.Message.Created'
      WHEN event_type = 'purchase' AND k < 50 THEN 'Scheduling.Template.ApplyModal.Applied'
      WHEN event_type = 'purchase'            THEN 'Scheduling.Shift.Approved'
      WHEN event_type = 'signup'   AND k < 4  THEN 'PunchClock.PunchedIn'
      WHEN event_type = 'signup'   AND k < 8  THEN 'PunchClock.PunchedOut'
      WHEN event_type = 'signup'   AND k < 12 THEN 'Scheduling.Availability.Set'
      WHEN event_type = 'signup'              THEN 'Timesheets.BulkApprove.Confirmed'
      WHEN event_type = 'error'    AND k < 3  THEN 'Scheduling.ShiftSwap.Created'
      WHEN event_type = 'error'    AND k < 5  THEN 'Scheduling.ShiftHandover.Created'
      WHEN event_type = 'error'    AND k < 9  THEN 'Absence.Request.Created'
      WHEN event_type = 'error'    AND k < 50 THEN 'Absence.Request.Approved'
      ELSE 'Account.Settings.Opened'
    END AS activity_name
  FROM ev
), """
_RAW = """sided AS (
  SELECT m.*, CASE
      WHEN activity_name IN ('Mobile.Schedule.Loaded','ShiftDetails.View.Opened','PunchClock.PunchedIn',
        'PunchClock.PunchedOut','Scheduling.Availability.Set','Scheduling.ShiftSwap.Created',
        'Scheduling.ShiftHandover.Created','Absence.Request.Created') THEN 'worker'
      WHEN activity_name IN ('Scheduling.Calendar.Viewed','Account.Settings.Opened') THEN 'shared'
      ELSE 'admin' END AS side
  FROM mapped m
), copies AS (SELECT 1 AS copy_no UNION ALL SELECT 2 AS copy_no
), raw AS (
SELECT concat('org_', CAST(s.user_id AS STRING)) AS organization_id, s.activity_name,
       s.ts AS event_timestamp, o.converted_at IS NOT NULL AS converted, o.converted_at,
       o.trial_start, o.trial_end
FROM sided s JOIN org o ON o.user_id = s.user_id
JOIN copies c ON c.copy_no = 1 OR s.k % 3 <> 0
WHERE NOT (s.side = 'worker' AND s.user_id % 2 = 1)
  AND NOT (s.side = 'admin'  AND s.user_id % 9 = 0)
)"""
FIXTURE_CTES = _EV + _ORG + _MAPPED + _RAW


def fixture_ctes(ts_type: str, events: str = "events") -> str:
    return FIXTURE_CTES.replace("{TS}", ts_type).replace("{EVENTS}", events)


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def raw_trial_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw (duplicated, unfiltered) trial events from ``events.parquet``.

    The activities are landed first: in one plan the filters on them, pushed down to the
    scan, hold the regular expression 48 times in code too long to be compiled.  Events
    without a user join nothing.
    """
    events = events_table(spark, sf_dir)
    mapped = landed_copy(spark.sql("WITH " + _EV.replace("{EVENTS}", "{events} WHERE user_id IS NOT NULL")
                                   + _MAPPED.rstrip(", ") + " SELECT * FROM mapped", events=events), "activities")
    ctes = _EV.replace("{EVENTS}", "{events}") + _ORG.replace("{TS}", "TIMESTAMP_NTZ") + "mapped AS (SELECT * FROM {mapped}), "
    return spark.sql("WITH " + ctes + _RAW + " SELECT * FROM raw", events=events, mapped=mapped)
