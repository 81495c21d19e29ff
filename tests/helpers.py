from datetime import datetime, timedelta

from shiftlens.sources.events import EVENT_SCHEMA

T0 = datetime(2024, 1, 1, 0, 0, 0)


def ts(hours: float = 0.0, minutes: float = 0.0) -> datetime:
    return T0 + timedelta(hours=hours, minutes=minutes)


def raw_rows(spark, rows):
    """rows: (org, activity, event_ts, converted, converted_at); trial = 30 days from T0."""
    full = [(o, a, t, c, ca, T0, T0 + timedelta(days=30)) for o, a, t, c, ca in rows]
    return spark.createDataFrame(full, EVENT_SCHEMA)
