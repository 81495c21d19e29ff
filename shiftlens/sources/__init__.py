from shiftlens.sources.events import (  # noqa: F401
    EVENT_SCHEMA, coerce_timestamps, normalise_columns, read_events,
)
from shiftlens.sources.fixture import events_table, fixture_ctes, raw_trial_events  # noqa: F401
from shiftlens.sources.sinks import write_mart  # noqa: F401
