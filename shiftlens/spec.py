"""Domain specification: every name, group, threshold and label the operators use.

Operators take their literals from here, never inline, so a different product
taxonomy is a new ``Spec`` instead of a code change.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the analysed product's taxonomy exactly.
# ---------------------------------------------------------------------------

# Worker-side activities (things only an employee does).
WORKER_ACTIVITIES = (
    "PunchClock.PunchedIn",
    "PunchClock.PunchedOut",
    "PunchClockStartNote.Add.Completed",
    "PunchClockEndNote.Add.Completed",
    "Break.Activate.Started",
    "Break.Activate.Finished",
    "Scheduling.Availability.Set",
    "Scheduling.ShiftSwap.Created",
    "Scheduling.ShiftHandover.Created",
    "Scheduling.OpenShiftRequest.Created",
    "Mobile.Schedule.Loaded",
    "Shift.View.Opened",
    "ShiftDetails.View.Opened",
    "Absence.Request.Created",
)

# Admin-side activities (configuration and management).
ADMIN_ACTIVITIES = (
    "Scheduling.Shift.Created",
    "Scheduling.Shift.AssignmentChanged",
    "Scheduling.Template.ApplyModal.Applied",
    "Scheduling.Shift.Approved",
    "Scheduling.ShiftSwap.Accepted",
    "Scheduling.ShiftHandover.Accepted",
    "Scheduling.OpenShiftRequest.Approved",
    "Absence.Request.Approved",
    "Absence.Request.Rejected",
    "Timesheets.BulkApprove.Confirmed",
    "Integration.Xero.PayrollExport.Synced",
    "Revenue.Budgets.Created",
    "Communication.Message.Created",
    "PunchClock.Entry.Edited",
)

# Display labels for worker activities (name -> short label).
WORKER_LABELS = {
    "Mobile.Schedule.Loaded": "Mobile Schedule Viewed",
    "PunchClock.PunchedIn": "Punch Clock In",
    "Scheduling.Availability.Set": "Availability Set",
    "ShiftDetails.View.Opened": "Shift Details Viewed",
    "Absence.Request.Created": "Absence Request",
    "PunchClock.PunchedOut": "Punch Clock Out",
    "Break.Activate.Started": "Break Started",
    "Break.Activate.Finished": "Break Finished",
    "PunchClockEndNote.Add.Completed": "Clock-Out Note",
    "PunchClockStartNote.Add.Completed": "Clock-In Note",
    "Scheduling.ShiftSwap.Created": "Shift Swap Request",
    "Scheduling.ShiftHandover.Created": "Shift Handover",
    "Scheduling.OpenShiftRequest.Created": "Open Shift Request",
    "Shift.View.Opened": "Shift View",
}

# Worker flag groups: (feature count column, script flag, mart flag, member names).
FLAG_GROUPS = (
    ("punchclock_events", "has_punchclock", "has_punchclock",
     ("PunchClock.PunchedIn", "PunchClock.PunchedOut")),
    ("availability_events", "has_availability", "has_availability_set",
     ("Scheduling.Availability.Set",)),
    ("shift_swap_events", "has_shift_swap", "has_shift_swap_or_handover",
     ("Scheduling.ShiftSwap.Created", "Scheduling.ShiftHandover.Created")),
    ("absence_request_events", "has_absence_request", "has_absence_request",
     ("Absence.Request.Created",)),
    ("mobile_schedule_views", "has_mobile_view", "has_mobile_schedule_view",
     ("Mobile.Schedule.Loaded",)),
)

# Uplift table rows: display label -> org feature flag.
UPLIFT_FLAGS = (
    ("Any Worker Activity", "has_any_worker_activity"),
    ("Punch Clock Used", "has_punchclock"),
    ("Availability Set", "has_availability"),
    ("Shift Swap/Handover", "has_shift_swap"),
    ("Absence Request", "has_absence_request"),
    ("Mobile Schedule View", "has_mobile_view"),
)

SHIFT_CREATED = "Scheduling.Shift.Created"
MOBILE_VIEW = "Mobile.Schedule.Loaded"
AVAILABILITY_SET = "Scheduling.Availability.Set"

ARCHETYPE_BOTH = "Both Admin + Workers Active"
ARCHETYPE_ADMIN_ONLY = "Admin Only (Workers Never Joined)"
ARCHETYPE_MINIMAL = "Minimal / No Engagement"
# Chart order and short names of the archetypes.
ARCHETYPES = (
    (1, ARCHETYPE_BOTH, "Both Active"),
    (2, ARCHETYPE_ADMIN_ONLY, "Admin Only"),
    (3, ARCHETYPE_MINIMAL, "No Engagement"),
)

# Funnel stages, in order.
FUNNEL_STAGES = (
    "Trial Started",
    "Admin Set Up Shifts",
    "Mobile Schedule Viewed",
    "Any Worker Activity",
    "Workers Punched In/Out",
    "Converted to Paid",
)

# Handoff buckets in hours, closed-open [lo, hi).
HANDOFF_BUCKETS = (
    (0, 24, "Same day"),
    (24, 72, "1–3 days"),
    (72, 168, "3–7 days"),
    (168, 9999, "7+ days"),
)

# Activation tiers by number of goals completed (min goals, name), highest first.
ACTIVATION_TIERS = (
    (5, "Fully Activated"),
    (3, "Partially Activated"),
    (1, "Early Engagement"),
    (0, "No Engagement"),
)

# Feature sets of the forest comparison.
ADMIN_FEATURES = ("admin_events", "admin_unique_activities", "admin_active_days")
WORKER_FEATURES = (
    "worker_events", "worker_unique_activities", "worker_active_days",
    "has_punchclock", "has_availability", "has_shift_swap",
    "has_absence_request", "has_mobile_view", "worker_depth_score",
)
FEATURE_SETS = (
    ("Admin Features Only", ADMIN_FEATURES),
    ("Worker Features Only", WORKER_FEATURES),
    ("Admin + Worker Combined", ADMIN_FEATURES + WORKER_FEATURES),
)

# Box-plot / Mann-Whitney metrics (column, display label).
DISTRIBUTION_METRICS = (
    ("total_events", "Total Events"),
    ("admin_events", "Admin Events"),
    ("worker_events", "Worker Events"),
    ("admin_active_days", "Active Days"),
)

TRIAL_DAYS = 30
NUDGE_HOURS = 48
OUTREACH_DAY = 14
GOAL_MIN_ACTIVE_DAYS = 3
GOAL_MIN_ACTIVITY_TYPES = 3
DEEP_WORKER_DEPTH = 3
SIGNIFICANCE = 0.05
SCATTER_ADMIN_CAP = 200
SCATTER_WORKER_CAP = 100
SURVIVAL_MIN_DURATION = 0.5
WHISKER_IQR = 1.5
Z_975 = 1.959963984540054  # two-sided 95% normal quantile

RAW_COLUMNS = (
    "organization_id", "activity_name", "event_timestamp", "converted",
    "converted_at", "trial_start", "trial_end",
)
TIMESTAMP_COLUMNS = ("event_timestamp", "converted_at", "trial_start", "trial_end")


@dataclass(frozen=True)
class Spec:
    """Taxonomy handed to operators; defaults are the fixed values above."""

    worker_activities: tuple = WORKER_ACTIVITIES
    admin_activities: tuple = ADMIN_ACTIVITIES
    worker_labels: dict = field(default_factory=lambda: dict(WORKER_LABELS))
    flag_groups: tuple = FLAG_GROUPS
    trial_days: int = TRIAL_DAYS

    @property
    def worker_depth_flags(self) -> tuple:
        return tuple(g[1] for g in self.flag_groups)

    @property
    def mart_flags(self) -> tuple:
        return tuple(g[2] for g in self.flag_groups)


DEFAULT_SPEC = Spec()
