"""Oracle SQL per registered query (DuckDB dialect)."""

from __future__ import annotations

from shiftlens.plans.oracle_base import GROUP_NAMES, LABELS, WORKER_NAMES, _in_list, cte, erfc_sql, sql_with

ORACLES: dict[str, str] = {}


def oracle(name: str, select: str, *needed: str) -> None:
    ORACLES[name] = sql_with(select, *needed)


ORACLES["coerce_timestamps"] = """
WITH t AS (
  SELECT event_id,
         CASE WHEN CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 10 = 0 THEN 'not a date'
              ELSE CAST(ts AS VARCHAR) END AS txt
  FROM events)
SELECT event_id, TRY_CAST(txt AS TIMESTAMP) AS event_timestamp,
       TRY_CAST(txt AS TIMESTAMP) IS NULL AS is_unparsed
FROM t
"""

oracle("dedup_events", "SELECT * FROM dedup", "dedup")
oracle("stg_trial_events", "SELECT * FROM stg", "stg")

cte("textlog", ("__fixture__",), """
SELECT organization_id, activity_name,
       CASE second(event_timestamp) WHEN 7 THEN 'not a date' WHEN 8 THEN '' ELSE CAST(event_timestamp AS VARCHAR) END
           AS event_timestamp,
       CASE second(event_timestamp) WHEN 17 THEN 'maybe' ELSE CAST(converted AS VARCHAR) END AS converted,
       CASE second(event_timestamp) WHEN 27 THEN '31/31/2024' ELSE CAST(converted_at AS VARCHAR) END AS converted_at,
       CASE second(event_timestamp) WHEN 37 THEN 'soon' ELSE CAST(trial_start AS VARCHAR) END AS trial_start,
       CASE second(event_timestamp) WHEN 47 THEN '2024-13-01' WHEN 48 THEN ' ' ELSE CAST(trial_end AS VARCHAR) END
           AS trial_end
FROM raw
""")
cte("parsed", ("textlog",), """
SELECT organization_id, activity_name, TRY_CAST(event_timestamp AS TIMESTAMP) AS event_timestamp,
       TRY_CAST(converted AS BOOLEAN) AS converted, TRY_CAST(converted_at AS TIMESTAMP) AS converted_at,
       TRY_CAST(trial_start AS TIMESTAMP) AS trial_start, TRY_CAST(trial_end AS TIMESTAMP) AS trial_end
FROM textlog
""")
_KINDS = {"converted": "BOOLEAN", "event_timestamp": "TIMESTAMP", "converted_at": "TIMESTAMP",
          "trial_start": "TIMESTAMP", "trial_end": "TIMESTAMP"}
_REJECTED = {c: f"trim({c}) <> '' AND TRY_CAST({c} AS {kind}) IS NULL" for c, kind in _KINDS.items()}

oracle("dq_summary", f"""
SELECT r.*, d.distinct_rows, r.raw_rows - d.distinct_rows AS duplicates_removed,
       round((r.raw_rows - d.distinct_rows) * 100.0 / r.raw_rows, 6) AS duplicates_removed_pct,
       d.organizations, d.activity_types, d.events_before_window, d.events_after_window, d.staged_rows,
       c.orgs_with_conflicting_metadata, u.*
FROM (SELECT COUNT(*) AS raw_rows,
             COUNT(*) FILTER (WHERE event_timestamp IS NULL) AS null_event_timestamps,
             COUNT(*) FILTER (WHERE organization_id IS NULL) AS null_organization_ids
      FROM parsed) r,
     (SELECT COUNT(*) AS distinct_rows,
             COUNT(DISTINCT organization_id) AS organizations,
             COUNT(DISTINCT activity_name) AS activity_types,
             COUNT(*) FILTER (WHERE event_timestamp < trial_start) AS events_before_window,
             COUNT(*) FILTER (WHERE event_timestamp > trial_end AND trial_start IS NOT NULL) AS events_after_window,
             COUNT(*) FILTER (WHERE organization_id IS NOT NULL
                              AND event_timestamp BETWEEN trial_start AND trial_end) AS staged_rows
      FROM (SELECT DISTINCT * FROM parsed)) d,
     (SELECT COUNT(*) FILTER (WHERE tuples > 1) AS orgs_with_conflicting_metadata
      FROM (SELECT organization_id, COUNT(*) AS tuples
            FROM (SELECT DISTINCT organization_id, converted, converted_at, trial_start, trial_end FROM parsed
                  WHERE organization_id IS NOT NULL) GROUP BY organization_id)) c,
     (SELECT {", ".join(f"COUNT(*) FILTER (WHERE {rule}) AS unparsed_{c}" for c, rule in _REJECTED.items())}
      FROM textlog) u
""", "parsed")

oracle("quarantine_rows", " UNION ALL ".join(
    f"SELECT organization_id, activity_name, '{c}' AS column_name, {c} AS raw_text, "
    f"'not a {_KINDS[c].lower()}' AS reason FROM textlog WHERE {rule}" for c, rule in _REJECTED.items()), "textlog")
oracle("quarantine_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) AS rows, COUNT(*) FILTER (WHERE {rule}) AS rejected FROM textlog"
    for c, rule in _REJECTED.items()), "textlog")

oracle("org_meta", """
SELECT organization_id, MAX(converted) AS converted, MAX(converted_at) AS converted_at,
       MAX(trial_start) AS trial_start, MAX(trial_end) AS trial_end
FROM stg GROUP BY organization_id
""", "stg")

oracle("classify_events", "SELECT * FROM classified", "classified")

_group_case = " ".join(
    f"WHEN activity_name IN ({_in_list(names)}) THEN '{count_col}'" for count_col, names in GROUP_NAMES.items())
_members = [n for names in GROUP_NAMES.values() for n in names]
oracle("filter_membership", f"""
SELECT organization_id, activity_name, event_timestamp, CASE {_group_case} END AS flag_group
FROM classified
WHERE activity_type = 'worker' AND activity_name IN ({_in_list(_members)})
""", "classified")

oracle("events_by_side", """
SELECT activity_type, COUNT(activity_name) AS event_count FROM classified GROUP BY activity_type
""", "classified")

_label_case = " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items())
for _side, _label in (("worker", f"CASE activity_name {_label_case} ELSE activity_name END"),
                      ("admin", "activity_name")):
    oracle(f"{_side}_activity_breakdown", f"""
SELECT activity_name, {_label} AS label, event_count,
       CAST(row_number() OVER (ORDER BY event_count DESC, activity_name) AS INTEGER) AS display_rank
FROM (SELECT activity_name, COUNT(*) AS event_count FROM classified
      WHERE activity_type = '{_side}' AND activity_name IS NOT NULL GROUP BY activity_name) t
""", "classified")

oracle("org_features", "SELECT * FROM orgf", "orgf")
oracle("org_features_joined", "SELECT * FROM orgf", "orgf")

oracle("mart_worker_adoption", """
SELECT * EXCLUDE (lost),
       lost AND adoption_archetype LIKE 'Admin Only%' AS flag_admin_only_not_converted,
       lost AND has_any_worker_activity AND has_punchclock = 0 AS flag_no_punchclock_not_converted,
       lost AND worker_depth_score >= 3 AS flag_deep_worker_not_converted
FROM (SELECT organization_id, converted, converted_at, days_to_conversion, trial_start, trial_end,
             total_events, admin_events, worker_events, admin_unique_activities, worker_unique_activities,
             admin_active_days, worker_active_days, has_punchclock, has_availability AS has_availability_set,
             has_shift_swap AS has_shift_swap_or_handover, has_absence_request,
             has_mobile_view AS has_mobile_schedule_view,
             first_admin_ts AS first_admin_event_ts, first_worker_ts AS first_worker_event_ts,
             has_any_worker_activity = 1 AS has_any_worker_activity, worker_depth_score,
             round(worker_event_share, 3) AS worker_event_share,
             date_diff('hour', first_admin_ts, first_worker_ts) AS handoff_gap_hours,
             archetype AS adoption_archetype, NOT converted AS lost
      FROM orgf) m
""", "orgf")

# ---------------------------------------------------------------- reports

from shiftlens.plans.oracle_base import chi2_sql  # noqa: E402
from shiftlens.spec import (  # noqa: E402
    ADMIN_FEATURES, ARCHETYPES, DISTRIBUTION_METRICS, FEATURE_SETS, FUNNEL_STAGES, HANDOFF_BUCKETS,
    UPLIFT_FLAGS, WORKER_FEATURES,
)

oracle("conversion_overview", """
SELECT COUNT(*) AS total_orgs,
       COUNT(*) FILTER (WHERE converted) AS converted_orgs,
       COUNT(*) FILTER (WHERE NOT converted) AS not_converted_orgs,
       round(COUNT(*) FILTER (WHERE converted) / CAST(COUNT(*) AS DOUBLE), 6) AS conversion_rate,
       COUNT(*) FILTER (WHERE has_any_worker_activity = 1) AS orgs_with_worker_activity,
       COUNT(*) FILTER (WHERE has_any_worker_activity = 0) AS orgs_without_worker_activity,
       round(COUNT(*) FILTER (WHERE has_any_worker_activity = 1) / CAST(COUNT(*) AS DOUBLE), 6) AS share_with_worker,
       round(COUNT(*) FILTER (WHERE has_any_worker_activity = 0) / CAST(COUNT(*) AS DOUBLE), 6) AS share_without_worker
FROM orgf
""", "orgf")


def _cells(flag: str) -> str:
    return f"""COUNT(*) FILTER (WHERE {flag} = 1 AND converted) AS a,
       COUNT(*) FILTER (WHERE {flag} = 1 AND NOT converted) AS b,
       COUNT(*) FILTER (WHERE {flag} = 0 AND converted) AS c,
       COUNT(*) FILTER (WHERE {flag} = 0 AND NOT converted) AS d"""


_chi2, _p = chi2_sql("a", "b", "c", "d")

oracle("worker_headline", f"""
SELECT a + b AS n_with_worker, c + d AS n_without_worker,
       round(a / CAST(a + b AS DOUBLE), 6) AS conv_rate_with_worker,
       round(c / CAST(c + d AS DOUBLE), 6) AS conv_rate_without_worker,
       round((a / CAST(a + b AS DOUBLE) - c / CAST(c + d AS DOUBLE)) * 100, 6) AS uplift_pp,
       round({_chi2}, 6) AS chi2, round({_p}, 6) AS p_value, {_p} < 0.05 AS significant
FROM (SELECT {_cells('has_any_worker_activity')} FROM orgf) t
""", "orgf")

oracle("crosstab_worker_converted", """
SELECT has_any_worker_activity,
       COUNT(*) FILTER (WHERE NOT converted) AS not_converted,
       COUNT(*) FILTER (WHERE converted) AS converted
FROM orgf GROUP BY has_any_worker_activity
""", "orgf")

_flag_rows = " UNION ALL ".join(
    f"SELECT {i} AS flag_no, '{label}' AS activity, '{col}' AS flag, {_cells(col)} FROM orgf"
    for i, (label, col) in enumerate(UPLIFT_FLAGS, start=1))

oracle("chi_square_flags", f"""
SELECT flag, a AS yes_converted, b AS yes_not_converted, c AS no_converted, d AS no_not_converted,
       round({_chi2}, 6) AS chi2, round({_p}, 6) AS p_value, {_p} < 0.05 AS significant,
       (a + b) > 0 AND (c + d) > 0 AND (a + c) > 0 AND (b + d) > 0 AS is_2x2
FROM ({_flag_rows}) t
""", "orgf")

oracle("activity_uplift", f"""
SELECT activity, flag, n_orgs, pct_orgs, conv_yes, conv_no, uplift_pp, p_value, significant,
       CAST(row_number() OVER (ORDER BY raw_uplift DESC NULLS LAST, activity) AS INTEGER) AS rank
FROM (
  SELECT activity, flag, a + b AS n_orgs,
         round((a + b) * 100.0 / (a + b + c + d), 6) AS pct_orgs,
         round(a * 100.0 / NULLIF(a + b, 0), 6) AS conv_yes,
         round(c * 100.0 / NULLIF(c + d, 0), 6) AS conv_no,
         round(a * 100.0 / NULLIF(a + b, 0) - c * 100.0 / NULLIF(c + d, 0), 6) AS uplift_pp,
         a * 100.0 / NULLIF(a + b, 0) - c * 100.0 / NULLIF(c + d, 0) AS raw_uplift,
         round({_p}, 6) AS p_value, {_p} < 0.05 AS significant
  FROM ({_flag_rows}) t) u
""", "orgf")

oracle("archetypes", """
SELECT archetype, COUNT(*) AS n_orgs,
       round_even(avg(CAST(converted AS INTEGER)), 2) AS conv_rate,
       round_even(avg(admin_events), 2) AS avg_admin_events,
       round_even(avg(worker_events), 2) AS avg_worker_events,
       round_even(avg(admin_active_days), 2) AS avg_admin_active_days,
       round_even(avg(CAST(converted AS INTEGER)), 2) * 100 AS conv_rate_pct,
       round(avg(CAST(converted AS INTEGER)), 6) AS conv_rate_raw
FROM orgf GROUP BY archetype
""", "orgf")

_arch_values = ", ".join(f"({i}, '{name}', '{short}')" for i, name, short in ARCHETYPES)
oracle("archetype_chart", f"""
SELECT c.archetype_order, c.archetype, c.short_name, COALESCE(s.n_orgs, 0) AS n_orgs,
       COALESCE(s.conv_rate_pct, 0.0) AS conv_rate_pct,
       COALESCE(s.avg_admin_events, 0.0) AS avg_admin_events,
       COALESCE(s.avg_worker_events, 0.0) AS avg_worker_events
FROM (VALUES {_arch_values}) c(archetype_order, archetype, short_name)
LEFT JOIN (SELECT archetype, COUNT(*) AS n_orgs,
                  round_even(avg(CAST(converted AS INTEGER)), 2) * 100 AS conv_rate_pct,
                  round_even(avg(admin_events), 2) AS avg_admin_events,
                  round_even(avg(worker_events), 2) AS avg_worker_events
           FROM orgf GROUP BY archetype) s USING (archetype)
""", "orgf")

oracle("depth_summary", """
SELECT worker_depth_score, COUNT(*) AS n_orgs,
       round(avg(CAST(converted AS INTEGER)), 6) AS conv_rate,
       round(avg(CAST(converted AS INTEGER)) * 100, 6) AS conv_rate_pct
FROM orgf GROUP BY worker_depth_score
""", "orgf")

oracle("side_volume_by_outcome", """
SELECT converted, COUNT(*) AS n_orgs, round(avg(admin_events), 6) AS avg_admin_events,
       round(avg(worker_events), 6) AS avg_worker_events, round(avg(worker_event_share), 6) AS avg_worker_event_share
FROM orgf GROUP BY converted
""", "orgf")

_stage_sql = [
    "COUNT(*)",
    "COUNT(*) FILTER (WHERE a.shift_created_events > 0)",
    "COUNT(*) FILTER (WHERE f.has_mobile_view = 1)",
    "COUNT(*) FILTER (WHERE f.has_any_worker_activity = 1)",
    "COUNT(*) FILTER (WHERE f.has_punchclock = 1)",
    "COUNT(*) FILTER (WHERE f.converted)",
]
_stages = " UNION ALL ".join(
    f"SELECT {i} AS stage_no, '{name}' AS stage, {expr} AS count FROM org_agg a JOIN orgf f USING (organization_id)"
    for i, (name, expr) in enumerate(zip(FUNNEL_STAGES, _stage_sql), start=1))
oracle("adoption_funnel", f"""
SELECT stage_no, stage, count,
       round(count * 100.0 / first_value(count) OVER (ORDER BY stage_no), 6) AS pct_total,
       CASE WHEN stage_no = 1 THEN 0.0
            ELSE round((1 - count / NULLIF(CAST(lag(count) OVER (ORDER BY stage_no) AS DOUBLE), 0)) * 100, 6) END
            AS drop_off
FROM ({_stages}) s
""", "org_agg", "orgf")

# ---------------------------------------------------------------- distributions


def _describe(src: str, group: str, value: str) -> str:
    return f"""SELECT {group}, COUNT(*) AS n, round(avg({value}), 6) AS mean,
       round(quantile_cont({value}, 0.25), 6) AS p25, round(quantile_cont({value}, 0.5), 6) AS median,
       round(quantile_cont({value}, 0.75), 6) AS p75
FROM {src} WHERE {value} IS NOT NULL GROUP BY {group}"""


oracle("worker_timing", _describe("wt", "converted", "days_to_first_worker"), "wt")

oracle("handoff_gap", f"""
SELECT *, round(median / 24.0, 6) AS median_days FROM (
{_describe("(SELECT 'all' AS scope, handoff_gap_hrs FROM hf UNION ALL "
           "SELECT CASE WHEN converted THEN 'converted' ELSE 'not_converted' END, handoff_gap_hrs FROM hf) s",
           "scope", "handoff_gap_hrs")}) t
""", "hf")

_bucket_values = ", ".join(f"({i}, {float(lo)}, {float(hi)}, '{label}')"
                           for i, (lo, hi, label) in enumerate(HANDOFF_BUCKETS, start=1))
oracle("handoff_buckets", f"""
SELECT b.bucket_no, b.label, CAST(b.lo AS DOUBLE) AS lo, CAST(b.hi AS DOUBLE) AS hi,
       COUNT(h.organization_id) AS n_orgs,
       round(avg(CAST(h.converted AS INTEGER)), 6) AS conv_rate,
       round(COALESCE(avg(CAST(h.converted AS INTEGER)) * 100, 0.0), 6) AS conv_rate_pct_chart
FROM (VALUES {_bucket_values}) b(bucket_no, lo, hi, label)
LEFT JOIN hf h ON h.handoff_gap_hrs >= b.lo AND h.handoff_gap_hrs < b.hi
GROUP BY b.bucket_no, b.label, b.lo, b.hi
""", "hf")

oracle("adoption_curve", """
SELECT o.converted, CAST(d.day AS INTEGER) AS day,
       COUNT(f.organization_id) FILTER (WHERE f.hours_to_first_worker / 24.0 <= d.day) AS n_orgs_reached,
       COUNT(f.organization_id) AS n_orgs,
       round(COUNT(f.organization_id) FILTER (WHERE f.hours_to_first_worker / 24.0 <= d.day) * 100.0
             / COUNT(f.organization_id), 6) AS cum_pct
FROM (SELECT DISTINCT converted FROM orgf) o
CROSS JOIN (SELECT range AS day FROM range(0, 31)) d
JOIN orgf f ON f.converted = o.converted
GROUP BY o.converted, d.day
""", "orgf")

oracle("metric_quantiles", """
SELECT metric, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95
FROM (SELECT 'total_events' AS metric, CAST(total_events AS DOUBLE) AS value FROM orgf
      UNION ALL SELECT 'admin_active_days', CAST(admin_active_days AS DOUBLE) FROM orgf
      UNION ALL SELECT 'days_to_first_worker', days_to_first_worker FROM wt
      UNION ALL SELECT 'handoff_gap_days', handoff_gap_days FROM hf) t
WHERE value IS NOT NULL GROUP BY metric
""", "orgf", "wt", "hf")

oracle("capped_metrics", """
SELECT f.organization_id, f.converted,
       round(least(f.total_events, c.cap_total), 6) AS total_events_capped,
       least(f.admin_events, 200) AS admin_events_capped,
       least(f.worker_events, 100) AS worker_events_capped,
       round(CASE WHEN f.hours_to_first_worker IS NOT NULL
                  THEN least(f.hours_to_first_worker / 24.0, c.cap_first) END, 6) AS days_to_first_worker_capped,
       round(CASE WHEN f.first_worker_ts IS NOT NULL AND f.first_admin_ts IS NOT NULL
                  THEN least(greatest(date_diff('microsecond', f.first_admin_ts, f.first_worker_ts) / 3.6e9, 0.0) / 24.0,
                             c.cap_gap) END, 6) AS handoff_gap_days_capped
FROM orgf f,
     (SELECT (SELECT quantile_cont(total_events, 0.95) FROM orgf) AS cap_total,
             (SELECT quantile_cont(days_to_first_worker, 0.95) FROM wt) AS cap_first,
             (SELECT quantile_cont(handoff_gap_days, 0.95) FROM hf) AS cap_gap) c
""", "orgf", "wt", "hf")


def _hist(values_sql: str, ranges_sql: str, bins: int) -> str:
    """Histogram over every bin: values (converted, x) and ranges (converted, lo, hi)."""
    return f"""
WITH v AS ({values_sql}),
r0 AS ({ranges_sql}),
r AS (SELECT converted, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo,
             CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM r0),
g AS (SELECT r.converted, r.lo, r.hi, CAST(s.range AS INTEGER) AS bin FROM r CROSS JOIN range(0, {bins}) s),
c AS (SELECT v.converted,
             CAST(least(floor((v.x - r.lo) * {bins} / (r.hi - r.lo)), {bins - 1}) AS INTEGER) AS bin,
             COUNT(*) AS n
      FROM v JOIN r ON v.converted = r.converted
      WHERE v.x IS NOT NULL AND v.x >= r.lo AND v.x <= r.hi GROUP BY 1, 2)
SELECT g.converted, g.bin, round(g.lo + g.bin * ((g.hi - g.lo) / {bins}), 6) AS bin_lo,
       round(g.lo + (g.bin + 1) * ((g.hi - g.lo) / {bins}), 6) AS bin_hi, COALESCE(c.n, 0) AS n
FROM g LEFT JOIN c ON g.converted = c.converted AND g.bin = c.bin"""


_auto = "SELECT converted, min(x) AS lo, max(x) AS hi FROM v WHERE x IS NOT NULL GROUP BY converted"
oracle("hist_total_events", _hist(
    "SELECT converted, least(total_events, (SELECT quantile_cont(total_events, 0.95) FROM orgf)) AS x FROM orgf",
    "SELECT DISTINCT converted, 0.0 AS lo, (SELECT quantile_cont(total_events, 0.95) FROM orgf) AS hi FROM orgf",
    35), "orgf")
oracle("hist_active_days", _hist(
    "SELECT converted, CAST(admin_active_days AS DOUBLE) AS x FROM orgf",
    "SELECT DISTINCT converted, 0.0 AS lo, (SELECT CAST(max(admin_active_days) AS DOUBLE) FROM orgf) AS hi FROM orgf",
    24), "orgf")
oracle("hist_first_worker", _hist(
    "SELECT converted, least(days_to_first_worker, (SELECT quantile_cont(days_to_first_worker, 0.95) FROM wt)) AS x "
    "FROM wt", _auto, 25), "wt")
oracle("hist_worker_share", _hist("SELECT converted, worker_event_share * 100 AS x FROM orgf", _auto, 20), "orgf")
oracle("hist_handoff_gap", _hist(
    "SELECT converted, least(handoff_gap_days, (SELECT quantile_cont(handoff_gap_days, 0.95) FROM hf)) AS x FROM hf",
    _auto, 25), "hf")

_long_metrics = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, converted, CAST({m} AS DOUBLE) AS value FROM orgf" for m, _ in DISTRIBUTION_METRICS)
oracle("boxplot_stats", f"""
WITH l AS ({_long_metrics}),
q AS (SELECT metric, converted, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM l GROUP BY metric, converted)
SELECT q.metric, q.converted, COUNT(*) AS n, round(q.q1, 6) AS q1, round(q.median, 6) AS median,
       round(q.q3, 6) AS q3, round(q.q3 - q.q1, 6) AS iqr,
       round(COALESCE(min(l.value) FILTER (WHERE l.value >= q.q1 - 1.5 * (q.q3 - q.q1)), q.q1), 6) AS whisker_lo,
       round(COALESCE(max(l.value) FILTER (WHERE l.value <= q.q3 + 1.5 * (q.q3 - q.q1)), q.q3), 6) AS whisker_hi,
       COUNT(*) FILTER (WHERE l.value < q.q1 - 1.5 * (q.q3 - q.q1) OR l.value > q.q3 + 1.5 * (q.q3 - q.q1))
           AS n_outliers
FROM l JOIN q USING (metric, converted)
GROUP BY q.metric, q.converted, q.q1, q.median, q.q3
""", "orgf")

oracle("scatter_admin_worker", """
SELECT organization_id, converted, least(admin_events, 200) AS admin_events_capped,
       least(worker_events, 100) AS worker_events_capped
FROM orgf
""", "orgf")

# ---------------------------------------------------------------- tests, models, survival


def _mwu(long_sql: str) -> str:
    """Mann-Whitney per metric from per-row average ranks (rank + ties)."""
    return f"""
WITH l AS ({long_sql}),
rk AS (SELECT metric, value, converted,
              rank() OVER (PARTITION BY metric ORDER BY value)
              + (COUNT(*) OVER (PARTITION BY metric, value) - 1) / 2.0 AS r
       FROM l WHERE value IS NOT NULL),
ties AS (SELECT metric, SUM(CAST(t AS DOUBLE) * t * t - t) AS tie_term
         FROM (SELECT metric, value, COUNT(*) AS t FROM rk GROUP BY metric, value) x GROUP BY metric),
s AS (SELECT metric, CAST(COUNT(*) FILTER (WHERE converted) AS DOUBLE) AS n1,
             CAST(COUNT(*) FILTER (WHERE NOT converted) AS DOUBLE) AS n0,
             SUM(r) FILTER (WHERE converted) AS r1
      FROM rk GROUP BY metric),
u AS (SELECT s.*, t.tie_term, COALESCE(r1, 0) - n1 * (n1 + 1) / 2 AS u1,
             sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - t.tie_term / ((n1 + n0) * (n1 + n0 - 1)))) AS sigma
      FROM s JOIN ties t USING (metric)),
z AS (SELECT *, (greatest(u1, n1 * n0 - u1) - n1 * n0 / 2 - 0.5) / NULLIF(sigma, 0) AS zz FROM u)
SELECT metric, CAST(n1 AS BIGINT) AS n_converted, CAST(n0 AS BIGINT) AS n_not_converted,
       round(u1, 6) AS u_stat, round(zz, 6) AS z,
       round(CASE WHEN n1 = 0 OR n0 = 0 THEN NULL WHEN sigma = 0 THEN 1.0
                  ELSE least(1.0, {erfc_sql('(zz / sqrt(2.0))')}) END, 6) AS p_value,
       CASE WHEN n1 = 0 OR n0 = 0 THEN NULL WHEN sigma = 0 THEN 1.0
            ELSE least(1.0, {erfc_sql('(zz / sqrt(2.0))')}) END < 0.05 AS significant,
       n1 <= 8 OR n0 <= 8 AS small_sample
FROM z"""


oracle("mann_whitney_metrics", _mwu(_long_metrics), "orgf")
oracle("mann_whitney_timing", _mwu(
    "SELECT 'days_to_first_worker' AS metric, converted, days_to_first_worker AS value FROM wt"), "wt")

_AUC_SCORES = ("total_events", "admin_events", "worker_events", "admin_active_days", "worker_active_days",
               "admin_unique_activities", "worker_unique_activities", "worker_depth_score", "worker_event_share")
_long_scores = " UNION ALL ".join(
    f"SELECT '{m}' AS score_name, converted, CAST({m} AS DOUBLE) AS score FROM orgf" for m in _AUC_SCORES)
oracle("roc_auc_score_table", f"""
WITH l AS ({_long_scores}),
rk AS (SELECT score_name, converted,
              rank() OVER (PARTITION BY score_name ORDER BY score)
              + (COUNT(*) OVER (PARTITION BY score_name, score) - 1) / 2.0 AS r
       FROM l WHERE score IS NOT NULL),
s AS (SELECT score_name, COUNT(*) FILTER (WHERE converted) AS n_pos, COUNT(*) FILTER (WHERE NOT converted) AS n_neg,
             SUM(r) FILTER (WHERE converted) AS r1 FROM rk GROUP BY score_name)
SELECT score_name, n_pos, n_neg,
       round(CASE WHEN n_pos > 0 AND n_neg > 0
                  THEN (r1 - n_pos * (n_pos + 1) / 2.0) / (CAST(n_pos AS DOUBLE) * n_neg) END, 6) AS auc
FROM s
""", "orgf")

cte("si", ("orgf",), """
SELECT organization_id,
       CASE WHEN has_any_worker_activity = 1 THEN 'worker_active' ELSE 'no_worker_activity' END AS "group",
       least(greatest(CASE WHEN converted THEN COALESCE(days_to_conversion, 30.0) ELSE 30.0 END, 0.5), 30.0)
           AS duration,
       CAST(converted AS INTEGER) AS event
FROM orgf
""")
oracle("survival_input", 'SELECT * FROM si', "si")

oracle("kaplan_meier", """
WITH kev AS (SELECT "group" AS g, duration AS time, CAST(SUM(event) AS BIGINT) AS d, COUNT(*) AS c
            FROM si GROUP BY 1, 2),
tot AS (SELECT "group" AS g, COUNT(*) AS big_n FROM si GROUP BY 1),
atrisk AS (SELECT kev.*, CAST(tot.big_n - (SUM(c) OVER (PARTITION BY kev.g ORDER BY time) - c) AS BIGINT) AS n
       FROM kev JOIN tot USING (g)),
terms AS (SELECT *, CASE WHEN d = n THEN 0.0 ELSE ln(1 - d / CAST(n AS DOUBLE)) END AS lt,
                 CASE WHEN d = n THEN 0.0 ELSE d / (CAST(n AS DOUBLE) * (n - d)) END AS gt,
                 CASE WHEN d = n THEN 1 ELSE 0 END AS zt FROM atrisk),
cum AS (SELECT g, time, n, d, c - d AS censored,
               SUM(lt) OVER w AS lc, SUM(gt) OVER w AS gc, SUM(zt) OVER w AS zc
        FROM terms WINDOW w AS (PARTITION BY g ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        UNION ALL SELECT g, 0.0, big_n, 0, 0, 0.0, 0.0, 0 FROM tot)
SELECT g AS "group", time, n AS n_at_risk, d AS n_events, censored,
       round(CASE WHEN zc > 0 THEN 0.0 ELSE exp(lc) END, 6) AS survival,
       CASE WHEN zc > 0 THEN NULL ELSE round(exp(2 * lc) * gc, 6) END AS variance,
       CASE WHEN zc > 0 THEN NULL WHEN lc = 0 THEN 1.0
            ELSE round(exp(-exp(ln(-lc) - 1.959963984540054 * sqrt(gc) / lc)), 6) END AS ci_lower,
       CASE WHEN zc > 0 THEN NULL WHEN lc = 0 THEN 1.0
            ELSE round(exp(-exp(ln(-lc) + 1.959963984540054 * sqrt(gc) / lc)), 6) END AS ci_upper
FROM cum
""", "si")

_fs_rows = " UNION ALL ".join(
    f"SELECT organization_id, '{name}' AS feature_set, {i} AS feature_index, '{c}' AS feature_name, "
    f"COALESCE(CAST({c} AS DOUBLE), 0.0) AS value FROM orgf"
    for name, cols in FEATURE_SETS for i, c in enumerate(cols))
oracle("feature_sets", f"SELECT * FROM ({_fs_rows}) t", "orgf")

_std_cols = ADMIN_FEATURES + WORKER_FEATURES
oracle("standardize_features", "SELECT organization_id, " + ", ".join(
    f"round((CAST({c} AS DOUBLE) - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1.0 "
    f"ELSE stddev_pop({c}) OVER () END, 6) AS {c}" for c in _std_cols) + " FROM orgf", "orgf")

oracle("cv_folds", """
SELECT organization_id, CAST(converted AS INTEGER) AS label,
       CAST(ntile(5) OVER (PARTITION BY converted ORDER BY organization_id) - 1 AS INTEGER) AS fold
FROM orgf
""", "orgf")

# ---------------------------------------------------------------- goals, activation, triggers

_goals_body = """
SELECT organization_id, converted, converted_at, trial_start, trial_end, active_days, unique_activities,
       CASE WHEN shift_created_events > 0 THEN 1 ELSE 0 END AS goal_shift_created,
       CASE WHEN mobile_schedule_views > 0 THEN 1 ELSE 0 END AS goal_mobile_viewed,
       CASE WHEN availability_events > 0 THEN 1 ELSE 0 END AS goal_availability_set,
       CASE WHEN active_days >= 3 THEN 1 ELSE 0 END AS goal_active_days,
       CASE WHEN unique_activities >= 3 THEN 1 ELSE 0 END AS goal_activity_types,
       CAST((shift_created_events > 0)::INT + (mobile_schedule_views > 0)::INT + (availability_events > 0)::INT
            + (active_days >= 3)::INT + (unique_activities >= 3)::INT AS INTEGER) AS goals_completed
FROM {src}"""
cte("goals", ("org_agg",), _goals_body.format(src="org_agg"))

_tier = """CASE WHEN goals_completed >= 5 THEN 'Fully Activated' WHEN goals_completed >= 3 THEN 'Partially Activated'
            WHEN goals_completed >= 1 THEN 'Early Engagement' ELSE 'No Engagement' END"""
cte("activation", ("goals",), f"""
SELECT organization_id, converted, goals_completed, {_tier} AS activation_tier,
       goals_completed = 5 AS is_activated,
       goals_completed >= 3 AND NOT converted AS is_near_activated_not_converted,
       goals_completed = 0 AS is_zero_engagement,
       goals_completed = 5 AND NOT converted AS is_activated_churned
FROM goals""")

oracle("mart_trial_goals", "SELECT * FROM goals", "goals")
oracle("mart_trial_activation", "SELECT * FROM activation", "activation")
oracle("activation_tier_summary", """
SELECT t.tier_order, t.activation_tier, COUNT(a.organization_id) AS n_orgs,
       COUNT(a.organization_id) FILTER (WHERE a.converted) AS n_converted,
       round(COUNT(a.organization_id) FILTER (WHERE a.converted) / CAST(NULLIF(COUNT(a.organization_id), 0) AS DOUBLE), 6)
           AS conv_rate
FROM (VALUES (1, 'Fully Activated'), (2, 'Partially Activated'), (3, 'Early Engagement'), (4, 'No Engagement'))
     t(tier_order, activation_tier)
LEFT JOIN activation a USING (activation_tier)
GROUP BY t.tier_order, t.activation_tier
""", "activation")

cte("d14_events", ("classified",), """
SELECT * FROM classified WHERE event_timestamp <= trial_start + INTERVAL 14 DAY
""")
cte("d14_agg", ("d14_events",), f"""
SELECT organization_id, MAX(converted) AS converted, MAX(converted_at) AS converted_at,
       MAX(trial_start) AS trial_start, MAX(trial_end) AS trial_end, COUNT(*) AS total_events,
       COUNT(DISTINCT CAST(event_timestamp AS DATE)) AS active_days, COUNT(DISTINCT activity_name) AS unique_activities,
       COUNT(*) FILTER (WHERE activity_name = 'Scheduling.Shift.Created') AS shift_created_events,
       COUNT(*) FILTER (WHERE activity_name = 'Mobile.Schedule.Loaded') AS mobile_schedule_views,
       COUNT(*) FILTER (WHERE activity_name = 'Scheduling.Availability.Set') AS availability_events
FROM d14_events GROUP BY organization_id""")
cte("d14_goals", ("d14_agg",), "SELECT g.*, a.total_events FROM (" + _goals_body.format(src="d14_agg")
    + ") g JOIN d14_agg a USING (organization_id)")
oracle("day14_outreach", f"""
SELECT organization_id, converted, goals_completed, {_tier} AS activation_tier,
       CASE {_tier} WHEN 'Partially Activated' THEN 1 WHEN 'Fully Activated' THEN 2
                    WHEN 'Early Engagement' THEN 3 ELSE 4 END AS priority,
       total_events AS events_by_day
FROM d14_goals
WHERE NOT (converted AND converted_at IS NOT NULL AND converted_at <= trial_start + INTERVAL 14 DAY)
""", "d14_goals")

oracle("onboarding_nudge", """
WITH anchor AS (SELECT organization_id, MIN(event_timestamp) AS first_shift_created_at, MAX(converted) AS converted
                FROM classified WHERE activity_name = 'Scheduling.Shift.Created' GROUP BY organization_id)
SELECT a.organization_id, a.first_shift_created_at, a.first_shift_created_at + INTERVAL 48 HOUR AS nudge_due_at,
       a.converted
FROM anchor a
WHERE NOT EXISTS (SELECT 1 FROM classified w
                  WHERE w.organization_id = a.organization_id AND w.activity_type = 'worker'
                    AND w.event_timestamp <= a.first_shift_created_at + INTERVAL 48 HOUR)
""", "classified")

# ---------------------------------------------------------------- streaming and sinks
# A stream run with availableNow stops at its final watermark (max event time
# minus the 1-hour delay; for the join, the minimum over both inputs).  Rows
# the batch form would produce but the watermark has not closed are not
# emitted, so the oracles apply the same cut.

oracle("stream_dedup", "SELECT * FROM dedup", "dedup")

oracle("stream_activity_by_day", f"""
SELECT date_trunc('day', event_timestamp) AS day_start,
       date_trunc('day', event_timestamp) + INTERVAL 1 DAY AS day_end,
       organization_id, activity_type, COUNT(*) AS n_events
FROM classified
GROUP BY 1, 2, 3, 4
HAVING date_trunc('day', event_timestamp) + INTERVAL 1 DAY
       <= (SELECT max(event_timestamp) FROM classified) - INTERVAL 1 HOUR
""", "classified")

_worker_in = _in_list(WORKER_NAMES)
oracle("stream_onboarding_nudge", f"""
WITH shifts AS (SELECT organization_id, event_timestamp AS shift_ts FROM classified
                WHERE activity_name = 'Scheduling.Shift.Created'),
     workers AS (SELECT organization_id, event_timestamp AS worker_ts FROM classified
                 WHERE activity_name IN ({_worker_in})),
     wm AS (SELECT least((SELECT max(shift_ts) FROM shifts), (SELECT max(worker_ts) FROM workers))
                   - INTERVAL 1 HOUR AS w)
SELECT s.organization_id, min(s.shift_ts) AS first_unanswered_shift_at,
       min(s.shift_ts) + INTERVAL 48 HOUR AS nudge_due_at
FROM shifts s, wm
WHERE s.shift_ts + INTERVAL 48 HOUR < wm.w
  AND NOT EXISTS (SELECT 1 FROM workers k WHERE k.organization_id = s.organization_id
                  AND k.worker_ts >= s.shift_ts AND k.worker_ts <= s.shift_ts + INTERVAL 48 HOUR)
GROUP BY s.organization_id
""", "classified")

ORACLES["write_mart"] = ORACLES["mart_worker_adoption"]

oracle("read_events", "SELECT * FROM raw", "__fixture__")
oracle("read_events_mixed_headers", "SELECT * FROM raw", "__fixture__")

# Streams over time-ordered files end at the same watermark as one batch over all of them.
ORACLES["stream_activity_batches"] = ORACLES["stream_activity_by_day"]
ORACLES["stream_nudge_once"] = ORACLES["stream_onboarding_nudge"]
oracle("stream_activity_chained", """
SELECT date_trunc('day', event_timestamp) AS day_start,
       date_trunc('day', event_timestamp) + INTERVAL 1 DAY AS day_end,
       organization_id, activity_type, COUNT(*) AS n_events
FROM classified
GROUP BY 1, 2, 3, 4
HAVING date_trunc('day', event_timestamp) + INTERVAL 1 DAY
       <= (SELECT max(event_timestamp) FROM raw) - INTERVAL 1 HOUR
""", "classified")
ORACLES["mart_refreshed"] = ORACLES["mart_worker_adoption"]
