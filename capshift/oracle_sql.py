"""DuckDB SQL that recomputes each named query straight from the driver tables.

Written independently of the Spark code: typed columns are computed directly
(no JSON round trip), lookups are plain joins, and the replay is a brute-force
grid of every capacity and tick. Parameters are those of the fixture at
any scale (look-back 12 h).
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-22 00:00:00'"
LOOKBACK = "INTERVAL 12 HOUR"
LOOK_US = 12 * 3600 * 1_000_000
STEP_US = 6 * 3600 * 1_000_000


def prefix(policy: str = "P1") -> str:
    nation = {"P1": 0, "P2": 2}[policy]
    return f"""
WITH
tgt AS (SELECT CAST(min(c_custkey) AS VARCHAR) AS ws FROM customer WHERE c_nationkey = {nation}),
ev AS (
  SELECT ts AS time, CAST(user_id % 25 AS VARCHAR) AS capacity_id, value * 1000 AS capacity_unit_ms,
         CASE WHEN k = 0 THEN 0.0 ELSE CAST(8 + k % 8 AS DOUBLE) END AS base_capacity_units,
         CASE WHEN event_type IN ('click', 'view', 'purchase') THEN value ELSE 0.0 END AS utilization_interactive,
         CAST(k AS DOUBLE) AS utilization_background
  FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
evm AS (
  SELECT *, capacity_unit_ms / NULLIF(base_capacity_units * 1000 * 30, 0) AS utilization,
         utilization_interactive / NULLIF(utilization_background + utilization_interactive, 0) AS interactive_share
  FROM ev),
recent AS (SELECT * FROM evm WHERE time >= {AS_OF} - {LOOKBACK} AND time <= {AS_OF}),
peaks AS (
  SELECT capacity_id, greatest(coalesce(max(utilization), 0.0), 0.0) AS peak_utilization,
         count(*) AS n_events, count(*) FILTER (WHERE utilization IS NULL) AS n_unmeasured
  FROM recent WHERE capacity_id IS NOT NULL GROUP BY capacity_id),
workspaces AS (
  SELECT CAST(c_custkey AS VARCHAR) AS workspace_id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS capacity_id
  FROM customer),
datasets AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS dataset_id, 'model_' || CAST(o_orderkey % 997 AS VARCHAR) AS name,
         CAST(o_custkey AS VARCHAR) AS workspace_id
  FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL
  SELECT CAST(d + 1000000000 AS VARCHAR), 'model_' || CAST(d % 997 AS VARCHAR) || '_LB', (SELECT ws FROM tgt)
  FROM (SELECT DISTINCT o_orderkey - o_orderkey % 3 AS d FROM orders WHERE o_orderkey % 14 = 0)),
reports AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS report_id, CAST(o_custkey AS VARCHAR) AS workspace_id,
         CAST(o_orderkey - o_orderkey % 3 + CASE WHEN o_orderkey % 14 = 0 THEN 1000000000 ELSE 0 END AS VARCHAR)
           AS dataset_id
  FROM orders),
watched AS (
  SELECT '{policy}' AS policy_id, CAST(o_orderkey AS VARCHAR) AS report_id FROM orders
  UNION ALL
  SELECT '{policy}', CAST(o_orderkey + 2000000000 AS VARCHAR) FROM orders WHERE o_orderkey % 700 = 0),
state AS (
  SELECT CAST(o_orderkey - o_orderkey % 3 AS VARCHAR) AS initial_dataset_id,
         CAST(o_custkey AS VARCHAR) AS report_workspace_id, CAST(o_orderkey AS VARCHAR) AS report_id,
         CAST(o_orderkey - o_orderkey % 3 + 1000000000 AS VARCHAR) AS target_dataset_id,
         (SELECT ws FROM tgt) AS target_workspace_id, TIMESTAMP '2024-01-15 00:00:00' AS created_at
  FROM orders WHERE o_orderkey % 14 = 0),
ctx AS (
  SELECT '{policy}' AS policy_id, CAST(0.5 AS DOUBLE) AS move_threshold, CAST(0.3 AS DOUBLE) AS recovery_threshold,
         t.ws AS target_workspace_id, w.capacity_id AS target_capacity_id,
         greatest(coalesce(p.peak_utilization, 0.0), 0.0) AS target_peak,
         CAST(0.8 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS gate_threshold,
         greatest(coalesce(p.peak_utilization, 0.0), 0.0) > CAST(0.8 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS overloaded
  FROM tgt t JOIN workspaces w ON w.workspace_id = t.ws LEFT JOIN peaks p ON p.capacity_id = w.capacity_id),
rec AS (
  SELECT wt.policy_id, wt.report_id, r.workspace_id AS report_workspace_id, s.target_dataset_id,
         s.initial_dataset_id, d.workspace_id AS initial_workspace_id, w.capacity_id AS initial_capacity_id,
         greatest(coalesce(p.peak_utilization, 0.0), 0.0) AS initial_peak
  FROM watched wt JOIN state s ON s.report_id = wt.report_id
  JOIN ctx c ON c.policy_id = wt.policy_id
  LEFT JOIN datasets d ON d.dataset_id = s.initial_dataset_id
  LEFT JOIN workspaces w ON w.workspace_id = d.workspace_id
  LEFT JOIN peaks p ON p.capacity_id = w.capacity_id
  LEFT JOIN reports r ON r.report_id = wt.report_id
  WHERE w.capacity_id IS NOT NULL AND greatest(coalesce(p.peak_utilization, 0.0), 0.0) < c.recovery_threshold),
remaining AS (
  SELECT wt.* FROM watched wt
  WHERE NOT EXISTS (SELECT 1 FROM rec WHERE rec.policy_id = wt.policy_id AND rec.report_id = wt.report_id)),
mv AS (
  SELECT m.policy_id, m.report_id,
         CASE WHEN c.overloaded THEN 'TARGET_OVERLOADED'
              WHEN w.capacity_id IS NULL THEN 'UNRESOLVED'
              WHEN w.capacity_id = c.target_capacity_id THEN 'SAME_CAPACITY'
              WHEN greatest(coalesce(p.peak_utilization, 0.0), 0.0) > c.move_threshold THEN 'MOVE'
              ELSE 'LOW_UTILIZATION' END AS decision,
         r.workspace_id AS report_workspace_id, r.dataset_id, d.name AS dataset_name,
         d.workspace_id AS dataset_workspace_id, w.capacity_id,
         CASE WHEN w.capacity_id IS NOT NULL THEN greatest(coalesce(p.peak_utilization, 0.0), 0.0) END
           AS utilization,
         c.target_workspace_id, c.target_capacity_id
  FROM remaining m JOIN ctx c ON c.policy_id = m.policy_id
  LEFT JOIN reports r ON r.report_id = m.report_id
  LEFT JOIN datasets d ON d.dataset_id = r.dataset_id
  LEFT JOIN workspaces w ON w.workspace_id = d.workspace_id
  LEFT JOIN peaks p ON p.capacity_id = w.capacity_id),
dec AS (
  SELECT policy_id, report_id, 'RECOVER' AS decision, report_workspace_id, initial_capacity_id AS capacity_id,
         initial_peak AS utilization, initial_workspace_id AS target_workspace_id,
         initial_capacity_id AS target_capacity_id FROM rec
  UNION ALL
  SELECT policy_id, report_id, decision, report_workspace_id, capacity_id, utilization, target_workspace_id,
         target_capacity_id FROM mv),
cp AS (
  SELECT m.policy_id, m.report_id, m.dataset_id AS source_dataset_id, m.dataset_workspace_id AS source_workspace_id,
         m.dataset_name || '_LB' AS target_dataset_name, m.target_workspace_id,
         (SELECT min(d.dataset_id) FROM datasets d
           WHERE d.workspace_id = m.target_workspace_id AND d.name = m.dataset_name || '_LB') AS existing_copy_id
  FROM mv m WHERE m.decision = 'MOVE'),
act AS (
  SELECT policy_id, 'RECOVER' AS action, report_id, report_workspace_id, target_dataset_id AS source_dataset_id,
         CAST(NULL AS VARCHAR) AS target_dataset_name, initial_dataset_id AS target_dataset_id,
         initial_workspace_id AS target_workspace_id, initial_peak AS utilization FROM rec
  UNION ALL
  SELECT m.policy_id, 'MOVE', m.report_id, m.report_workspace_id, c.source_dataset_id, c.target_dataset_name,
         c.existing_copy_id, c.target_workspace_id, m.utilization
  FROM mv m JOIN cp c ON c.policy_id = m.policy_id AND c.report_id = m.report_id),
moved AS (
  SELECT DISTINCT policy_id, source_dataset_id, source_workspace_id, target_dataset_name, target_workspace_id,
         existing_copy_id AS target_dataset_id FROM cp),
gate AS (
  SELECT c.policy_id, c.target_workspace_id, c.target_capacity_id, c.target_peak, c.gate_threshold, c.overloaded,
         (SELECT count(*) FROM remaining m WHERE m.policy_id = c.policy_id) AS n_remaining
  FROM ctx c),
bind AS (
SELECT m.policy_id, m.source_dataset_id, m.target_workspace_id, m.target_dataset_name, m.target_dataset_id,
       ds.datasource_id, c.connectivity_type, c.gateway_id, c.path, c.type,
       CASE WHEN c.gateway_id IS NULL
         THEN json_object('connectionBinding', json_object('id', ds.datasource_id,
                'connectivityType', c.connectivity_type,
                'connectionDetails', json_object('path', c.path, 'type', c.type)))
         ELSE json_object('connectionBinding', json_object('id', ds.datasource_id,
                'connectivityType', c.connectivity_type,
                'connectionDetails', json_object('path', c.path, 'type', c.type), 'gatewayId', c.gateway_id))
       END::VARCHAR AS payload
FROM moved m
JOIN (SELECT DISTINCT CAST(l_orderkey - l_orderkey % 3 AS VARCHAR) AS dataset_id, CAST(l_suppkey AS VARCHAR) AS datasource_id
      FROM lineitem) ds ON ds.dataset_id = m.source_dataset_id
LEFT JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS datasource_id,
                  CASE WHEN s_nationkey % 5 = 0 THEN 'Cloud' ELSE 'Gateway' END
                    AS connectivity_type,
                  CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE CAST(s_nationkey AS VARCHAR) END AS gateway_id,
                  s_name AS path, 'SQL' AS type FROM supplier) c ON c.datasource_id = ds.datasource_id),
sched AS (
SELECT m.policy_id, m.source_dataset_id, m.target_workspace_id, m.target_dataset_name, m.target_dataset_id,
       s.days[1] || ',' || s.days[2] AS days, s.times[1] || ',' || s.times[2] AS times, 'UTC' AS local_time_zone_id,
       true AS enabled,
       json_object('value', json_object('enabled', true, 'days', s.days, 'times', s.times,
                   'localTimeZoneId', 'UTC'))::VARCHAR AS payload
FROM moved m
JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS dataset_id,
             [dayname(o_orderdate), dayname(o_orderdate + INTERVAL 3 DAY)] AS days,
             [printf('%02d:00', o_orderkey % 24), printf('%02d:30', (o_orderkey + 7) % 24)] AS times
      FROM orders WHERE o_orderkey % 3 = 0) s ON s.dataset_id = m.source_dataset_id),
cpol AS (
  SELECT 'C' || CAST(c_custkey AS VARCHAR) AS policy_id,
         CASE c_custkey % 8 WHEN 1 THEN c_name WHEN 2 THEN c_name || '_LB' WHEN 4 THEN c_name ELSE '' END
           AS workspace_name,
         CASE WHEN c_custkey % 8 IN (2, 3, 5) THEN CAST(c_nationkey AS VARCHAR) ELSE '' END AS capacity_to_deploy,
         CASE WHEN c_custkey % 8 IN (0, 3, 4) THEN CAST(c_custkey AS VARCHAR)
              WHEN c_custkey % 8 = 7 THEN CAST(c_custkey + 2000000000 AS VARCHAR) ELSE '' END AS target_workspace,
         round(abs(c_acctbal) / 10000, 2) AS move_threshold,
         CASE WHEN c_custkey % 9 = 0 THEN round(abs(c_acctbal) / 10000, 2) + 0.1
              ELSE round(round(abs(c_acctbal) / 10000, 2) * 0.8, 2) END AS recovery_threshold
  FROM customer)
"""


def _q(body: str, policy: str = "P1") -> str:
    return prefix(policy) + body


def _weekly_runs() -> str:
    """Four runs, one after each week's events; what a run needs of the state is who is in it and from which dataset."""
    def zero(x):
        return f"greatest(coalesce({x}, 0.0), 0.0)"

    sql = """
, wk AS (SELECT *, least(greatest(floor(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', time) / 604800.0), 0), 3) AS w FROM evm),
rs0 AS (SELECT report_id, initial_dataset_id FROM state)"""
    for k in range(4):
        sql += f""",
at{k} AS (SELECT max(time) AS t FROM wk WHERE w <= {k}),
pk{k} AS (
  SELECT capacity_id, {zero("max(utilization)")} AS peak FROM wk
  WHERE w <= {k} AND time >= (SELECT t FROM at{k}) - {LOOKBACK} AND time <= (SELECT t FROM at{k}) GROUP BY capacity_id),
tick{k} AS (
  SELECT wt.policy_id, wt.report_id, c.target_workspace_id, c.target_capacity_id, r.workspace_id AS report_workspace_id,
         r.dataset_id, d.name AS dataset_name, w.capacity_id, s.initial_dataset_id,
         CASE WHEN w.capacity_id IS NOT NULL THEN {zero("p.peak")} END AS utilization,
         hd.workspace_id AS home_ws, hw.capacity_id AS home_cap, {zero("hp.peak")} AS home_peak,
         hw.capacity_id IS NOT NULL AND {zero("hp.peak")} < c.recovery_threshold AS recover,
         {zero("tp.peak")} > CAST(0.8 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS overloaded, c.move_threshold
  FROM watched wt JOIN ctx c ON c.policy_id = wt.policy_id
  LEFT JOIN pk{k} tp ON tp.capacity_id = c.target_capacity_id
  LEFT JOIN reports r ON r.report_id = wt.report_id LEFT JOIN datasets d ON d.dataset_id = r.dataset_id
  LEFT JOIN workspaces w ON w.workspace_id = d.workspace_id LEFT JOIN pk{k} p ON p.capacity_id = w.capacity_id
  LEFT JOIN rs{k} s ON s.report_id = wt.report_id LEFT JOIN datasets hd ON hd.dataset_id = s.initial_dataset_id
  LEFT JOIN workspaces hw ON hw.workspace_id = hd.workspace_id LEFT JOIN pk{k} hp ON hp.capacity_id = hw.capacity_id),
dec{k} AS (
  SELECT *, CASE WHEN recover THEN 'RECOVER' WHEN overloaded THEN 'TARGET_OVERLOADED'
                 WHEN capacity_id IS NULL THEN 'UNRESOLVED' WHEN capacity_id = target_capacity_id THEN 'SAME_CAPACITY'
                 WHEN utilization > move_threshold THEN 'MOVE' ELSE 'LOW_UTILIZATION' END AS decision FROM tick{k}),
mvd{k} AS (
  SELECT report_id, dataset_id FROM dec{k} t WHERE decision = 'MOVE' AND EXISTS (
    SELECT 1 FROM datasets d WHERE d.workspace_id = t.target_workspace_id AND d.name = t.dataset_name || '_LB')),
rs{k + 1} AS (
  SELECT coalesce(o.report_id, n.report_id) AS report_id, coalesce(o.initial_dataset_id, n.dataset_id) AS initial_dataset_id
  FROM (SELECT * FROM rs{k} WHERE report_id NOT IN (SELECT report_id FROM dec{k} WHERE recover)) o
  FULL OUTER JOIN mvd{k} n ON n.report_id = o.report_id)"""
    parts = [f"""
SELECT CAST({k + 1} AS BIGINT) AS run_number, (SELECT t FROM at{k}) AS as_of, policy_id, report_id, decision, report_workspace_id,
       CASE WHEN recover THEN home_cap ELSE capacity_id END AS capacity_id,
       CASE WHEN recover THEN home_peak ELSE utilization END AS utilization,
       CASE WHEN recover THEN home_ws ELSE target_workspace_id END AS target_workspace_id,
       CASE WHEN recover THEN home_cap ELSE target_capacity_id END AS target_capacity_id FROM dec{k}""" for k in range(4)]
    return sql + " UNION ALL ".join(parts)


REPLAY = f"""
, evu AS (SELECT capacity_id, utilization, epoch_us(time) AS t_us FROM evm
          WHERE time IS NOT NULL AND capacity_id IS NOT NULL),
bounds AS (SELECT min((t_us + {STEP_US - 1}) // {STEP_US}) AS k0, max((t_us + {LOOK_US}) // {STEP_US}) AS k1 FROM evu),
ticks AS (SELECT unnest(generate_series(k0, k1)) AS k FROM bounds),
caps AS (SELECT DISTINCT capacity_id FROM evu),
grid AS (SELECT c.capacity_id, t.k FROM caps c CROSS JOIN ticks t),
pk AS (SELECT g.capacity_id, g.k, greatest(coalesce(max(e.utilization), 0.0), 0.0) AS peak, count(e.t_us) AS n
       FROM grid g LEFT JOIN evu e
         ON e.capacity_id = g.capacity_id AND e.t_us BETWEEN g.k * {STEP_US} - {LOOK_US} AND g.k * {STEP_US}
       GROUP BY g.capacity_id, g.k),
tcap AS (SELECT target_capacity_id AS capacity_id FROM ctx),
tp AS (SELECT k, peak AS target_peak FROM pk WHERE capacity_id = (SELECT capacity_id FROM tcap)),
mk AS (SELECT p.capacity_id, p.k, p.peak, tp.target_peak, p.n,
              CASE WHEN p.peak > 0.5 AND tp.target_peak <= CAST(0.8 AS DOUBLE) * CAST(0.5 AS DOUBLE) THEN 1
                   WHEN p.peak < 0.3 THEN 0 END AS marker
       FROM pk p JOIN tp ON tp.k = p.k WHERE p.capacity_id <> (SELECT capacity_id FROM tcap)),
st AS (SELECT *, coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY capacity_id ORDER BY k
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state FROM mk)
"""

ORACLE: dict[str, str] = {
    "events_scan": _q("""
SELECT ts AS time,
       json_object('capacityId', CAST(user_id % 25 AS VARCHAR), 'capacityUnitMs', value * 1000,
                   'baseCapacityUnits', CASE WHEN k = 0 THEN 0.0 ELSE CAST(8 + k % 8 AS DOUBLE) END,
                   'utilizationInteractive',
                   CASE WHEN event_type IN ('click', 'view', 'purchase') THEN value ELSE 0.0 END,
                   'utilizationBackground', CAST(k AS DOUBLE))::VARCHAR AS data
FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""),
    "events_parsed": _q("""
SELECT time, capacity_id, capacity_unit_ms, base_capacity_units, utilization_interactive, utilization_background
FROM ev"""),
    "events_recent": _q("""
SELECT time, capacity_id, capacity_unit_ms, base_capacity_units, utilization_interactive, utilization_background
FROM recent"""),
    "utilization": _q("SELECT time, capacity_id, utilization FROM evm"),
    "interactive_share": _q("SELECT time, capacity_id, interactive_share FROM evm"),
    "capacity_peak": _q("SELECT capacity_id, peak_utilization, n_events, n_unmeasured FROM peaks"),
    "capacity_peak_interactive": _q("""
SELECT capacity_id, greatest(coalesce(max(interactive_share), 0.0), 0.0) AS peak_utilization, count(*) AS n_events,
       count(*) FILTER (WHERE interactive_share IS NULL) AS n_unmeasured
FROM recent WHERE capacity_id IS NOT NULL GROUP BY capacity_id"""),
    "capacity_peak_named": _q("""
SELECT capacity_id, peak_utilization, n_events, n_unmeasured FROM peaks WHERE capacity_id IN ('0', '2')"""),
    "rolling_peak": _q(f"""
SELECT capacity_id, time, utilization,
       greatest(coalesce(max(utilization) OVER (PARTITION BY capacity_id ORDER BY time
                RANGE BETWEEN {LOOKBACK} PRECEDING AND CURRENT ROW), 0.0), 0.0) AS rolling_peak
FROM evm WHERE time IS NOT NULL AND capacity_id IS NOT NULL"""),
    "watched_reports": _q("SELECT policy_id, report_id FROM watched"),
    "normalized_ids": _q("""
SELECT policy_id, CASE report_id_n % 3 WHEN 1 THEN ' ' || report_id WHEN 2 THEN report_id || chr(9) || chr(10)
                  ELSE report_id END AS raw_id, report_id
FROM (SELECT policy_id, report_id, CAST(report_id AS BIGINT) AS report_id_n FROM watched)"""),
    "report_lineage": _q("""
SELECT wt.policy_id, wt.report_id, r.workspace_id AS report_workspace_id, r.dataset_id, d.name AS dataset_name,
       d.workspace_id AS dataset_workspace_id, w.capacity_id
FROM watched wt LEFT JOIN reports r ON r.report_id = wt.report_id
LEFT JOIN datasets d ON d.dataset_id = r.dataset_id
LEFT JOIN workspaces w ON w.workspace_id = d.workspace_id"""),
    "workspace_by_name": _q("""
SELECT p.policy_id, p.workspace_name, n.found_workspace_id
FROM cpol p LEFT JOIN (SELECT name, min(workspace_id) AS found_workspace_id FROM workspaces GROUP BY name) n
  ON n.name = p.workspace_name"""),
    "copy_lookup": _q("""
SELECT policy_id, report_id, source_dataset_id, source_workspace_id, target_dataset_name, target_workspace_id,
       existing_copy_id FROM cp"""),
    "policy_check": _q("""
SELECT policy_id, CAST(len(errs) AS INTEGER) AS n_errors, array_to_string(errs, ',') AS errors,
       len(errs) = 0 AS is_valid
FROM (SELECT policy_id, list_filter([
        CASE WHEN capacity_to_deploy <> '' AND target_workspace <> '' THEN 'CAPACITY_AND_TARGET' END,
        CASE WHEN workspace_name <> '' AND target_workspace <> '' THEN 'NAME_AND_TARGET' END,
        CASE WHEN capacity_to_deploy <> '' AND workspace_name = '' THEN 'CAPACITY_WITHOUT_NAME' END,
        CASE WHEN workspace_name = '' AND target_workspace = '' THEN 'NO_NAME_NO_TARGET' END,
        CASE WHEN NOT coalesce(recovery_threshold < move_threshold, false) THEN 'RECOVERY_NOT_BELOW_MOVE' END
      ], lambda x: x IS NOT NULL) AS errs FROM cpol)"""),
    "resolve_target": _q("""
SELECT policy_id, target_workspace_id, target_capacity_id,
       CASE WHEN target_capacity_id IS NULL THEN 'UNRESOLVED' ELSE resolution END AS resolution
FROM (
  SELECT p.policy_id, t.target_workspace_id, t.resolution,
         CASE WHEN t.resolution = 'CREATE' THEN p.capacity_to_deploy ELSE w.capacity_id END AS target_capacity_id
  FROM cpol p
  JOIN (
    SELECT p.policy_id,
           CASE WHEN p.target_workspace <> '' THEN p.target_workspace ELSE n.found END AS target_workspace_id,
           CASE WHEN p.target_workspace <> '' THEN 'EXPLICIT' WHEN n.found IS NOT NULL THEN 'BY_NAME'
                WHEN p.workspace_name <> '' AND p.capacity_to_deploy <> '' THEN 'CREATE'
                ELSE 'UNRESOLVED' END AS resolution
    FROM cpol p LEFT JOIN (SELECT name, min(workspace_id) AS found FROM workspaces GROUP BY name) n
      ON n.name = p.workspace_name) t ON t.policy_id = p.policy_id
  LEFT JOIN workspaces w ON w.workspace_id = t.target_workspace_id)"""),
    "repoint_lookup": _q("""
SELECT wt.policy_id, wt.report_id, s.initial_dataset_id IS NOT NULL AS in_state, s.initial_dataset_id,
       s.target_dataset_id, s.target_workspace_id AS state_target_workspace_id
FROM watched wt LEFT JOIN state s ON s.report_id = wt.report_id"""),
    "repointed_ids": _q("SELECT DISTINCT report_id FROM state"),
    "recoveries": _q("""
SELECT policy_id, report_id, report_workspace_id, target_dataset_id, initial_dataset_id, initial_workspace_id,
       initial_capacity_id, initial_peak FROM rec"""),
    "remaining_reports": _q("SELECT policy_id, report_id FROM remaining"),
    "target_gate": _q("""
SELECT policy_id, target_workspace_id, target_capacity_id, target_peak, gate_threshold, overloaded, n_remaining,
       overloaded AND n_remaining > 0 AS raise_alert FROM gate"""),
    "move_decisions": _q("SELECT * FROM mv"),
    "decisions": _q("SELECT * FROM dec"),
    "decisions_alt_target": _q("SELECT * FROM dec", "P2"),
    "repoint_upsert": _q(f"""
SELECT coalesce(o.initial_dataset_id, n.source_dataset_id) AS initial_dataset_id,
       CASE WHEN n.report_id IS NOT NULL THEN n.report_workspace_id ELSE o.report_workspace_id END
         AS report_workspace_id,
       coalesce(o.report_id, n.report_id) AS report_id,
       CASE WHEN n.report_id IS NOT NULL THEN n.target_dataset_id ELSE o.target_dataset_id END AS target_dataset_id,
       CASE WHEN n.report_id IS NOT NULL THEN n.target_workspace_id ELSE o.target_workspace_id END
         AS target_workspace_id,
       CASE WHEN n.report_id IS NOT NULL THEN {AS_OF} ELSE o.created_at END AS created_at
FROM (SELECT * FROM state WHERE report_id NOT IN (SELECT report_id FROM rec)) o
FULL OUTER JOIN (SELECT * FROM act WHERE action = 'MOVE' AND target_dataset_id IS NOT NULL) n ON n.report_id = o.report_id"""),
    "repoint_delete": _q("""
SELECT initial_dataset_id, report_workspace_id, report_id, target_dataset_id, target_workspace_id, created_at
FROM state WHERE report_id NOT IN (SELECT report_id FROM rec)"""),
    "alerts": _q(f"""
SELECT 'Target workspace ' || coalesce(target_workspace_id, 'unknown') || ' is on overloaded capacity '
         || coalesce(target_capacity_id, 'unknown') || ' - consider another target' AS alert,
       {AS_OF} AS timestamp, target_peak AS operation, policy_id
FROM gate WHERE overloaded AND n_remaining > 0""", "P2"),
    "alerts_csv": _q(f"""
SELECT 'Target workspace ' || coalesce(target_workspace_id, 'unknown') || ' is on overloaded capacity '
         || coalesce(target_capacity_id, 'unknown') || ' - consider another target' AS alert,
       {AS_OF} AS timestamp, target_peak AS operation
FROM gate WHERE overloaded AND n_remaining > 0""", "P2"),
    "state_table": _q("""
SELECT initial_dataset_id, report_workspace_id, report_id, target_dataset_id, target_workspace_id, created_at
FROM state WHERE report_id NOT IN (SELECT report_id FROM rec)"""),
    "decision_log": _q(f"""
SELECT {AS_OF} AS timestamp, 'fixture-P1' AS run_id, kind, policy_id, report_id, capacity_id, value, message
FROM (
  SELECT 'CONSUMPTION' AS kind, NULL AS policy_id, NULL AS report_id, capacity_id, peak_utilization AS value,
         'peak utilisation measured for capacity ' || coalesce(capacity_id, 'unknown') AS message FROM peaks
  UNION ALL
  SELECT 'CHECKING', policy_id, report_id, NULL, NULL,
         'report ' || coalesce(report_id, 'unknown') || ' is under review, its workspace is '
           || coalesce(report_workspace_id, 'unknown') FROM dec
  UNION ALL
  SELECT 'NOT_IN_CACHE', wt.policy_id, wt.report_id, NULL, NULL,
         'report ' || wt.report_id || ' has no repoint to undo'
  FROM watched wt WHERE wt.report_id NOT IN (SELECT report_id FROM state)
  UNION ALL
  SELECT 'REPOINT_BACK', policy_id, report_id, capacity_id, utilization,
         'report ' || report_id || ' goes back home to workspace ' || coalesce(target_workspace_id, 'unknown')
  FROM dec WHERE decision = 'RECOVER'
  UNION ALL
  SELECT 'TARGET_OVERLOADED', policy_id, NULL, target_capacity_id, target_peak,
         'no move: target workspace ' || coalesce(target_workspace_id, 'unknown') || ' on capacity '
           || coalesce(target_capacity_id, 'unknown') || ' is above headroom'
  FROM gate WHERE overloaded AND n_remaining > 0
  UNION ALL
  SELECT decision, policy_id, report_id, capacity_id, utilization,
         'report ' || report_id || CASE decision
            WHEN 'SAME_CAPACITY' THEN ' already runs on the target capacity'
            WHEN 'LOW_UTILIZATION' THEN ' stays: its capacity is not above the move threshold'
            WHEN 'UNRESOLVED' THEN ' could not be traced to a capacity' END
  FROM dec WHERE decision IN ('SAME_CAPACITY', 'LOW_UTILIZATION', 'UNRESOLVED')
  UNION ALL
  SELECT 'REPOINTED', policy_id, report_id, NULL, utilization,
         'report ' || report_id || ' rebinds to dataset ' || coalesce(target_dataset_id, '(new copy)')
           || ' in workspace ' || coalesce(target_workspace_id, 'unknown')
  FROM act
  UNION ALL
  SELECT 'CONNECTION', policy_id, NULL, NULL, NULL,
         'dataset ' || coalesce(target_dataset_id, '(new copy)') || ' binds datasource ' || datasource_id || ' at '
           || coalesce(path, 'unknown')
  FROM bind)"""),
    "action_table": _q("""
SELECT *, CASE WHEN target_dataset_id IS NULL THEN 'PENDING' ELSE 'READY' END AS status,
       json_object('datasetId', coalesce(target_dataset_id, '${dataset:' || target_workspace_id || '/' || target_dataset_name
                                         || '}'))::VARCHAR AS payload FROM act"""),
    "workspace_plan": _q("""
, made AS (
  SELECT min(p.policy_id) AS policy_id, p.workspace_name, arg_min(p.capacity_to_deploy, p.policy_id) AS cap
  FROM cpol p WHERE p.workspace_name <> '' AND p.capacity_to_deploy <> '' AND p.target_workspace = ''
    AND p.recovery_threshold < p.move_threshold
    AND NOT EXISTS (SELECT 1 FROM workspaces w WHERE w.name = p.workspace_name) GROUP BY p.workspace_name)
SELECT policy_id, 1 AS step, 'CREATE_WORKSPACE' AS request, CAST(NULL AS VARCHAR) AS report_id,
       CAST(NULL AS VARCHAR) AS source_dataset_id, 'workspace:' || workspace_name AS makes,
       CAST(NULL AS VARCHAR) AS waits_for, 'READY' AS status, json_object('name', workspace_name)::VARCHAR AS payload FROM made
UNION ALL
SELECT policy_id, 2, 'ASSIGN_CAPACITY', NULL, NULL, NULL, 'workspace:' || workspace_name, 'PENDING',
       json_object('capacityMigrationAssignments', [json_object('targetCapacityObjectId', cap, 'workspacesToAssign',
                   ['${workspace:' || workspace_name || '}'])])::VARCHAR FROM made"""),
    "work_plan": _q("""
, ref AS (
  SELECT *, 'dataset:' || target_workspace_id || '/' || target_dataset_name AS key,
         CASE WHEN target_dataset_id IS NULL THEN 'PENDING' ELSE 'READY' END AS status,
         coalesce(target_dataset_id, '${dataset:' || target_workspace_id || '/' || target_dataset_name || '}') AS ds FROM moved)
SELECT policy_id, 3 AS step, 'COPY_DATASET' AS request, CAST(NULL AS VARCHAR) AS report_id, source_dataset_id, key AS makes,
       CAST(NULL AS VARCHAR) AS waits_for, 'READY' AS status,
       json_object('sourceWorkspaceId', source_workspace_id, 'sourceDatasetId', source_dataset_id,
                   'targetWorkspaceId', target_workspace_id, 'targetName', target_dataset_name)::VARCHAR AS payload FROM ref
UNION ALL
SELECT r.policy_id, 4, 'BIND_CONNECTION', NULL, r.source_dataset_id, NULL, r.key, r.status,
       json_object('workspaceId', r.target_workspace_id, 'datasetId', r.ds, 'body', b.payload)::VARCHAR
FROM ref r JOIN bind b ON b.policy_id = r.policy_id AND b.source_dataset_id = r.source_dataset_id
UNION ALL
SELECT r.policy_id, 5, 'SET_SCHEDULE', NULL, r.source_dataset_id, NULL, r.key, r.status,
       json_object('workspaceId', r.target_workspace_id, 'datasetId', r.ds, 'body', s.payload)::VARCHAR
FROM ref r JOIN sched s ON s.policy_id = r.policy_id AND s.source_dataset_id = r.source_dataset_id
UNION ALL
SELECT policy_id, 6, 'REBIND_REPORT', report_id, source_dataset_id, NULL,
       CASE WHEN action = 'MOVE' THEN 'dataset:' || target_workspace_id || '/' || target_dataset_name END,
       CASE WHEN target_dataset_id IS NULL THEN 'PENDING' ELSE 'READY' END,
       json_object('workspaceId', report_workspace_id, 'reportId', report_id, 'datasetId',
                   coalesce(target_dataset_id, '${dataset:' || target_workspace_id || '/' || target_dataset_name || '}'))::VARCHAR
FROM act"""),
    "connection_bindings": _q("SELECT * FROM bind"),
    "refresh_plan": _q("SELECT * FROM sched"),
    "pick_target": _q("""
, cap AS (SELECT policy_id, capacity_id, max(utilization) AS peak, count(*) AS n,
                 count(*) FILTER (decision IN ('MOVE', 'TARGET_OVERLOADED') AND utilization > 0.5) AS movers
          FROM mv WHERE capacity_id IS NOT NULL GROUP BY policy_id, capacity_id),
src AS (SELECT *, CAST(floor(peak / n * 1000000) AS BIGINT) AS load_units FROM cap WHERE movers > 0),
queue AS (SELECT *, coalesce(sum(load_units * movers) OVER (PARTITION BY policy_id ORDER BY peak DESC, capacity_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM src),
lined AS (
  SELECT m.policy_id, m.report_id, m.capacity_id, a.load_units, a.start + a.load_units * (row_number() OVER (
           PARTITION BY m.policy_id, m.capacity_id ORDER BY substr(md5(m.report_id), 1, 2), m.report_id) - 1) AS place
  FROM mv m JOIN queue a ON a.policy_id = m.policy_id AND a.capacity_id = m.capacity_id
  WHERE m.decision IN ('MOVE', 'TARGET_OVERLOADED') AND m.utilization > 0.5),
room AS (
  SELECT capacity_id, peak, sum(CAST(floor((gate - peak) * 1000000) AS BIGINT)) OVER (ORDER BY peak, capacity_id) AS up_to
  FROM (SELECT DISTINCT w.capacity_id, greatest(coalesce(p.peak_utilization, 0.0), 0.0) AS peak,
               CAST(0.8 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS gate
        FROM workspaces w LEFT JOIN peaks p ON p.capacity_id = w.capacity_id) WHERE peak <= gate)
SELECT l.policy_id, l.report_id, l.capacity_id, l.load_units,
       (SELECT arg_min(r.capacity_id, (r.peak, r.capacity_id)) FROM room r WHERE r.up_to > l.place) AS picked_capacity_id
FROM lined l""", "P2"),
    "hysteresis_replay": _q(REPLAY + f"""
SELECT capacity_id, make_timestamp(k * {STEP_US}) AS tick, peak AS peak_utilization, target_peak, marker, state FROM st"""),
    "report_replay": _q(REPLAY + f"""
, runs AS (
  SELECT capacity_id, min(k) AS from_k, max(k) AS to_k, state
  FROM (SELECT *, k - row_number() OVER (PARTITION BY capacity_id, state ORDER BY k) AS island FROM st)
  GROUP BY capacity_id, state, island),
homes AS (
  SELECT wt.report_id, coalesce(hw.capacity_id, w.capacity_id) AS capacity_id
  FROM watched wt LEFT JOIN reports r ON r.report_id = wt.report_id LEFT JOIN datasets d ON d.dataset_id = r.dataset_id
  LEFT JOIN workspaces w ON w.workspace_id = d.workspace_id LEFT JOIN state s ON s.report_id = wt.report_id
  LEFT JOIN datasets hd ON hd.dataset_id = s.initial_dataset_id LEFT JOIN workspaces hw ON hw.workspace_id = hd.workspace_id)
SELECT h.report_id, h.capacity_id, make_timestamp(r.from_k * {STEP_US}) AS from_tick, make_timestamp(r.to_k * {STEP_US}) AS to_tick,
       r.state FROM homes h JOIN runs r ON r.capacity_id = h.capacity_id"""),
    "stream_peak": _q("""
, win AS (
  SELECT e.capacity_id, e.utilization, time_bucket(INTERVAL 1 MINUTE, e.time) - j * INTERVAL 1 MINUTE AS ws
  FROM evm e, range(5) r(j) WHERE e.time IS NOT NULL AND e.capacity_id IS NOT NULL)
SELECT ws AS window_start, ws + INTERVAL 5 MINUTE AS window_end, capacity_id,
       greatest(coalesce(max(utilization), 0.0), 0.0) AS peak_utilization, count(*) AS n_events
FROM win
WHERE ws + INTERVAL 5 MINUTE <= (SELECT max(time) FROM evm) - INTERVAL 10 MINUTE
GROUP BY ws, capacity_id"""),
    "stream_hysteresis": _q("""
, sh AS (SELECT capacity_id, time, utilization,
               CASE WHEN utilization > 0.5 THEN 1 WHEN utilization < 0.3 THEN 0 END AS marker
         FROM evm WHERE time IS NOT NULL AND capacity_id IS NOT NULL),
s2 AS (SELECT *, coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY capacity_id
               ORDER BY time, utilization NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state
       FROM sh),
s3 AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY capacity_id ORDER BY time, utilization NULLS LAST), 0)
                 AS prev FROM s2)
SELECT capacity_id, time, CAST(state AS INTEGER) AS state FROM s3
WHERE state <> prev AND time <= date_trunc('milliseconds', (SELECT max(time) FROM evm)) - INTERVAL 10 MINUTE"""),
    "balance_stream": _q(_weekly_runs()),
}
