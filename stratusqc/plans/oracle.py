"""SQL twins of the domain views, for checking results in another engine."""

from __future__ import annotations

from stratusqc.constants import VARIABLES


def _mean(sensor: str) -> str:
    hit = f"event_type = '{sensor}'"
    return (
        f"CAST(sum(CASE WHEN {hit} THEN CAST(round(value * 100) AS BIGINT) END) AS DOUBLE)"
        f" / nullif(100.0 * count(*) FILTER (WHERE {hit}), 0) AS {sensor}_mean"
    )


READINGS = f"""
daily AS (
  SELECT user_id AS station_id, date_trunc('day', ts) AS day_ts,
         {", ".join(_mean(s) for s in ("view", "click", "purchase", "signup", "error"))}
  FROM events GROUP BY 1, 2),
readings AS (
  SELECT station_id * 100000 + CAST(date_diff('day', DATE '1970-01-01', CAST(day_ts AS DATE)) AS BIGINT) AS reading_id,
         station_id, CAST(day_ts AS TIMESTAMP) AS ts,
         view_mean AS temperature,
         CASE WHEN click_mean IS NOT NULL THEN least(click_mean, 100.0) END AS humidity,
         purchase_mean AS pressure, signup_mean AS wind_speed,
         (error_mean * 7) % 360 AS wind_direction,
         floor(view_mean / 120) * 10.0 AS rainfall,
         floor(click_mean / 60) * 50.0 AS solar_radiation
  FROM daily)"""

LONG = READINGS + ",\nreadings_long AS (" + " UNION ALL ".join(
    f"SELECT reading_id, station_id, ts, '{v}' AS variable, CAST({v} AS DOUBLE) AS value FROM readings" for v in VARIABLES
) + ")"

STATIONS = """
stations AS (
  SELECT station_id, 'ST' || station_id AS station_code, 'Station ' || station_id AS name,
         20.0::DOUBLE + 0.25::DOUBLE * (station_id % 40) AS latitude,
         70.0::DOUBLE + 0.25::DOUBLE * (station_id // 40) AS longitude,
         CAST((station_id * 13) % 900 AS DOUBLE) AS elevation_m,
         'State ' || (station_id % 7) AS state, 'District ' || (station_id % 23) AS district,
         DATE '2019-01-01' + CAST(station_id % 1500 AS INTEGER) AS install_date,
         CASE WHEN station_id % 29 = 0 THEN 'decommissioned' ELSE 'active' END AS status
  FROM (SELECT DISTINCT user_id AS station_id FROM events))"""

# Limits per station and variable, after the fall-back rules.
SPECS = """
specs AS (
  SELECT s.station_id, v.variable,
         CASE WHEN v.variable = 'temperature' AND s.station_id % 5 = 0 THEN -9999.0
              ELSE 0.0 END AS spec_min,
         CASE WHEN v.variable = 'temperature' AND s.station_id % 5 = 0 THEN 150.0
              WHEN v.variable = 'wind_direction' THEN 360.0
              WHEN v.variable = 'rainfall' AND s.station_id % 7 = 0 THEN 300.0
              ELSE 200.0 END AS spec_max,
         CASE WHEN v.variable = 'temperature' AND s.station_id % 5 = 0 THEN 9999.0
              WHEN v.variable = 'wind_direction' THEN 150.0
              WHEN v.variable = 'rainfall' AND s.station_id % 7 = 0 THEN 100.0
              ELSE 120.0 END AS step_max,
         CASE WHEN v.variable = 'temperature' AND s.station_id % 5 = 0 THEN 6
              WHEN v.variable = 'rainfall' AND s.station_id % 7 = 0 THEN 6
              ELSE 3 END AS persistence_max
  FROM stations s CROSS JOIN (VALUES %s) v(variable))""".replace("%s", ", ".join(f"('{v}')" for v in VARIABLES))

# Rule flags per value: windows over all readings of a station, missing values included.
RULES = """
stepped AS (
  SELECT l.*, p.spec_min, p.spec_max, p.step_max, p.persistence_max,
         lag(value) OVER w AS previous,
         row_number() OVER w AS pos
  FROM readings_long l JOIN specs p USING (station_id, variable)
  WINDOW w AS (PARTITION BY l.station_id, l.variable ORDER BY l.ts)),
flat AS (
  SELECT a.reading_id, a.variable, count(b.value) AS present, arg_min(b.value, b.pos) AS first_value,
         max(b.value) AS hi, min(b.value) AS lo
  FROM stepped a JOIN stepped b
    ON a.station_id = b.station_id AND a.variable = b.variable
   AND b.pos BETWEEN a.pos - a.persistence_max + 1 AND a.pos
  GROUP BY 1, 2),
flagged AS (
  SELECT s.*,
         CASE WHEN value IS NULL THEN NULL WHEN value < spec_min THEN 'below_min'
              WHEN value > spec_max THEN 'above_max' END AS violation,
         CASE WHEN s.variable = 'wind_direction'
              THEN least(abs(value - previous) % 360, 360 - abs(value - previous) % 360)
              ELSE abs(value - previous) END AS delta,
         coalesce(f.present = s.persistence_max AND hi - first_value < 1e-5 AND first_value - lo < 1e-5
           AND NOT (s.variable IN ('rainfall', 'solar_radiation') AND abs(hi) < 1e-5 AND abs(lo) < 1e-5), false) AS flat_fail,
         f.first_value
  FROM stepped s JOIN flat f USING (reading_id, variable)),
ruled AS (
  SELECT *,
         CASE WHEN violation IS NOT NULL THEN 'RULE_RANGE_FAIL'
              WHEN coalesce(delta > step_max, false) THEN 'RULE_STEP_FAIL'
              WHEN flat_fail THEN 'RULE_PERSISTENCE_FAIL'
              ELSE 'VALID_READING' END AS rule_reason
  FROM flagged)"""

KNN = """
xyz AS (
  SELECT station_id,
         6371.0 * cos(radians(latitude)) * cos(radians(longitude)) AS x,
         6371.0 * cos(radians(latitude)) * sin(radians(longitude)) AS y,
         6371.0 * sin(radians(latitude)) AS z
  FROM stations),
pairs AS (
  SELECT a.station_id, b.station_id AS neighbor_id,
         sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS km
  FROM xyz a JOIN xyz b ON a.station_id <> b.station_id),
edges AS (
  SELECT station_id, neighbor_id, km,
         row_number() OVER (PARTITION BY station_id ORDER BY round(km, 6), neighbor_id) AS rank
  FROM pairs WHERE km <= 150.0
  QUALIFY rank <= 5)"""

NEIGHBORS = """
near AS (
  SELECT e.station_id, l.ts, l.variable, count(l.value) AS n, avg(l.value) AS mean, stddev_pop(l.value) AS std
  FROM edges e JOIN readings_long l ON l.station_id = e.neighbor_id
  GROUP BY 1, 2, 3)"""

MERGED = """
compared AS (
  SELECT r.*, coalesce(n.n, 0) AS n, n.mean, n.std,
         CASE WHEN coalesce(n.n, 0) < 2 THEN 'SPATIAL_INSUFFICIENT_DATA'
              WHEN abs(value - mean) / greatest(std, 1.0) >= 3.0 AND abs(value - mean) >= 3.5 THEN 'SPATIAL_MISMATCH'
              ELSE 'SPATIAL_CONSISTENT' END AS spatial_reason
  FROM ruled r LEFT JOIN near n USING (station_id, ts, variable)
  WHERE value IS NOT NULL),
merged AS (
  SELECT reading_id * 10 + list_position([%s], variable) AS qc_id, *,
         CASE WHEN rule_reason = 'RULE_RANGE_FAIL' THEN 'RULE_RANGE'
              WHEN rule_reason = 'RULE_PERSISTENCE_FAIL' THEN 'RULE_FLATLINE'
              WHEN rule_reason = 'RULE_STEP_FAIL' AND spatial_reason = 'SPATIAL_CONSISTENT' THEN 'SPATIAL_OVERRIDE_EXTREME'
              WHEN rule_reason = 'RULE_STEP_FAIL' THEN 'RULE_STEP'
              WHEN spatial_reason = 'SPATIAL_MISMATCH' THEN 'SPATIAL_MISMATCH'
              ELSE 'VALID_READING' END AS reason_code
  FROM compared),
qc AS (
  SELECT *,
         CASE WHEN reason_code IN ('SPATIAL_OVERRIDE_EXTREME', 'VALID_READING') THEN 'valid' ELSE 'anomalous' END AS verdict,
         CASE reason_code WHEN 'RULE_RANGE' THEN 'spike' WHEN 'RULE_FLATLINE' THEN 'flatline' WHEN 'RULE_STEP' THEN 'spike'
              WHEN 'SPATIAL_OVERRIDE_EXTREME' THEN 'plausible_extreme' WHEN 'SPATIAL_MISMATCH' THEN 'spatial_inconsistency' END AS fault_type,
         CASE reason_code WHEN 'RULE_RANGE' THEN 0.99 WHEN 'RULE_FLATLINE' THEN 0.98 WHEN 'RULE_STEP' THEN 0.95
              WHEN 'SPATIAL_OVERRIDE_EXTREME' THEN 0.88 WHEN 'SPATIAL_MISMATCH' THEN 0.92 ELSE 1.0 END AS confidence
  FROM merged)""".replace("%s", ", ".join(f"'{v}'" for v in VARIABLES))

QC = ",".join([LONG, STATIONS, SPECS, RULES, KNN, NEIGHBORS, MERGED])

SEVERITY = """CASE WHEN verdict = 'valid' THEN NULL WHEN verdict = 'suspect' THEN 'low'
       WHEN reason_code = 'RULE_RANGE' THEN 'critical'
       WHEN reason_code = 'SPATIAL_MISMATCH' AND confidence >= 0.95 THEN 'critical'
       WHEN reason_code IN ('RULE_FLATLINE', 'RULE_STEP', 'ML_AND_SPATIAL_CONFIRMED', 'SPATIAL_MISMATCH') THEN 'high'
       WHEN reason_code = 'ML_ISOFOREST' AND confidence < 0.70 THEN 'low' ELSE 'medium' END"""

VERDICTS = """
verdicts AS (
  SELECT event_id AS qc_id, event_id AS reading_id, user_id AS station_id,
         ['temperature', 'humidity', 'pressure', 'wind_speed', 'wind_direction', 'rainfall', 'solar_radiation'][1 + (event_id // 7) % 7] AS variable,
         CASE WHEN value >= 90 THEN 'anomalous' WHEN value >= 60 THEN 'suspect' ELSE 'valid' END AS verdict,
         CASE WHEN value >= 60 THEN ['RULE_RANGE', 'RULE_FLATLINE', 'RULE_STEP', 'ML_AND_SPATIAL_CONFIRMED',
              'SPATIAL_MISMATCH', 'ML_ISOFOREST', 'ML_LSTM_AE'][1 + event_id % 7] ELSE 'VALID_READING' END AS reason_code,
         CASE WHEN value >= 60 THEN ['spike', 'flatline', 'spike', 'drift', 'spatial_inconsistency', 'drift', 'dropout'][1 + event_id % 7] END AS fault_type,
         (50 + event_id % 50) / 100.0::DOUBLE AS confidence, value, ts AS created_at
  FROM events)"""

ALERTS = VERDICTS + f""",
alerts AS (
  SELECT qc_id AS alert_id, station_id, qc_id AS qc_result_id, {SEVERITY} AS severity,
         CASE qc_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'acknowledged' ELSE 'resolved' END AS status,
         'Alert on ' || variable AS message, created_at,
         CASE WHEN qc_id % 3 = 2 THEN created_at + INTERVAL 2 HOUR END AS resolved_at
  FROM verdicts WHERE verdict <> 'valid')"""

FEEDBACK = """
feedback AS (
  SELECT doc_id AS feedback_id, doc_id - doc_id % 2 AS qc_result_id, doc_id % 2000 AS user_id,
         CASE WHEN toxic = 1 THEN 'confirmed_fault' WHEN quality = 1 THEN 'false_alarm' ELSE 'unsure' END AS label,
         TIMESTAMP '2024-02-01 00:00:00' + to_minutes(doc_id) AS created_at
  FROM labels)"""

USERS = """
users AS (SELECT c_custkey AS user_id, c_name || '@example.org' AS email FROM customer)"""

TASKS = """
tasks AS (
  SELECT o_orderkey AS task_id, 'Order ' || o_orderkey AS title,
         ['admin', 'data_quality_officer', 'field_technician', 'forecaster'][1 + o_custkey % 4] AS assigned_role,
         CASE o_orderpriority[1] WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS priority,
         CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'in_progress' ELSE 'completed' END AS status,
         'ST' || (o_custkey % 150) AS station_code,
         strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') AS due_date, o_orderdate AS created_at
  FROM orders)"""

AUDIT = """
audit_logs AS (
  SELECT event_id AS audit_id, 'user' || user_id || '@example.org' AS user_email, upper(event_type) AS action,
         json_extract_string(props, '$.k') AS resource, ts AS created_at
  FROM events)"""

REGISTRY = """
registry AS (
  SELECT p_partkey AS model_id,
         CASE WHEN p_size % 2 = 0 THEN 'isolation_forest' ELSE 'reconstruction' END AS model_type,
         [%s][1 + p_partkey % 7] AS variable,
         'v1.' || (p_partkey // 7 + 1) || '.0' AS version,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(p_partkey) AS trained_at,
         CASE WHEN p_size > 10 THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(p_partkey) + to_hours(p_size) END AS activated_at
  FROM part)""".replace("%s", ", ".join(f"'{v}'" for v in VARIABLES))


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def stamp(column: str) -> str:
    """Timestamp as text, the form in which results are compared."""
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"
