"""Queries of alerts, fleet health, failure risk and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratusqc import adapters as A
from stratusqc.constants import (
    ALERT_STATUS,
    FEEDBACK_LABELS,
    NOMINAL_ACTION,
    NOMINAL_DRIVER,
    RISK_ACTIONS,
    RISK_DRIVERS,
    SEVERITIES,
    SILENT_ACTION,
    SILENT_DRIVER,
    STATION_STATUS,
    VERDICTS,
)
from stratusqc.operators import alerts as AL
from stratusqc.operators import health as H
from stratusqc.operators import integrity as IN
from stratusqc.operators.listings import ranked_by_value
from stratusqc.plans import oracle as O
from stratusqc.plans.checks import qc_rows
from stratusqc.plans.registry import query, stamp

AS_OF = "2024-01-31 00:00:00"


@query("alert_severity", O.with_(O.VERDICTS) + f"SELECT qc_id, {O.SEVERITY} AS severity FROM verdicts")
def alert_severity(spark, sf):
    return AL.add_severity(A.verdicts(spark, sf)).select("qc_id", "severity")


def _num(x: str, digits: int = 3) -> str:
    return f"CAST(CAST(round_even(CAST(round({x}, 6) AS DECIMAL(18, 6)), {digits}) AS DOUBLE) AS VARCHAR)"


_MESSAGE = f"""'[' || upper(severity) || '] Station ' || station_id || ' (ST' || station_id || ') - '
  || upper(variable[1]) || lower(variable[2:]) || ': ' ||
  CASE reason_code
    WHEN 'RULE_RANGE' THEN 'Sensor value ' || {_num('value')} || ' breached physical bounds (Confidence: 99%).'
    WHEN 'RULE_FLATLINE' THEN 'Sensor stuck / persistent flatline detected (' || persistence_max || ' identical readings at ' || {_num('first_value')} || ').'
    WHEN 'RULE_STEP' THEN 'Sudden implausible rate-of-change jump (+' || {_num('delta')} || ') without regional confirmation.'
    WHEN 'SPATIAL_MISMATCH' THEN 'Spatial mismatch with neighboring stations (delta: ' || {_num('abs(value - mean)')}
      || ', z-score: ' || {_num('abs(value - mean) / greatest(std, 1.0)')} || ').' END"""


@query(
    "alert_message",
    O.with_(O.QC)
    + f", graded AS (SELECT *, {O.SEVERITY} AS severity FROM qc WHERE verdict <> 'valid') SELECT qc_id, severity, {_MESSAGE} AS message FROM graded",
)
def alert_message(spark, sf):
    flagged = AL.add_severity(qc_rows(spark, sf)).filter("severity is not null")
    return AL.add_message(flagged, A.stations(spark, sf)).select("qc_id", "severity", "message")


def _chain(source: str, minutes: int) -> str:
    """The fold as a recursive query: follow the chain of alerts one by one."""
    return f"""
candidates AS (SELECT qc_id, station_id, variable, created_at AS ts, {O.SEVERITY} AS severity FROM {source} WHERE verdict <> 'valid'),
anchors AS (
  SELECT station_id, variable, arg_min(qc_id, ts) AS qc_id, min(ts) AS ts FROM candidates GROUP BY 1, 2
  UNION ALL
  SELECT c.station_id, c.variable, arg_min(c.qc_id, c.ts), min(c.ts) FROM anchors a
  JOIN candidates c ON c.station_id = a.station_id AND c.variable = a.variable AND c.ts > a.ts + INTERVAL {minutes} MINUTE
  GROUP BY c.station_id, c.variable),
owned AS (
  SELECT c.*, a.qc_id AS alert_id, a.ts AS alert_ts FROM candidates c ASOF JOIN anchors a
    ON c.station_id = a.station_id AND c.variable = a.variable AND c.ts >= a.ts),
folded AS (
  SELECT alert_id, station_id, variable, alert_ts, arg_max(qc_id, ts) AS last_qc_id, count(*) AS n_folded,
         coalesce(arg_min(severity, ts) FILTER (WHERE severity IN ('high', 'critical')), arg_min(severity, ts)) AS severity
  FROM owned GROUP BY 1, 2, 3, 4)"""


def _recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes) + "\n"


@query(
    "debounce_alerts",
    _recursive(O.VERDICTS, _chain("verdicts", 1440))
    + f"SELECT alert_id, station_id, variable, {O.stamp('alert_ts')} AS first_ts, last_qc_id, severity, n_folded FROM folded",
)
def debounce_alerts(spark, sf):
    """Event-level verdicts, folded over a day so that chains reach across many time spans."""
    flagged = AL.add_severity(A.verdicts(spark, sf)).filter("severity is not null")
    return AL.debounce_alerts(flagged, 1440).withColumn("first_ts", stamp("first_ts"))


@query(
    "debounce_alerts_hourly",
    _recursive(O.VERDICTS, _chain("verdicts", 60))
    + f"SELECT alert_id, last_qc_id, severity, n_folded FROM folded",
)
def debounce_alerts_hourly(spark, sf):
    flagged = AL.add_severity(A.verdicts(spark, sf)).filter("severity is not null")
    return AL.debounce_alerts(flagged).select("alert_id", "last_qc_id", "severity", "n_folded")


@query(
    "alert_table",
    _recursive(O.QC, "qcs AS (SELECT *, ts AS created_at FROM qc)", _chain("qcs", 2880))
    + f""", graded AS (SELECT *, {O.SEVERITY} AS severity FROM qcs)
      SELECT f.alert_id, f.last_qc_id AS qc_result_id, f.severity, f.n_folded, m.message
      FROM folded f JOIN (SELECT qc_id, {_MESSAGE} AS message FROM graded WHERE verdict <> 'valid') m ON m.qc_id = f.alert_id""",
)
def alert_table(spark, sf):
    return AL.alert_table(qc_rows(spark, sf), A.stations(spark, sf), 2880).select(
        "alert_id", "qc_result_id", "severity", "n_folded", "message"
    )


@query(
    "open_alert_within_cooldown",
    O.with_(O.ALERTS)
    + """SELECT v.qc_id, arg_min(a.alert_id, (a.created_at, a.alert_id)) AS alert_id FROM verdicts v
         JOIN (SELECT a.*, variable FROM alerts a JOIN verdicts q ON q.qc_id = a.qc_result_id WHERE status = 'open') a
           ON a.station_id = v.station_id AND a.variable = v.variable
          AND a.created_at BETWEEN v.created_at - INTERVAL 600 MINUTE AND v.created_at
         WHERE v.verdict <> 'valid' GROUP BY 1""",
)
def open_alert_within_cooldown(spark, sf):
    qc = A.verdicts(spark, sf)
    alerts = A.alerts(spark, sf).join(qc.select(F.col("qc_id").alias("qc_result_id"), "variable"), "qc_result_id")
    return AL.open_alert_within_cooldown(qc.filter("verdict <> 'valid'"), alerts, 600)


_STATUS_EVENTS = """
status_events AS (
  SELECT alert_id, 'acknowledged' AS new_status, created_at + INTERVAL 1 HOUR AS event_ts FROM alerts WHERE alert_id % 2 = 0
  UNION ALL SELECT alert_id, 'resolved', created_at + INTERVAL 3 HOUR FROM alerts WHERE alert_id % 4 = 0)"""


def status_events(alerts):
    """Every other alert is acknowledged an hour later, every fourth resolved after three."""
    moved = alerts.filter("alert_id % 2 = 0").select(
        "alert_id",
        F.explode(
            F.array(
                F.struct(F.lit("acknowledged").alias("s"), F.lit(1).alias("h")),
                F.struct(F.when(F.col("alert_id") % 4 == 0, "resolved").alias("s"), F.lit(3).alias("h")),
            )
        ).alias("e"),
        "created_at",
    )
    return moved.filter("e.s is not null").select(
        "alert_id",
        F.col("e.s").alias("new_status"),
        (F.col("created_at") + F.make_interval(hours=F.col("e.h"))).alias("event_ts"),
    )


@query(
    "apply_status",
    O.with_(O.ALERTS, _STATUS_EVENTS)
    + f"""SELECT a.alert_id, coalesce(arg_max(e.new_status, e.event_ts), any_value(a.status)) AS status,
          {O.stamp("coalesce(max(CASE WHEN e.new_status = 'resolved' THEN e.event_ts END), any_value(a.resolved_at))")} AS resolved_at
          FROM alerts a LEFT JOIN status_events e USING (alert_id) GROUP BY 1""",
)
def apply_status(spark, sf):
    alerts = A.alerts(spark, sf)
    events = status_events(alerts)
    return AL.apply_status(alerts, events).select("alert_id", "status", stamp("resolved_at").alias("resolved_at"))


@query(
    "apply_feedback",
    O.with_(O.ALERTS, O.FEEDBACK)
    + """SELECT alert_id, CASE WHEN count(f.label) FILTER (WHERE f.label = 'false_alarm') > 0 THEN 'resolved'
           WHEN a.status = 'open' AND count(f.label) FILTER (WHERE f.label = 'confirmed_fault') > 0 THEN 'acknowledged'
           ELSE a.status END AS status
         FROM alerts a LEFT JOIN feedback f USING (qc_result_id) GROUP BY alert_id, a.status""",
)
def apply_feedback(spark, sf):
    return AL.apply_feedback(A.alerts(spark, sf), A.feedback(spark, sf)).select("alert_id", "status")


_HEALTH = """
health AS (
  SELECT s.*, r.latest_ts, coalesce(a.n, 0) AS active_alerts, q.verdict AS latest_verdict, q.fault_type AS latest_fault_type,
         CASE WHEN s.status <> 'active' OR r.latest_ts IS NULL THEN 'offline'
              WHEN coalesce(a.n, 0) > 0 OR q.verdict = 'anomalous' THEN 'anomalous'
              WHEN q.verdict = 'suspect' THEN 'suspect' ELSE 'healthy' END AS health_status
  FROM stations s
  LEFT JOIN (SELECT station_id, max(ts) AS latest_ts FROM readings GROUP BY 1) r USING (station_id)
  LEFT JOIN (SELECT station_id, count(*) AS n FROM alerts WHERE status <> 'resolved' GROUP BY 1) a USING (station_id)
  LEFT JOIN (SELECT * FROM verdicts QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY qc_id DESC) = 1) q USING (station_id))"""
_HEALTHQ = O.with_(O.READINGS, O.STATIONS, O.ALERTS, _HEALTH)


def health(spark, sf):
    return H.station_health(A.stations(spark, sf), A.readings(spark, sf), A.verdicts(spark, sf), A.alerts(spark, sf))


@query(
    "station_health",
    _HEALTHQ + f"SELECT station_id, health_status, active_alerts, latest_verdict, latest_fault_type, {O.stamp('latest_ts')} AS latest_ts FROM health",
)
def station_health(spark, sf):
    return health(spark, sf).select(
        "station_id", "health_status", "active_alerts", "latest_verdict", "latest_fault_type", stamp("latest_ts").alias("latest_ts")
    )


_COUNTS = ", ".join(f"count(*) FILTER (WHERE health_status = '{h}') AS {h}_count" for h in H.HEALTH)


@query("fleet_health_counts", _HEALTHQ + f"SELECT count(*) AS total, {_COUNTS} FROM health")
def fleet_health_counts(spark, sf):
    return H.fleet_health_counts(health(spark, sf))


@query(
    "fleet_qc_by_state",
    O.with_(O.QC)
    + f""", qa AS (SELECT station_id, count(*) AS n FROM qc WHERE verdict <> 'valid' GROUP BY 1),
      lastq AS (SELECT * FROM qc QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY qc_id DESC) = 1),
      health AS (
        SELECT s.state, CASE WHEN s.status <> 'active' OR r.latest_ts IS NULL THEN 'offline'
            WHEN coalesce(qa.n, 0) > 0 OR l.verdict = 'anomalous' THEN 'anomalous' WHEN l.verdict = 'suspect' THEN 'suspect' ELSE 'healthy' END AS health_status
        FROM stations s LEFT JOIN (SELECT station_id, max(ts) AS latest_ts FROM readings GROUP BY 1) r USING (station_id)
        LEFT JOIN qa USING (station_id) LEFT JOIN lastq l USING (station_id))
      SELECT state, count(*) AS total, {_COUNTS} FROM health GROUP BY 1""",
)
def fleet_qc_by_state(spark, sf):
    """Flagship: readings through rules, neighbours and merge, to alerts and health counts per state."""
    qc = qc_rows(spark, sf).select("qc_id", "station_id", "verdict", "fault_type", "reason_code", "confidence", "created_at")
    alerts = qc.filter("verdict <> 'valid'").withColumn("status", F.lit("open"))
    rows = H.station_health(A.stations(spark, sf), A.readings(spark, sf), qc, alerts)
    return H.fleet_health_counts(rows, "state")


@query(
    "live_health_patch",
    _HEALTHQ
    + """, incoming AS (SELECT station_id, qc_id, fault_type FROM verdicts WHERE verdict = 'anomalous' AND created_at >= TIMESTAMP '2024-01-30 12:00:00')
      SELECT h.station_id, CASE WHEN count(i.qc_id) > 0 THEN 'anomalous' ELSE any_value(health_status) END AS health_status,
        any_value(active_alerts) + count(i.qc_id) AS active_alerts,
        coalesce(arg_max(i.fault_type, i.qc_id), any_value(latest_fault_type)) AS latest_fault_type
      FROM health h LEFT JOIN incoming i USING (station_id) GROUP BY 1""",
)
def live_health_patch(spark, sf):
    incoming = (
        A.verdicts(spark, sf)
        .filter("verdict = 'anomalous' and created_at >= timestamp'2024-01-30 12:00:00'")
        .withColumn("alert_id", F.col("qc_id"))
    )
    return H.apply_live_alerts(health(spark, sf), incoming).select(
        "station_id", "health_status", "active_alerts", "latest_fault_type"
    )


@query(
    "station_detail",
    _HEALTHQ
    + f"""SELECT station_id, 'summary' AS section, CAST(station_id AS VARCHAR) AS item, {O.stamp('latest_ts')} AS at_text, health_status AS label FROM health
      UNION ALL SELECT station_id, 'reading', CAST(reading_id AS VARCHAR), {O.stamp('ts')}, NULL FROM
        (SELECT * FROM readings QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY ts DESC) <= 50)
      UNION ALL SELECT station_id, 'alert', CAST(alert_id AS VARCHAR), {O.stamp('created_at')}, severity FROM alerts WHERE status <> 'resolved'""",
)
def station_detail(spark, sf):
    return H.station_detail(
        A.stations(spark, sf), A.readings(spark, sf), A.verdicts(spark, sf), A.alerts(spark, sf)
    ).select("station_id", "section", "item", stamp("at").alias("at_text"), "label")


_FEATURES = """
features AS (
  SELECT s.station_id, s.state, coalesce(r.n, 0) AS total_readings, coalesce(q.anom, 0) AS anomalous_count, coalesce(q.susp, 0) AS suspect_count,
    coalesce(q.drift, 0) AS drift_count, coalesce(q.flat, 0) AS flatline_count, coalesce(q.drop_, 0) AS dropout_count,
    coalesce(a.open_, 0) AS open_alerts, coalesce(a.crit, 0) AS critical_alerts,
    CAST(greatest(1, date_diff('day', s.install_date, DATE '2024-01-31')) AS INTEGER) AS age_days,
    least(1.0::DOUBLE, coalesce(q.anom, 0)::DOUBLE / greatest(coalesce(r.n, 0), 1)) AS anom_rate,
    least(1.0::DOUBLE, coalesce(q.susp, 0)::DOUBLE / greatest(coalesce(r.n, 0), 1)) AS suspect_rate
  FROM stations s
  LEFT JOIN (SELECT station_id, count(*) AS n FROM readings WHERE ts >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY 1) r USING (station_id)
  LEFT JOIN (SELECT station_id, count(*) FILTER (WHERE verdict = 'anomalous') AS anom, count(*) FILTER (WHERE verdict = 'suspect') AS susp,
      count(*) FILTER (WHERE fault_type = 'drift') AS drift, count(*) FILTER (WHERE fault_type = 'flatline') AS flat,
      count(*) FILTER (WHERE fault_type = 'dropout') AS drop_
    FROM verdicts WHERE created_at >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY 1) q USING (station_id)
  LEFT JOIN (SELECT station_id, count(*) AS open_, count(*) FILTER (WHERE severity = 'critical') AS crit
    FROM alerts WHERE status = 'open' GROUP BY 1) a USING (station_id)),
parts AS (
  SELECT *, 2.6 * least(1.0, drift_count / 4.0) AS p_drift, 2.2 * least(1.0, flatline_count / 4.0) AS p_flat,
    3.8 * least(1.0, anom_rate * 6.0 + suspect_rate * 2.0) AS p_anom, 2.0 * least(1.0, (open_alerts + 2.0 * critical_alerts) / 4.0) AS p_alerts,
    1.4 * least(1.0, dropout_count / 3.0) AS p_drop, 0.5 * least(1.0, age_days / 1825.0) AS p_age
  FROM features),
scored AS (
  SELECT *, CASE WHEN total_readings = 0 THEN 0.55::DOUBLE ELSE greatest(0.02::DOUBLE, least(0.98::DOUBLE,
      round(1.0 / (1.0 + exp(-(-2.5 + p_drift + p_flat + p_anom + p_alerts + p_drop + p_age)::DOUBLE)), 4))) END AS failure_probability,
    greatest(round(p_drift::DOUBLE, 3), round(p_flat::DOUBLE, 3), round(p_anom::DOUBLE, 3), round(p_alerts::DOUBLE, 3), round(p_drop::DOUBLE, 3), round(p_age::DOUBLE, 3)) AS top_part
  FROM parts),
predictions AS (
  SELECT *, CASE WHEN failure_probability >= 0.70 THEN 'critical' WHEN failure_probability >= 0.40 THEN 'elevated'
      WHEN failure_probability >= 0.20 THEN 'moderate' ELSE 'nominal' END AS risk_level,
    CASE WHEN total_readings = 0 THEN 'Zero Telemetry Received' WHEN failure_probability <= 0.15 OR top_part <= 0.05 THEN 'Nominal Baseline'
      WHEN round(p_drift::DOUBLE, 3) = top_part THEN 'Sensor Drift Accumulation' WHEN round(p_flat::DOUBLE, 3) = top_part THEN 'Sensor Flatline / Freeze'
      WHEN round(p_anom::DOUBLE, 3) = top_part THEN 'High QC Anomaly Rate' WHEN round(p_alerts::DOUBLE, 3) = top_part THEN 'Unresolved Diagnostic Alerts'
      WHEN round(p_drop::DOUBLE, 3) = top_part THEN 'Telemetry Dropouts' ELSE 'Hardware Lifespan Aging' END AS top_driver,
    rank() OVER (ORDER BY failure_probability DESC) AS risk_rank
  FROM scored)"""
_RISKQ = O.with_(O.READINGS, O.STATIONS, O.ALERTS, _FEATURES)


def predictions(spark, sf):
    return H.fleet_predictions(
        A.stations(spark, sf), A.readings(spark, sf), A.verdicts(spark, sf), A.alerts(spark, sf), AS_OF, 30
    )


@query(
    "station_health_features",
    _RISKQ
    + """SELECT station_id, total_readings, anomalous_count, suspect_count, drift_count, flatline_count, dropout_count,
         open_alerts, critical_alerts, age_days, round(anom_rate, 6) AS anom_rate, round(suspect_rate, 6) AS suspect_rate FROM features""",
)
def station_health_features(spark, sf):
    df = H.health_features(
        A.stations(spark, sf), A.readings(spark, sf), A.verdicts(spark, sf), A.alerts(spark, sf), AS_OF, 30
    )
    return df.select(
        "station_id", "total_readings", "anomalous_count", "suspect_count", "drift_count", "flatline_count", "dropout_count",
        "open_alerts", "critical_alerts", "age_days", F.round("anom_rate", 6).alias("anom_rate"), F.round("suspect_rate", 6).alias("suspect_rate"),
    )


@query("failure_risk", _RISKQ + "SELECT station_id, failure_probability, risk_level FROM predictions")
def failure_risk(spark, sf):
    return predictions(spark, sf).select("station_id", "failure_probability", "risk_level")


@query("top_driver_action", _RISKQ + "SELECT station_id, top_driver FROM predictions")
def top_driver_action(spark, sf):
    return predictions(spark, sf).select("station_id", "top_driver")


_ACTION = " ".join(f"WHEN '{RISK_DRIVERS[k]}' THEN '{RISK_ACTIONS[k]}'" for k in RISK_DRIVERS)


@query(
    "risk_breakdown",
    _RISKQ
    + f"""SELECT station_id, top_driver, CASE top_driver WHEN '{SILENT_DRIVER}' THEN '{SILENT_ACTION}' WHEN '{NOMINAL_DRIVER}' THEN '{NOMINAL_ACTION}' {_ACTION} END AS recommended_action,
         round(p_drift::DOUBLE, 3) AS drift, round(p_flat::DOUBLE, 3) AS flatline, round(p_anom::DOUBLE, 3) AS anomaly, round(p_alerts::DOUBLE, 3) AS alerts,
         round(p_drop::DOUBLE, 3) AS dropout, round(p_age::DOUBLE, 3) AS age, risk_level AS level_in_json, open_alerts AS open_alerts_in_json FROM predictions""",
)
def risk_breakdown(spark, sf):
    """Each station's action and the share of every cause, also as the JSON text that a sink stores."""
    df = H.with_top_factors(predictions(spark, sf)).withColumn("json", F.to_json("top_factors"))
    return df.select(
        "station_id", "top_driver", "recommended_action", "top_factors.factor_breakdown.*",
        F.get_json_object("json", "$.risk_level").alias("level_in_json"),
        F.get_json_object("json", "$.metrics_summary.open_alerts").cast("long").alias("open_alerts_in_json"),
    )


@query(
    "fleet_predictions",
    _RISKQ + "SELECT station_id, state, failure_probability, risk_level, top_driver, risk_rank FROM predictions",
)
def fleet_predictions(spark, sf):
    return predictions(spark, sf).select(
        "station_id", "state", "failure_probability", "risk_level", "top_driver", "risk_rank"
    )


@query(
    "fleet_summary",
    _RISKQ
    + """SELECT count(*) AS total_stations, count(*) FILTER (WHERE risk_level = 'critical') AS critical_risk_count,
         count(*) FILTER (WHERE risk_level = 'elevated') AS elevated_risk_count, count(*) FILTER (WHERE risk_level = 'moderate') AS moderate_risk_count,
         count(*) FILTER (WHERE risk_level = 'nominal') AS nominal_risk_count, round(avg(failure_probability), 4) AS mean_failure_probability FROM predictions""",
)
def fleet_summary(spark, sf):
    return H.fleet_summary(predictions(spark, sf))


@query(
    "latest_prediction",
    _RISKQ + "SELECT station_id, failure_probability, '2024-01-31 00:00:00' AS predicted_at FROM predictions",
)
def latest_prediction(spark, sf):
    """Two runs a week apart; the newer one speaks."""
    newer = predictions(spark, sf).select("station_id", "failure_probability", "predicted_at")
    older = newer.select("station_id", (F.col("failure_probability") / 2).alias("failure_probability"),
                         (F.col("predicted_at") - F.expr("interval 7 days")).alias("predicted_at"))
    return H.latest_prediction(newer.unionByName(older)).withColumn("predicted_at", stamp("predicted_at"))


@query(
    "top_risk",
    _RISKQ + "SELECT station_id, failure_probability FROM predictions WHERE risk_level = 'critical' ORDER BY failure_probability DESC, station_id LIMIT 20",
)
def top_risk(spark, sf):
    return H.top_risk(predictions(spark, sf), "Critical", 20).select("station_id", "failure_probability")


@query(
    "risk_rank_customers",
    "SELECT c_custkey, rank() OVER (ORDER BY floor(c_acctbal / 100) DESC) AS rank FROM customer",
)
def risk_rank_customers(spark, sf):
    """Ranking a large table by a coarse value without a single-task window."""
    df = A.table(spark, sf, "customer").withColumn("band", F.floor(F.col("c_acctbal") / 100))
    return ranked_by_value(df, "band").select("c_custkey", "rank")


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_keys(spark, sf):
    return IN.duplicate_keys(A.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "orphan_rows",
    O.with_(O.VERDICTS, O.FEEDBACK)
    + """SELECT 'feedback' AS child, count(*) AS n FROM feedback WHERE qc_result_id NOT IN (SELECT qc_id FROM verdicts)
         UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
         UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""",
)
def orphan_rows(spark, sf):
    parts = [
        ("feedback", IN.orphans(A.feedback(spark, sf), A.verdicts(spark, sf), "qc_result_id", "qc_id")),
        ("lineitem", IN.orphans(A.table(spark, sf, "lineitem"), A.table(spark, sf, "orders"), "l_orderkey", "o_orderkey")),
        ("orders", IN.orphans(A.table(spark, sf, "orders"), A.table(spark, sf, "customer"), "o_custkey", "c_custkey")),
    ]
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("child"), "n") for name, df in parts]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "enum_domain",
    O.with_(O.STATIONS, O.ALERTS, O.FEEDBACK)
    + """SELECT 'alert_status' AS field, count(*) AS n FROM alerts WHERE status NOT IN ('open', 'acknowledged', 'resolved')
         UNION ALL SELECT 'severity', count(*) FROM alerts WHERE severity NOT IN ('low', 'medium', 'high', 'critical')
         UNION ALL SELECT 'verdict', count(*) FROM verdicts WHERE verdict NOT IN ('valid', 'suspect', 'anomalous')
         UNION ALL SELECT 'label', count(*) FROM feedback WHERE label NOT IN ('confirmed_fault', 'false_alarm', 'unsure')
         UNION ALL SELECT 'station_status', count(*) FROM stations WHERE status NOT IN ('active', 'maintenance', 'decommissioned')""",
)
def enum_domain(spark, sf):
    """Values outside each domain."""
    checks = [
        ("alert_status", A.alerts(spark, sf), "status", ALERT_STATUS),
        ("severity", A.alerts(spark, sf), "severity", SEVERITIES),
        ("verdict", A.verdicts(spark, sf), "verdict", VERDICTS),
        ("label", A.feedback(spark, sf), "label", FEEDBACK_LABELS),
        ("station_status", A.stations(spark, sf), "status", STATION_STATUS),
    ]
    out = None
    for field, df, column, allowed in checks:
        part = IN.outside_domain(df, column, allowed).agg(F.count(F.lit(1)).alias("n")).select(F.lit(field).alias("field"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "cascade_removal",
    O.with_(O.READINGS, O.STATIONS, O.ALERTS, O.FEEDBACK)
    + """, gone AS (SELECT station_id FROM stations WHERE status = 'decommissioned')
         SELECT 'readings' AS part, count(*) AS n FROM readings WHERE station_id NOT IN (SELECT station_id FROM gone)
         UNION ALL SELECT 'qc', count(*) FROM verdicts WHERE station_id NOT IN (SELECT station_id FROM gone)
         UNION ALL SELECT 'alerts', count(*) FROM alerts WHERE station_id NOT IN (SELECT station_id FROM gone)
         UNION ALL SELECT 'feedback', count(*) FROM feedback WHERE qc_result_id NOT IN
           (SELECT qc_id FROM verdicts WHERE station_id IN (SELECT station_id FROM gone))""",
)
def cascade_removal(spark, sf):
    gone = A.stations(spark, sf).filter("status = 'decommissioned'")
    left = IN.without_stations(
        gone, A.readings(spark, sf), A.verdicts(spark, sf), A.alerts(spark, sf), A.feedback(spark, sf)
    )
    out = None
    for part, df in left.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "dropout_gaps",
    O.with_(O.READINGS)
    + f"""SELECT station_id, {O.stamp('gap_start')} AS gap_start, {O.stamp('gap_end')} AS gap_end, date_diff('second', gap_start, gap_end) AS gap_seconds
          FROM (SELECT station_id, lag(ts) OVER (PARTITION BY station_id ORDER BY ts) AS gap_start, ts AS gap_end FROM readings)
          WHERE date_diff('second', gap_start, gap_end) > 172800""",
)
def dropout_gaps(spark, sf):
    return IN.dropout_gaps(A.readings(spark, sf)).select(
        "station_id", stamp("gap_start").alias("gap_start"), stamp("gap_end").alias("gap_end"), "gap_seconds"
    )
