"""Queries over the operational tables: lists, pages, latest rows, joins, counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratusqc import adapters as A
from stratusqc.operators import listings as L
from stratusqc.operators import reshape as R
from stratusqc.plans import oracle as O
from stratusqc.plans.checks import qc_rows
from stratusqc.plans.registry import query, stamp


@query(
    "station_filter",
    O.with_(O.STATIONS) + "SELECT station_code, state, status FROM stations WHERE state = 'State 2' AND status = 'active'",
)
def station_filter(spark, sf):
    return L.station_filter(A.stations(spark, sf), "State 2", "active").select("station_code", "state", "status")


_ENRICHED = """
latest_fb AS (
  SELECT * FROM feedback QUALIFY row_number() OVER (PARTITION BY qc_result_id ORDER BY created_at DESC, feedback_id DESC) = 1),
enriched AS (
  SELECT a.*, s.station_code, s.name AS station_name, v.variable, f.label AS feedback_label
  FROM alerts a JOIN stations s USING (station_id) JOIN verdicts v ON a.qc_result_id = v.qc_id
  LEFT JOIN latest_fb f ON f.qc_result_id = a.qc_result_id)"""
_ALERTS = O.with_(O.ALERTS, O.STATIONS, O.FEEDBACK, _ENRICHED)


def enriched_alerts(spark, sf):
    return L.alert_enriched(A.alerts(spark, sf), A.stations(spark, sf), A.verdicts(spark, sf), A.feedback(spark, sf))


@query(
    "alert_enriched",
    _ALERTS + "SELECT alert_id, station_code, station_name, variable, severity, status, feedback_label FROM enriched",
)
def alert_enriched(spark, sf):
    return enriched_alerts(spark, sf).select(
        "alert_id", "station_code", "station_name", "variable", "severity", "status", "feedback_label"
    )


@query(
    "alert_list",
    _ALERTS
    + f"""SELECT alert_id, station_code, severity, {O.stamp('created_at')} AS created_at, feedback_label,
          (SELECT count(*) FROM enriched WHERE status = 'open' AND severity = 'high') AS total
          FROM enriched WHERE status = 'open' AND severity = 'high' ORDER BY enriched.created_at DESC, alert_id DESC LIMIT 20 OFFSET 10""",
)
def alert_list(spark, sf):
    return L.alert_list(enriched_alerts(spark, sf), status="open", severity="high", limit=20, offset=10).select(
        "alert_id", "station_code", "severity", stamp("created_at").alias("created_at"), "feedback_label", "total"
    )


@query(
    "alert_list_by_station",
    _ALERTS
    + """SELECT alert_id, severity, (SELECT count(*) FROM enriched WHERE station_code = 'ST7') AS total
          FROM enriched WHERE station_code = 'ST7' ORDER BY enriched.created_at DESC, alert_id DESC LIMIT 50""",
)
def alert_list_by_station(spark, sf):
    return L.alert_list(enriched_alerts(spark, sf), station="ST7").select("alert_id", "severity", "total")


_FB = O.with_(O.ALERTS, O.STATIONS, O.FEEDBACK, O.USERS) + """,
noted AS (
  SELECT f.feedback_id, f.label, f.created_at, v.variable, s.station_code, u.email, a.alert_id
  FROM feedback f JOIN verdicts v ON f.qc_result_id = v.qc_id JOIN stations s ON s.station_id = v.station_id
  LEFT JOIN users u USING (user_id) LEFT JOIN alerts a ON a.qc_result_id = f.qc_result_id)
"""


def enriched_feedback(spark, sf):
    return L.feedback_enriched(
        A.feedback(spark, sf), A.verdicts(spark, sf), A.stations(spark, sf), A.users(spark, sf), A.alerts(spark, sf)
    )


@query("feedback_enriched", _FB + "SELECT feedback_id, label, variable, station_code, email, alert_id FROM noted")
def feedback_enriched(spark, sf):
    return enriched_feedback(spark, sf).select("feedback_id", "label", "variable", "station_code", "email", "alert_id")


@query(
    "feedback_list",
    _FB
    + """SELECT feedback_id, variable, email, (SELECT count(*) FROM noted WHERE label = 'false_alarm') AS total
         FROM noted WHERE label = 'false_alarm' ORDER BY created_at DESC, feedback_id DESC LIMIT 30 OFFSET 5""",
)
def feedback_list(spark, sf):
    return L.feedback_list(enriched_feedback(spark, sf), label="false_alarm", limit=30, offset=5).select(
        "feedback_id", "variable", "email", "total"
    )


@query(
    "telemetry_range",
    O.with_(O.READINGS)
    + f"""SELECT reading_id, station_id, {O.stamp('ts')} AS ts, round(temperature, 6) AS temperature FROM readings
          WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-25 00:00:00'
          QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY readings.ts DESC) <= 7""",
)
def telemetry_range(spark, sf):
    df = L.telemetry_range(A.readings(spark, sf), None, "2024-01-05 00:00:00", "2024-01-25 00:00:00", 7)
    return df.select("reading_id", "station_id", stamp("ts").alias("ts"), F.round("temperature", 6).alias("temperature"))


@query(
    "text_search",
    O.with_(O.STATIONS)
    + "SELECT station_code, name, district FROM stations WHERE lower(name) LIKE '%on 12%' OR lower(district) LIKE '%on 12%' OR lower(station_code) LIKE '%on 12%'",
)
def text_search(spark, sf):
    return L.text_search(A.stations(spark, sf), " ON 12 ", ["name", "district", "station_code"]).select(
        "station_code", "name", "district"
    )


@query("distinct_states", O.with_(O.STATIONS) + "SELECT DISTINCT state FROM stations")
def distinct_states(spark, sf):
    return L.distinct_states(A.stations(spark, sf))


@query(
    "task_list",
    O.with_(O.TASKS)
    + "SELECT task_id, title, status, station_code, due_date FROM tasks WHERE assigned_role = 'field_technician' AND priority = 'high'",
)
def task_list(spark, sf):
    return L.task_list(A.tasks(spark, sf), role="field_technician", status="all", priority="high").select(
        "task_id", "title", "status", "station_code", "due_date"
    )


@query(
    "task_status_counts",
    O.with_(O.TASKS)
    + """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending,
         count(*) FILTER (WHERE status = 'in_progress') AS in_progress, count(*) FILTER (WHERE status = 'completed') AS completed FROM tasks""",
)
def task_status_counts(spark, sf):
    return L.task_status_counts(A.tasks(spark, sf))


@query(
    "audit_recent",
    O.with_(O.AUDIT)
    + "SELECT audit_id, user_email, action, resource FROM audit_logs WHERE action = 'ERROR' ORDER BY created_at DESC, audit_id DESC LIMIT 40",
)
def audit_recent(spark, sf):
    return L.audit_recent(A.audit_logs(spark, sf), "ERROR", 40).select("audit_id", "user_email", "action", "resource")


@query(
    "observations_view",
    O.with_(O.READINGS)
    + f"SELECT reading_id AS id, station_id, {O.stamp('ts')} AS observed_at, round(temperature, 6) AS temperature, 'live' AS source FROM readings",
)
def observations_view(spark, sf):
    return R.observations_view(A.readings(spark, sf)).select(
        "id", "station_id", stamp("observed_at").alias("observed_at"), F.round("temperature", 6).alias("temperature"), "source"
    )


@query(
    "anomalies_view",
    O.with_(O.VERDICTS)
    + """SELECT qc_id AS id, fault_type AS anomaly_type, verdict AS status, confidence AS score,
         CASE WHEN confidence >= 0.85 THEN 'critical' WHEN confidence >= 0.70 THEN 'high' ELSE 'medium' END AS severity FROM verdicts""",
)
def anomalies_view(spark, sf):
    return R.anomalies_view(A.verdicts(spark, sf)).select("id", "anomaly_type", "status", "score", "severity")


@query(
    "maintenance_tasks_view",
    O.with_(O.TASKS) + "SELECT task_id AS id, station_code, title, priority, status, due_date FROM tasks",
)
def maintenance_tasks_view(spark, sf):
    return R.maintenance_tasks_view(A.tasks(spark, sf)).drop("created_at")


@query(
    "flagged_points",
    O.with_(O.QC) + "SELECT qc_id, variable, verdict, reason_code FROM qc WHERE verdict IN ('anomalous', 'suspect')",
)
def flagged_points(spark, sf):
    return R.flagged_points(qc_rows(spark, sf)).select("qc_id", "variable", "verdict", "reason_code")


@query("wide_to_long", O.with_(O.LONG) + "SELECT reading_id, variable, round(value, 6) AS value FROM readings_long")
def wide_to_long(spark, sf):
    return A.readings_long(spark, sf).select("reading_id", "variable", F.round("value", 6).alias("value"))


@query(
    "qc_overlay",
    O.with_(O.READINGS, O.VERDICTS)
    + """SELECT r.reading_id, count(v.qc_id) AS n_judged, max(CASE WHEN v.variable = 'humidity' THEN v.verdict END) AS humidity_verdict,
         max(CASE WHEN v.variable = 'humidity' THEN v.reason_code END) AS humidity_reason
         FROM readings r LEFT JOIN (
           SELECT * FROM (SELECT *, station_id * 100000 + CAST(date_diff('day', DATE '1970-01-01', CAST(created_at AS DATE)) AS BIGINT) AS rid FROM verdicts)
           QUALIFY row_number() OVER (PARTITION BY rid, variable ORDER BY qc_id DESC) = 1) v ON v.rid = r.reading_id
         GROUP BY 1""",
)
def qc_overlay(spark, sf):
    """Newest stored verdict per reading and variable, shown on the reading as a map."""
    rid = F.col("station_id") * 100000 + F.datediff("created_at", F.lit("1970-01-01").cast("date"))
    qc = A.verdicts(spark, sf).withColumn("reading_id", rid)
    judged = F.try_element_at("qc_verdicts", F.lit("humidity"))
    return R.qc_overlay(A.readings(spark, sf), qc).select(
        "reading_id",
        F.coalesce(F.size("qc_verdicts"), F.lit(0)).cast("bigint").alias("n_judged"),
        judged["verdict"].alias("humidity_verdict"),
        judged["reason_code"].alias("humidity_reason"),
    )


@query(
    "bounds_overlay",
    O.with_(O.LONG, O.STATIONS, O.SPECS)
    + f"""SELECT station_id, {O.stamp('ts')} AS ts, round(value, 6) AS value, spec_min::DOUBLE AS spec_min, spec_max::DOUBLE AS spec_max
          FROM readings_long JOIN specs USING (station_id, variable) WHERE variable = 'rainfall'""",
)
def bounds_overlay(spark, sf):
    return R.bounds_overlay(A.readings(spark, sf), A.stations(spark, sf), "rainfall").select(
        "station_id", stamp("ts").alias("ts"), F.round("value", 6).alias("value"), "spec_min", "spec_max"
    )


_TILE = """CAST(trunc((longitude + 180.0) / 360.0 * 64.0) AS INTEGER) AS tile_x,
  CAST(trunc((1.0 - asinh(tan(radians(latitude))) / pi()) / 2.0 * 64.0) AS INTEGER) AS tile_y"""


@query(
    "tile_assign",
    O.with_(O.READINGS, O.STATIONS)
    + f"""SELECT tile_x, tile_y, count(*) AS readings, count(DISTINCT station_id) AS stations
          FROM readings JOIN (SELECT station_id, {_TILE} FROM stations) USING (station_id) GROUP BY 1, 2""",
)
def tile_assign(spark, sf):
    tiled = R.tile_assign(A.stations(spark, sf), 6).select("station_id", "tile_x", "tile_y")
    # Readings are counted per station before they meet the tiles: a crowded tile costs one row per station.
    per_station = A.readings(spark, sf).groupBy("station_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_station.join(tiled, "station_id")
        .groupBy("tile_x", "tile_y")
        .agg(F.sum("n").alias("readings"), F.count(F.lit(1)).alias("stations"))
    )


@query(
    "bbox_filter",
    O.with_(O.STATIONS)
    + "SELECT station_code FROM stations WHERE latitude BETWEEN 22.0 AND 25.5 AND longitude BETWEEN 70.25 AND 70.75",
)
def bbox_filter(spark, sf):
    return R.bbox_filter(A.stations(spark, sf), 22.0, 70.25, 25.5, 70.75).select("station_code")


@query(
    "latest_reading",
    O.with_(O.READINGS)
    + f"""SELECT station_id, reading_id, {O.stamp('ts')} AS ts, round(temperature, 6) AS temperature FROM readings
          QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY readings.ts DESC) = 1""",
)
def latest_reading(spark, sf):
    return L.latest_per_key(A.readings(spark, sf), ["station_id"], ["ts"]).select(
        "station_id", "reading_id", stamp("ts").alias("ts"), F.round("temperature", 6).alias("temperature")
    )


@query(
    "latest_verdict",
    O.with_(O.VERDICTS)
    + "SELECT station_id, qc_id, verdict, fault_type FROM verdicts QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY qc_id DESC) = 1",
)
def latest_verdict(spark, sf):
    return L.latest_per_key(A.verdicts(spark, sf), ["station_id"], ["qc_id"]).select(
        "station_id", "qc_id", "verdict", "fault_type"
    )


@query(
    "latest_feedback",
    O.with_(O.FEEDBACK)
    + "SELECT qc_result_id, feedback_id, label FROM feedback QUALIFY row_number() OVER (PARTITION BY qc_result_id ORDER BY created_at DESC, feedback_id DESC) = 1",
)
def latest_feedback(spark, sf):
    return L.latest_feedback(A.feedback(spark, sf)).select("qc_result_id", "feedback_id", "label")


@query(
    "active_alerts_per_station",
    O.with_(O.ALERTS) + "SELECT station_id, count(*) AS active_alerts FROM alerts WHERE status <> 'resolved' GROUP BY 1",
)
def active_alerts_per_station(spark, sf):
    return L.active_alerts_per_station(A.alerts(spark, sf))


@query(
    "alert_tiles",
    O.with_(O.ALERTS, O.FEEDBACK)
    + """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'open') AS open, count(*) FILTER (WHERE severity = 'critical') AS critical,
         count(*) FILTER (WHERE qc_result_id IN (SELECT qc_result_id FROM feedback)) AS with_feedback FROM alerts""",
)
def alert_tiles(spark, sf):
    return L.alert_tiles(A.alerts(spark, sf), A.feedback(spark, sf))


@query(
    "live_stats",
    O.with_(O.LONG)
    + """, buffered AS (SELECT *, row_number() OVER (PARTITION BY station_id, variable ORDER BY ts DESC) AS r FROM readings_long QUALIFY r <= 15),
         present AS (SELECT *, row_number() OVER (PARTITION BY station_id, variable, value IS NULL ORDER BY r) AS p FROM buffered)
         SELECT station_id, variable, round(min(value), 6) AS min, round(max(value), 6) AS max,
           round(avg(CASE WHEN p <= 5 THEN value END), 9) AS mean_last,
           round(max(CASE WHEN r = 1 THEN value END) - max(CASE WHEN r = 2 THEN value END), 6) AS delta
         FROM present GROUP BY 1, 2""",
)
def live_stats(spark, sf):
    return L.live_stats(A.readings_long(spark, sf), 15, 5).select(
        "station_id",
        "variable",
        F.round("min", 6).alias("min"),
        F.round("max", 6).alias("max"),
        F.round("mean_last", 9).alias("mean_last"),
        F.round("delta", 6).alias("delta"),
    )


@query(
    "live_buffer",
    f"""WITH points AS (SELECT user_id AS station_id, date_trunc('hour', ts) AS slot, event_id, value FROM events
            QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id DESC) = 1)
        SELECT station_id, event_id, value FROM points QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY slot DESC) <= 20""",
)
def live_buffer(spark, sf):
    points = A.events(spark, sf).select(
        F.col("user_id").alias("station_id"), F.date_trunc("hour", "ts").alias("at"), "event_id", "value"
    )
    return L.live_buffer(points, ["station_id"], "at", "event_id", 20).select("station_id", "event_id", "value")


@query(
    "recent_readings",
    O.with_(O.READINGS)
    + "SELECT reading_id, station_id FROM readings QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY ts DESC) <= 10",
)
def recent_readings(spark, sf):
    return L.newest_per_key(A.readings(spark, sf), ["station_id"], ["ts"], 10).select("reading_id", "station_id")


@query(
    "page",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price, (SELECT count(*) FROM lineitem) AS total FROM lineitem
       ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25 OFFSET 50""",
)
def page(spark, sf):
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    return L.page(A.table(spark, sf, "lineitem"), order, 50, 25).select(
        "l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("price"), "total"
    )


def _sql_tile(lat: str, lon: str, zoom: int) -> tuple[str, str]:
    n = float(2**zoom)
    return (
        f"CAST(trunc(({lon} + 180.0) / 360.0 * {n}) AS INTEGER)",
        f"CAST(trunc((1.0 - asinh(tan(radians({lat}))) / pi()) / 2.0 * {n}) AS INTEGER)",
    )


_WEST_SOUTH, _EAST_NORTH = _sql_tile("22.0", "70.25", 9), _sql_tile("25.5", "74.75", 9)


@query(
    "tile_range",
    O.with_(O.STATIONS)
    + f"""SELECT tile_x, tile_y, count(*) AS stations FROM (SELECT {_sql_tile('latitude', 'longitude', 9)[0]} AS tile_x, {_sql_tile('latitude', 'longitude', 9)[1]} AS tile_y FROM stations)
          WHERE tile_x BETWEEN {_WEST_SOUTH[0]} AND {_EAST_NORTH[0]} AND tile_y BETWEEN {_EAST_NORTH[1]} AND {_WEST_SOUTH[1]} GROUP BY 1, 2""",
)
def tile_range(spark, sf):
    """Stations per tile, for the tiles that a box touches."""
    box = R.tile_range(22.0, 70.25, 25.5, 74.75, 9)
    tiled = R.tile_assign(A.stations(spark, sf), 9)
    inside = F.col("tile_x").between(box["x_first"], box["x_last"]) & F.col("tile_y").between(box["y_first"], box["y_last"])
    return tiled.filter(inside).groupBy("tile_x", "tile_y").agg(F.count(F.lit(1)).alias("stations"))
