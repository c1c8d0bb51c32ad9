"""Queries that run the streaming jobs over the tables' files to completion."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from stratusqc import adapters as A
from stratusqc.constants import VARIABLES
from stratusqc.functions.alerts import severity
from stratusqc.operators import spatial as S
from stratusqc.plans import oracle as O
from stratusqc.plans.cleaning import _RAW, raw_rows
from stratusqc.plans.operations import _chain, _recursive, status_events
from stratusqc.plans.registry import ORACLES, query, stamp
from stratusqc.session import scratch_dir, write_and_reread
from stratusqc.streaming import gate as G
from stratusqc.streaming import jobs as J
from stratusqc.sources.sinks import write_csv

def events_stream(spark, sf):
    schema = A.table(spark, sf, "events").schema
    return J.file_stream(spark, sf, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def event_readings(stream):
    """Each event as a reading of all sensors at its exact time: steep, stepped, circular, mostly nought."""
    value, eid = F.col("value"), F.col("event_id")
    sensors = {
        "temperature": value,
        "humidity": F.floor(F.least(value, F.lit(60.0)) / 20),
        "pressure": value / 2,
        "wind_speed": F.floor(value / 50),
        "wind_direction": eid % 380,
        "rainfall": F.floor(F.greatest(value - 80, F.lit(0.0))),
        "solar_radiation": F.when(eid % 5 > 0, value * 2),
    }
    return stream.select(
        eid.alias("reading_id"), F.col("user_id").alias("station_id"), "ts", *[c.cast("double").alias(v) for v, c in sensors.items()]
    )


_LONG = """
readings_long AS (
  SELECT event_id AS reading_id, user_id AS station_id, ts, variable, CAST(x AS DOUBLE) AS value
  FROM (SELECT *, value AS temperature, floor(least(value, 60.0) / 20) AS humidity, value / 2 AS pressure,
          floor(value / 50) AS wind_speed, CAST(event_id % 380 AS DOUBLE) AS wind_direction,
          floor(greatest(value - 80, 0.0)) AS rainfall, CASE WHEN event_id % 5 > 0 THEN value * 2 END AS solar_radiation FROM events)
  UNPIVOT INCLUDE NULLS (x FOR variable IN (temperature, humidity, pressure, wind_speed, wind_direction, rainfall, solar_radiation)))"""


@query(
    "stream_ingest",
    O.with_(_RAW, O.STATIONS)
    + """SELECT coalesce(CASE WHEN ts IS NULL THEN 'timestamp_invalid' WHEN wind_direction < 0 OR wind_direction > 360 THEN 'wind_direction_out_of_bounds' END,
           CASE WHEN s.station_id IS NULL THEN 'unknown_station' END, 'accepted') AS outcome, count(*) AS n, round(sum(temperature), 4) AS total
         FROM typed t LEFT JOIN stations s ON upper(trim(t.station_code)) = s.station_code GROUP BY 1""",
)
def stream_ingest(spark, sf):
    """Raw CSV files, written to the shared folder, as a stream through cleaning to accepted and rejected rows."""
    path = scratch_dir(spark, "stream-csv")
    raw = raw_rows(spark, sf)
    write_csv(raw, path)
    schema = ", ".join(f"`{c.strip()}` {'bigint' if c == 'event_id' else 'string'}" for c in raw.columns)
    stream = J.file_stream(spark, path, schema, "*.csv", "csv")
    done = J.run_to_table(J.stream_ingest(stream, A.stations(spark, sf), ("event_id",)), "ingest")
    return done.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("temperature"), 4).alias("total")
    )


@query(
    "stream_dedup",
    """SELECT user_id AS station_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS ts, count(*) AS rows_kept
       FROM (SELECT DISTINCT user_id, date_trunc('hour', ts) AS ts FROM events) GROUP BY 1, 2""",
)
def stream_dedup(spark, sf):
    hourly = events_stream(spark, sf).select(
        F.col("user_id").alias("station_id"), F.date_trunc("hour", "ts").alias("ts"), "value"
    )
    done = J.run_to_table(J.stream_dedup(hourly), "dedup")
    return done.groupBy("station_id", stamp("ts").alias("ts")).agg(F.count(F.lit(1)).alias("rows_kept"))


@query(
    "stream_rules",
    O.with_(_LONG, O.STATIONS, O.SPECS, O.RULES)
    + "SELECT reading_id, variable, rule_reason AS reason_code FROM ruled",
)
def stream_rules(spark, sf):
    stream = event_readings(events_stream(spark, sf))
    stations = write_and_reread(A.stations(spark, sf), "stations")
    return J.run_to_table(J.stream_rules(stream, stations), "rules").select(
        "reading_id", "variable", "reason_code"
    )


_HOURLY = """
hourly AS (SELECT user_id AS station_id, date_trunc('day', ts) AS ts, event_type AS variable, event_id, value FROM events),
readings_long AS (SELECT station_id, ts, variable, max(value) AS value FROM hourly GROUP BY 1, 2, 3),
pairs_seen AS (SELECT e.station_id, h.ts, h.variable, h.value FROM edges e JOIN hourly h ON h.station_id = e.neighbor_id),
near AS (SELECT station_id, ts, variable, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM pairs_seen GROUP BY 1, 2, 3)"""


@query(
    "stream_spatial",
    O.with_(O.STATIONS, O.KNN, _HOURLY)
    + """SELECT l.station_id, strftime(l.ts, '%Y-%m-%d') AS day, l.variable, coalesce(n, 0) AS n,
         CASE WHEN coalesce(n, 0) < 2 THEN 'SPATIAL_INSUFFICIENT_DATA'
              WHEN abs(value - mean) / greatest(std, 1.0) >= 3.0 AND abs(value - mean) >= 3.5 THEN 'SPATIAL_MISMATCH' ELSE 'SPATIAL_CONSISTENT' END AS reason_code
         FROM readings_long l LEFT JOIN near USING (station_id, ts, variable)""",
)
def stream_spatial(spark, sf):
    """Day-aligned sensor values against the neighbours' of that day, the last one too."""
    long = events_stream(spark, sf).select(
        F.col("user_id").alias("station_id"), F.date_trunc("day", "ts").alias("ts"), F.col("event_type").alias("variable"), "value"
    )
    edges = write_and_reread(S.knn_stations(A.stations(spark, sf)), "edges")
    long, drain = J.with_drain(long, "ts", "spatial", filled={"station_id": -1, "value": 0.0})
    return J.run_to_table(J.stream_spatial(long, edges), "spatial", drain=drain).select(
        "station_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "variable", "n", F.col("spatial_reason").alias("reason_code")
    )


def candidates_stream(spark, sf):
    """Flagged events as alert candidates."""
    value, eid = F.col("value"), F.col("event_id")
    names = F.array(*[F.lit(v) for v in VARIABLES])
    reasons = F.array(*[F.lit(r) for r in ("RULE_RANGE", "RULE_FLATLINE", "RULE_STEP", "ML_AND_SPATIAL_CONFIRMED",
                                           "SPATIAL_MISMATCH", "ML_ISOFOREST", "ML_LSTM_AE")])
    verdict = F.when(value >= 90, "anomalous").otherwise("suspect")
    return events_stream(spark, sf).filter(value >= 60).select(
        eid.alias("qc_id"),
        F.col("user_id").alias("station_id"),
        F.get(names, (F.floor(eid / 7) % 7).cast("int")).alias("variable"),
        severity(verdict, (50 + eid % 50) / F.lit(100.0), F.get(reasons, (eid % 7).cast("int"))).alias("severity"),
        F.col("ts").alias("created_at"),
    )


@query(
    "stream_debounce",
    _recursive(O.VERDICTS, _chain("verdicts", 1440)) + "SELECT qc_id, alert_id FROM owned",
)
def stream_debounce(spark, sf):
    candidates, drain = J.with_drain(candidates_stream(spark, sf), "created_at", "debounce")
    return J.run_to_table(J.stream_debounce(candidates, 1440), "debounce", drain=drain).select("qc_id", "alert_id")


@query(
    "stream_alerts",
    _recursive(O.VERDICTS, _chain("verdicts", 1440))
    + f"SELECT c.qc_id AS alert_id, c.station_id, c.variable, c.severity, {O.stamp('c.ts')} AS created_at FROM candidates c JOIN anchors a USING (qc_id)",
)
def stream_alerts(spark, sf):
    candidates, drain = J.with_drain(candidates_stream(spark, sf), "created_at", "alerts")
    opened = J.stream_alerts(J.stream_debounce(candidates, 1440))
    return J.run_to_table(opened, "alerts", drain=drain).withColumn("created_at", stamp("created_at"))


class Arrivals:
    """A table as two deliveries of a stream: rows before a day, then the others; then the row that ends it."""

    def __init__(self, spark, df, time, label, **filled):
        self.early = F.col(time) < "2024-01-20"
        self.df, self.folder = write_and_reread(df, f"{label}-rows"), scratch_dir(spark, f"{label}-arrivals")
        spark.createDataFrame([], df.schema).write.parquet(self.folder)
        stream = J.file_stream(spark, self.folder, df.schema, max_files=100_000)
        self.stream, self.drain = J.with_drain(stream, time, label, filled=filled)

    def deliver(self, first):
        self.df.filter(self.early if first else ~self.early).write.mode("append").parquet(self.folder)


def run_arrivals(spark, stream, label, *arrivals):
    """Both deliveries one after the other through one checkpoint, then the end."""
    path = scratch_dir(spark, label)
    for first in (True, False):
        for a in arrivals:
            a.deliver(first)
        done = J.run_to_table(stream, label, path, None if first else [a.drain for a in arrivals])
    return done


@query("stream_status", ORACLES["apply_status"])
def stream_status(spark, sf):
    """Alerts and status changes as two streams; the result is that of the batch operator."""
    batch = A.alerts(spark, sf)
    alerts = Arrivals(spark, batch, "created_at", "alerts", alert_id=-1)
    events = Arrivals(spark, status_events(batch), "event_ts", "status-events", alert_id=-1)
    moved = J.stream_status(alerts.stream, events.stream)
    done = run_arrivals(spark, moved, "status", alerts, events)
    return done.select("alert_id", "status", stamp("resolved_at").alias("resolved_at"))


@query("stream_feedback", ORACLES["apply_feedback"])
def stream_feedback(spark, sf):
    """Alerts and the operators' feedback as two streams; feedback counts for ten years."""
    alerts = Arrivals(spark, A.alerts(spark, sf), "created_at", "alerts", qc_result_id=-1)
    given = A.feedback(spark, sf).withColumnRenamed("created_at", "given_at")
    feedback = Arrivals(spark, given, "given_at", "feedback", qc_result_id=-1)
    moved = J.stream_feedback(alerts.stream, feedback.stream, "3650 days")
    return run_arrivals(spark, moved, "feedback", alerts, feedback).select("alert_id", "status")


@query("stream_open_alerts", ORACLES["open_alert_within_cooldown"])
def stream_open_alerts(spark, sf):
    """Flagged verdicts and open alerts as two streams."""
    qc = A.verdicts(spark, sf).filter("verdict <> 'valid'").select("qc_id", "station_id", "variable", "created_at")
    named = qc.select(F.col("qc_id").alias("qc_result_id"), "variable")
    opened = A.alerts(spark, sf).join(named, "qc_result_id")
    end = {"station_id": -1, "variable": "", "status": "open"}
    candidates = Arrivals(spark, qc, "created_at", "candidates", **{k: v for k, v in end.items() if k != "status"})
    alerts = Arrivals(spark, opened, "created_at", "open-alerts", **end)
    found = J.stream_open_alerts(candidates.stream, alerts.stream, 600)
    return run_arrivals(spark, found, "open-alerts", candidates, alerts).select("qc_id", "alert_id")


@query(
    "stream_window_stats",
    """WITH spread AS (
         SELECT user_id AS station_id, event_type AS variable, value,
           date_trunc('hour', ts) - to_hours(h) AS start FROM events, range(10) r(h))
       SELECT station_id, variable, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean
       FROM spread GROUP BY station_id, variable, spread.start""",
)
def stream_window_stats(spark, sf):
    long = events_stream(spark, sf).select(
        F.col("user_id").alias("station_id"), "ts", F.col("event_type").alias("variable"), "value"
    )
    long, drain = J.with_drain(long, "ts", "window-stats")
    return J.run_to_table(J.stream_window_stats(long), "window-stats", drain=drain).select(
        "station_id", "variable", stamp("start").alias("start"), "n", "min", "max", F.round("mean", 6).alias("mean")
    )


@query(
    "stream_dropout",
    """SELECT user_id AS station_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY 1
       HAVING max(ts) + INTERVAL 8 HOUR < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def stream_dropout(spark, sf):
    """Stations silent for eight hours when the month ends."""
    readings = event_readings(events_stream(spark, sf))
    return J.run_to_table(J.stream_dropout(readings, 480), "dropout").select(
        "station_id", stamp(F.timestamp_micros("last_at")).alias("last_seen")
    )


@query(
    "stream_late_rows",
    """WITH newest AS (SELECT max(ts) - INTERVAL 3 DAY AS mark FROM events WHERE event_id % 10 > 0)
       SELECT event_id, user_id AS station_id, value, CASE WHEN event_id % 10 = 0 AND ts < mark THEN 'late' ELSE 'accepted' END AS outcome FROM events, newest""",
)
def stream_late_rows(spark, sf):
    """Files that arrive out of order, a folder read on three times: all rows come out, those too late as rejects."""
    events, folder, path = A.events(spark, sf), scratch_dir(spark, "arrivals"), scratch_dir(spark, "gate")
    punctual, early = F.col("event_id") % 10 > 0, F.col("ts") < "2024-01-20"
    for chosen in (punctual & early, punctual & ~early, ~punctual):
        events.filter(chosen).write.mode("append").parquet(folder)
        stream = J.file_stream(spark, folder, events.schema, max_files=100_000)
        G.run_gate(stream, path, "ts", timedelta(days=3))
    rows = G.gated(spark, path, events.schema)
    return rows.select("event_id", F.col("user_id").alias("station_id"), "value", "outcome")
