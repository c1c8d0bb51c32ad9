from __future__ import annotations

from datetime import date, timedelta

import pytest
from conftest import T0
from pyspark.sql import functions as F

from stratusqc.operators import health as H
from stratusqc.operators import integrity as IN
from stratusqc.operators import listings as L

QC = "qc_id long, reading_id long, station_id long, variable string, verdict string, reason_code string, fault_type string, confidence double, created_at timestamp"
ALERTS = "alert_id long, station_id long, qc_result_id long, severity string, status string, created_at timestamp"


def qc_rows(spark, *rows):
    return spark.createDataFrame(
        [(i, i, s, "temperature", v, "X", f, 0.9, T0) for i, (s, v, f) in enumerate(rows)], QC
    )


def alert_rows(spark, *rows):
    return spark.createDataFrame([(i, s, i, sev, st, T0) for i, (s, sev, st) in enumerate(rows)], ALERTS)


def test_health_life_cycle(spark, make_readings, make_stations):
    stations = make_stations(*[(i, 28.0 + i, 77.0) for i in range(1, 7)]).withColumn(
        "status", F.when(F.col("station_id") == 6, "maintenance").otherwise("active")
    )
    readings = make_readings({i: {"temperature": [20.0, 21.0]} for i in (2, 3, 4, 5, 6)})
    qc = qc_rows(spark, (3, "anomalous", "spike"), (3, "valid", None), (4, "valid", None), (4, "suspect", "drift"), (6, "valid", None))
    alerts = alert_rows(spark, (5, "high", "acknowledged"), (2, "high", "resolved"))
    health = H.station_health(stations, readings, qc, alerts)
    got = {r["station_id"]: r["health_status"] for r in health.collect()}
    assert got == {1: "offline", 2: "healthy", 3: "healthy", 4: "suspect", 5: "anomalous", 6: "offline"}
    counts = H.fleet_health_counts(health).first().asDict()
    assert counts == {"total": 6, "healthy_count": 2, "suspect_count": 1, "anomalous_count": 1, "offline_count": 2}
    detail = H.station_detail(stations, readings, qc, alerts, 1)
    assert detail.filter("station_id = 5").groupBy("section").count().count() == 3


def test_live_patch(spark, make_readings, make_stations):
    stations = make_stations((1, 28.0, 77.0), (2, 28.1, 77.0))
    health = H.station_health(stations, make_readings({1: {"temperature": [1.0]}, 2: {"temperature": [1.0]}}), qc_rows(spark), alert_rows(spark))
    news = alert_rows(spark, (1, "high", "open"), (1, "high", "open")).withColumn("fault_type", F.lit("spike"))
    got = {r["station_id"]: (r["health_status"], r["active_alerts"], r["latest_fault_type"]) for r in H.apply_live_alerts(health, news).collect()}
    assert got == {1: ("anomalous", 2, "spike"), 2: ("healthy", 0, None)}


def test_risk_grows_with_damage(spark, make_readings, make_stations):
    ages = {1: date(2023, 1, 1), 2: date(2021, 6, 1), 3: date(2019, 3, 1), 4: date(2023, 1, 1)}
    pairs = [x for i, d in ages.items() for x in (F.lit(i), F.lit(d))]
    stations = make_stations(*[(i, 28.0 + i, 77.0) for i in ages]).withColumn("install_date", F.create_map(*pairs)[F.col("station_id")])
    readings = make_readings({i: {"temperature": [20.0] * 20} for i in (1, 2, 3)})
    qc = qc_rows(
        spark, *[(2, "suspect", None)] * 3, (2, "anomalous", "drift"), *[(3, "anomalous", "drift")] * 5, *[(3, "anomalous", "flatline")] * 4
    )
    alerts = alert_rows(spark, (2, "medium", "open"), (3, "critical", "open"), (3, "critical", "open"), (3, "critical", "resolved"))
    rows = {r["station_id"]: r for r in H.fleet_predictions(stations, readings, qc, alerts, "2024-06-15 00:00:00").collect()}
    p = {i: rows[i]["failure_probability"] for i in ages}
    assert p[1] < p[2] < p[3] and p[4] == 0.55
    assert rows[1]["risk_level"] == "nominal" and rows[1]["top_driver"] == "Nominal Baseline"
    assert rows[3]["risk_level"] == "critical" and rows[3]["top_driver"] == "High QC Anomaly Rate"
    assert rows[4]["top_driver"] == "Zero Telemetry Received"
    assert [rows[i]["risk_rank"] for i in (3, 4, 2, 1)] == [1, 2, 3, 4] or p[2] > 0.55
    # Full formula for the clean station: only its age counts.
    age = min(1.0, (date(2024, 6, 15) - ages[1]).days / 1825)
    assert p[1] == pytest.approx(round(1 / (1 + 2.718281828459045 ** (2.5 - 0.5 * age)), 4))
    summary = H.fleet_summary(H.fleet_predictions(stations, readings, qc, alerts, "2024-06-15 00:00:00")).first()
    assert summary["total_stations"] == 4 and summary["mean_failure_probability"] == pytest.approx(sum(p.values()) / 4, abs=1e-4)


def test_ranks_share_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.5), (4, 0.1)], "id long, p double")
    assert {r["id"]: r["rank"] for r in L.ranked_by_value(df, "p").collect()} == {2: 1, 1: 2, 3: 2, 4: 4}


def test_telemetry_range_and_limit(make_readings):
    readings = make_readings({1: {"temperature": [1, 2, 3, 4, 5]}})
    last = [r["temperature"] for r in L.telemetry_range(readings, 1, limit=2).collect()]
    assert last == [4.0, 5.0]
    inside = L.telemetry_range(readings, 1, str(T0 + timedelta(hours=1)), str(T0 + timedelta(hours=3)))
    assert [r["temperature"] for r in inside.collect()] == [2.0, 3.0, 4.0]


def test_page_total_counts_the_whole_list(spark):
    rows = L.page(spark.range(25), [F.col("id").desc()], 5, 3).collect()
    assert [(r["id"], r["total"]) for r in rows] == [(19, 25), (18, 25), (17, 25)]


def test_live_stats(make_readings):
    from stratusqc.operators.reshape import wide_to_long

    long = wide_to_long(make_readings({1: {"temperature": [9, 1, None, 3, 4]}})).filter("variable = 'temperature'")
    row = L.live_stats(long, buffer=4, last=2).first()
    assert (row["min"], row["max"], row["mean_last"], row["delta"]) == (1.0, 4.0, 3.5, 1.0)


def test_filters_accept_all(spark):
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    assert L.filtered(df, s="all").count() == L.filtered(df, s=None).count() == 2
    assert L.filtered(df, s="a").count() == 1


def test_integrity(spark, make_readings, make_stations):
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    child = spark.createDataFrame([(10, 1), (11, 3), (12, None)], "cid long, pid long")
    assert [r["cid"] for r in IN.orphans(child, parent, "pid", "id").collect()] == [11]
    assert IN.duplicate_keys(child.union(child), ["cid"]).count() == 3
    assert IN.outside_domain(spark.createDataFrame([("x",), (None,)], "s string"), "s", ["y"]).count() == 1
    readings = make_readings({1: {"temperature": [1.0] * 3}, 2: {"temperature": [1.0]}})
    qc = qc_rows(spark, (1, "valid", None), (2, "valid", None))
    feedback = spark.createDataFrame([(0,), (1,)], "qc_result_id long")
    left = IN.without_stations(make_stations((1, 0, 0)), readings, qc, alert_rows(spark, (1, "low", "open")), feedback)
    assert {k: v.count() for k, v in left.items()} == {"readings": 1, "qc": 1, "alerts": 0, "feedback": 1}


def test_gaps(make_readings):
    readings = make_readings({1: {"temperature": [1.0] * 8}}).filter("reading_id not in (1003, 1004)")
    (gap,) = IN.dropout_gaps(readings, 2.0, 3600).collect()
    assert gap["gap_seconds"] == 3 * 3600
