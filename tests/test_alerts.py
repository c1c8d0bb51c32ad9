from __future__ import annotations

import random
from datetime import timedelta

import pytest
from conftest import T0
from pyspark.sql import functions as F

from stratusqc.functions.alerts import alert_message, severity
from stratusqc.operators import alerts as AL


@pytest.mark.parametrize(
    "verdict,confidence,reason,expected",
    [("valid", 1.0, "VALID_READING", None), ("anomalous", 0.99, "RULE_RANGE", "critical"),
     ("anomalous", 0.96, "SPATIAL_MISMATCH", "critical"), ("anomalous", 0.92, "SPATIAL_MISMATCH", "high"),
     ("anomalous", 0.98, "RULE_FLATLINE", "high"), ("anomalous", 0.95, "RULE_STEP", "high"),
     ("anomalous", 0.75, "ML_ISOFOREST", "medium"), ("anomalous", 0.69, "ML_ISOFOREST", "low"),
     ("anomalous", 0.9, "ML_LSTM_AE", "medium"), ("suspect", 0.6, "ML_BORDERLINE", "low")],
)
def test_severity(spark, verdict, confidence, reason, expected):
    df = spark.createDataFrame([(verdict, confidence, reason)], "v string, c double, r string")
    assert df.select(severity(F.col("v"), F.col("c"), F.col("r"))).first()[0] == expected


def test_message_wording(spark):
    df = spark.range(1)
    lit = F.lit
    text = alert_message(
        lit("critical"), lit("Hill Top"), lit("ST9"), lit("wind_speed"), lit("RULE_RANGE"), lit(0.99), lit(65.0),
        lit(None).cast("int"), *[lit(None).cast("double")] * 5,
    )
    assert df.select(text).first()[0] == (
        "[CRITICAL] Hill Top (ST9) - Wind_speed: Sensor value 65.0 breached physical bounds (Confidence: 99%)."
    )


def fold(rows, cooldown):
    """Plain sequential fold."""
    alerts: dict = {}
    standing: dict = {}
    for at, qc, station, variable, sev in sorted(rows):
        key = (station, variable)
        a = standing.get(key)
        if a is None or at > alerts[a]["at"] + cooldown:
            standing[key] = a = qc
            alerts[a] = {"at": at, "last": qc, "severity": sev, "n": 1}
            continue
        alerts[a]["last"], alerts[a]["n"] = qc, alerts[a]["n"] + 1
        if sev in ("high", "critical") and alerts[a]["severity"] not in ("high", "critical"):
            alerts[a]["severity"] = sev
    return {k: (v["last"], v["severity"], v["n"]) for k, v in alerts.items()}


@pytest.mark.parametrize("seed,span", [(1, 7200), (2, 86400), (3, 3601), (4, 600000)])
def test_folding_equals_sequential_fold(spark, seed, span):
    """A hot key with unbroken chains over many spans, exact ties at the cooldown, and quiet keys."""
    rng = random.Random(seed)
    rows, minute = [], 0
    for qc in range(700):
        minute += rng.choice([0, 1, 7, 20, 30, 60, 60, 61, 900] if seed % 2 else [5, 10, 15, 20])
        key = (1, "temperature") if rng.random() < 0.7 else (rng.randint(1, 4), rng.choice(["humidity", "temperature"]))
        rows.append((minute, qc, *key, rng.choice(["low", "medium", "high", "critical"])))
    df = spark.createDataFrame(
        [(qc, s, v, sev, T0 + timedelta(minutes=m)) for m, qc, s, v, sev in rows],
        "qc_id long, station_id long, variable string, severity string, created_at timestamp",
    )
    got = {r["alert_id"]: (r["last_qc_id"], r["severity"], r["n_folded"]) for r in AL.debounce_alerts(df, 60, span).collect()}
    assert got == fold(rows, 60)


def dense(spark, n, seed, days, start=T0):
    """Candidates of one busy and one quiet key at random microseconds, some at exact cooldowns after others."""
    rng = random.Random(seed)
    rows = []
    for qc in range(n):
        at = rng.randrange(days * 86_400_000_000)
        if rows and rng.random() < 0.2:
            at = rng.choice(rows)[0] + 60_000_000 * rng.choice([60, 1440, 2880])
        rows.append((at, qc, 1 if rng.random() < 0.95 else 2, "temperature", rng.choice(["low", "medium", "high", "critical"])))
    frame = [(qc, s, v, sev, start + timedelta(microseconds=at)) for at, qc, s, v, sev in rows]
    return rows, spark.createDataFrame(frame, "qc_id long, station_id long, variable string, severity string, created_at timestamp")


@pytest.mark.parametrize("cooldown", [60, 1440, 2880])
@pytest.mark.parametrize("span", [1800, 86400])
def test_folding_over_many_levels(spark, cooldown, span):
    """Ten weeks in spans that are shorter, as long and longer than the cooldown, begun before 1970."""
    rows, df = dense(spark, 900, cooldown + span, 70, T0.replace(year=1969, month=12, day=1))
    got = {r["alert_id"]: (r["last_qc_id"], r["severity"], r["n_folded"]) for r in AL.debounce_alerts(df, cooldown, span).collect()}
    assert got == fold(rows, cooldown * 60_000_000)


@pytest.mark.parametrize("cooldown", [60, 1440, 2880])
def test_effects_are_short_however_dense_the_candidates(spark, cooldown):
    """A busy key with 20,000 candidates in 64 days: what eight days or more do takes few steps, not one a candidate."""
    _, df = dense(spark, 20_000, cooldown, 64)
    effects = AL.span_effects(df, cooldown, 86400).withColumnRenamed("span", "stretch")
    one = AL.joint_effects(effects, cooldown, 8 * 86_400_000_000)
    two = AL.joint_effects(one, cooldown, 64 * 86_400_000_000)
    steps = lambda e: e.agg(F.max(F.size("start_at"))).first()[0]
    assert steps(one) <= 250 and steps(two) <= 60
    if cooldown == 60:
        assert steps(effects) <= 60


def test_no_candidates_no_alerts(spark):
    _, df = dense(spark, 3, 1, 1)
    assert AL.debounce_alerts(df.filter("qc_id < 0")).count() == 0


def test_second_failure_ten_minutes_later_folds(spark):
    df = spark.createDataFrame(
        [(1, 7, "temperature", "medium", T0), (2, 7, "temperature", "critical", T0 + timedelta(minutes=10))],
        "qc_id long, station_id long, variable string, severity string, created_at timestamp",
    )
    (alert,) = AL.debounce_alerts(df).collect()
    assert (alert["alert_id"], alert["last_qc_id"], alert["severity"], alert["n_folded"]) == (1, 2, "critical", 2)


def alerts_frame(spark, *statuses):
    return spark.createDataFrame(
        [(i, i, s, None) for i, s in enumerate(statuses)],
        "alert_id long, qc_result_id long, status string, resolved_at timestamp",
    )


def test_feedback_moves_status(spark):
    alerts = alerts_frame(spark, "open", "open", "open", "acknowledged", "resolved")
    feedback = spark.createDataFrame(
        [(0, "confirmed_fault", T0), (1, "false_alarm", T0), (2, "unsure", T0), (3, "confirmed_fault", T0), (4, "confirmed_fault", T0)],
        "qc_result_id long, label string, created_at timestamp",
    )
    got = {r["alert_id"]: (r["status"], r["resolved_at"]) for r in AL.apply_feedback(alerts, feedback).collect()}
    assert got == {0: ("acknowledged", None), 1: ("resolved", T0), 2: ("open", None), 3: ("acknowledged", None), 4: ("resolved", None)}


def test_newest_status_wins(spark):
    events = spark.createDataFrame(
        [(0, "resolved", T0 + timedelta(hours=1)), (0, "open", T0 + timedelta(hours=2))],
        "alert_id long, new_status string, event_ts timestamp",
    )
    rows = {r["alert_id"]: (r["status"], r["resolved_at"]) for r in AL.apply_status(alerts_frame(spark, "open", "open"), events).collect()}
    assert rows == {0: ("open", T0 + timedelta(hours=1)), 1: ("open", None)}


@pytest.mark.parametrize("cooldown", [1, 60, 5000])
def test_open_alert_lookup_equals_brute_force(spark, cooldown):
    """Crowded alerts on one key, ties at both ends of the cooldown, keys without alerts."""
    rng = random.Random(cooldown)
    key = lambda: (1, "t") if rng.random() < 0.7 else (rng.randint(2, 4), "t")
    alerts = [(i, *key(), rng.choice(["open", "open", "resolved"]), rng.randint(0, 900)) for i in range(200)]
    asked = [(i, *key(), rng.randint(0, 1000)) for i in range(300)]
    at = lambda m: T0 + timedelta(minutes=m)
    a = spark.createDataFrame([(i, s, v, st, at(m)) for i, s, v, st, m in alerts],
                              "alert_id long, station_id long, variable string, status string, created_at timestamp")
    c = spark.createDataFrame([(i, s, v, at(m)) for i, s, v, m in asked],
                              "qc_id long, station_id long, variable string, created_at timestamp")
    expected = {}
    for i, s, v, m in asked:
        hits = [(am, ai) for ai, s2, v2, st, am in alerts if (s2, v2, st) == (s, v, "open") and m - cooldown <= am <= m]
        if hits:
            expected[i] = min(hits)[1]
    got = {r["qc_id"]: r["alert_id"] for r in AL.open_alert_within_cooldown(c, a, cooldown).collect()}
    assert got == expected
