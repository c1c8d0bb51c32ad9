from __future__ import annotations

import random
from datetime import timedelta

import pytest
from conftest import T0

from stratusqc.operators import alerts as AL
from stratusqc.streaming import jobs as J

ALERTS = "alert_id long, qc_result_id long, station_id long, variable string, status string, resolved_at timestamp, created_at timestamp"


class Feed:
    """A folder that is streamed; ``add`` delivers rows, ``drain`` ends it."""

    def __init__(self, spark, folder, schema, time, **filled):
        self.spark, self.folder, self.schema = spark, str(folder), schema
        spark.createDataFrame([], schema).write.parquet(self.folder)
        self.stream, self.drain = J.with_drain(
            J.file_stream(spark, self.folder, spark.createDataFrame([], schema).schema), time, "feed", filled=filled
        )

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).write.mode("append").parquet(self.folder)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def alert_rows(rng, n):
    return [(i, 100 + i, rng.randint(1, 2), "t", rng.choice(["open", "acknowledged", "resolved"]), None, at(i * 37)) for i in range(n)]


def run(spark, stream, path, *feeds):
    """``feeds``: (feed, rows sorted by time); half of the rows of each come first."""
    for part in (0, 1):
        for feed, rows in feeds:
            half = len(rows) // 2
            if chunk := (rows[:half], rows[half:])[part]:
                feed.add(chunk)
        done = J.run_to_table(stream, "t", path, [feed.drain for feed, _ in feeds] if part else None)
    return done


def test_status_changes_on_a_stream_equal_the_batch(spark, tmp_path):
    """Alerts without, with one and with many changes, before the alert's time and after the horizon."""
    rng = random.Random(4)
    alerts = alert_rows(rng, 30)
    events = sorted(
        [(rng.randrange(35), rng.choice(["open", "acknowledged", "resolved"]), at(37 * rng.randrange(40) + k / 60)) for k in range(60)],
        key=lambda e: e[2],
    )
    schema = "alert_id long, new_status string, event_ts timestamp"
    a = Feed(spark, tmp_path / "a", ALERTS, "created_at", alert_id=-1)
    e = Feed(spark, tmp_path / "e", schema, "event_ts", alert_id=-1)
    done = run(spark, J.stream_status(a.stream, e.stream, "10 hours", "2 days"), str(tmp_path / "run"), (a, alerts), (e, events))
    got = {r["alert_id"]: (r["status"], r["resolved_at"]) for r in done.collect()}
    raised = {r[0]: r[-1] for r in alerts}
    counted = [m for m in events if m[0] in raised and raised[m[0]] <= m[2] <= raised[m[0]] + timedelta(hours=10)]
    batch = AL.apply_status(spark.createDataFrame(alerts, ALERTS), spark.createDataFrame(counted, schema))
    assert got == {r["alert_id"]: (r["status"], r["resolved_at"]) for r in batch.collect()}
    assert len(got) == 30 and len(counted) > 10


def test_feedback_on_a_stream_equals_the_batch(spark, tmp_path):
    rng = random.Random(5)
    alerts = alert_rows(rng, 30)
    given = [(100 + rng.randrange(33), rng.choice(["confirmed_fault", "false_alarm", "unsure", None]), at(1200 + k)) for k in range(40)]
    a = Feed(spark, tmp_path / "a", ALERTS, "created_at", qc_result_id=-1)
    f = Feed(spark, tmp_path / "f", "qc_result_id long, label string, given_at timestamp", "given_at", qc_result_id=-1)
    done = run(spark, J.stream_feedback(a.stream, f.stream, "30 days", "2 days"), str(tmp_path / "run"), (a, alerts), (f, given))
    got = {r["alert_id"]: (r["status"], r["resolved_at"]) for r in done.collect()}
    batch = AL.apply_feedback(
        spark.createDataFrame(alerts, ALERTS), spark.createDataFrame(given, "qc_result_id long, label string, created_at timestamp")
    )
    later = {r[0] for r in alerts if r[-1] > at(1200)}
    expected = {r["alert_id"]: (r["status"], r["resolved_at"]) for r in batch.collect()}
    assert {k: v for k, v in got.items() if k not in later} == {k: v for k, v in expected.items() if k not in later}
    assert len(got) == 30


def test_open_alerts_on_a_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(6)
    alerts = alert_rows(rng, 40)
    asked = [(i, rng.randint(1, 3), "t", at(i * 20)) for i in range(80)]
    schema = "qc_id long, station_id long, variable string, created_at timestamp"
    end = {"station_id": -1, "variable": ""}
    c = Feed(spark, tmp_path / "c", schema, "created_at", **end)
    a = Feed(spark, tmp_path / "a", ALERTS, "created_at", status="open", **end)
    done = run(spark, J.stream_open_alerts(c.stream, a.stream, 120, "2 days"), str(tmp_path / "run"), (c, asked), (a, alerts))
    batch = AL.open_alert_within_cooldown(spark.createDataFrame(asked, schema), spark.createDataFrame(alerts, ALERTS), 120)
    assert sorted(map(tuple, done.select("qc_id", "alert_id").collect())) == sorted(map(tuple, batch.collect()))


def test_a_drained_path_is_not_run_again(spark, tmp_path):
    a = Feed(spark, tmp_path / "a", ALERTS, "created_at", status="open")
    a.add(alert_rows(random.Random(1), 3))
    stream = a.stream.withWatermark("created_at", "1 hour").dropDuplicatesWithinWatermark(["alert_id"])
    assert J.run_to_table(stream, "t", str(tmp_path / "run")).count() == 3
    J.run_to_table(stream, "t", str(tmp_path / "run"), a.drain)
    with pytest.raises(ValueError, match="drained"):
        J.run_to_table(stream, "t", str(tmp_path / "run"))
