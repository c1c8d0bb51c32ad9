from __future__ import annotations

from datetime import timedelta

import pytest
from conftest import T0
from pyspark.sql import functions as F
from test_alerts import fold

from stratusqc.operators.qc import rule_verdicts
from stratusqc import adapters as A
from stratusqc.operators.spatial import knn_stations, neighbor_values
from stratusqc.plans import streams
from stratusqc.streaming import jobs as J

SCHEMA = "reading_id long, station_id long, ts timestamp, temperature double, humidity double"


def batches(spark, tmp_path, *frames):
    """One file per micro-batch, consumed in this order."""
    import os
    import shutil

    folder = tmp_path / "in"
    folder.mkdir()
    for i, df in enumerate(frames):
        df.coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        (part,) = [p for p in (tmp_path / f"w{i}").iterdir() if p.suffix == ".parquet"]
        target = folder / f"{i}.parquet"
        shutil.copy(part, target)
        os.utime(target, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    return J.file_stream(spark, str(folder), frames[0].schema, max_files=1)


def narrow(readings):
    return readings.select("reading_id", "station_id", "ts", "temperature", "humidity")


def series(n):
    return [20 + (i * 7 % 11) if i % 10 < 3 else 30.0 for i in range(n)]


def test_rules_over_batches_equal_batch(spark, tmp_path, make_readings, make_stations):
    readings = make_readings({1: {"temperature": series(60)}, 2: {"temperature": series(60)[::-1]}})
    stations = make_stations((1, 28.0, 77.0), (2, 28.1, 77.1))
    cut = [F.col("ts") < T0 + timedelta(hours=h) for h in (5, 29, 30)]
    parts = [cut[0], ~cut[0] & cut[1], ~cut[1] & cut[2], ~cut[2]]
    stream = batches(spark, tmp_path, *[narrow(readings.filter(c)) for c in parts])
    done = J.run_to_table(J.stream_rules(stream, stations, ["temperature", "humidity"]), "t", str(tmp_path / "o"))
    expected = rule_verdicts(readings, stations).filter("variable in ('temperature', 'humidity')")
    pick = lambda df: sorted((r["reading_id"], r["variable"], r["reason_code"]) for r in df.collect())
    assert pick(done) == pick(expected)


def test_late_reading_within_delay_sees_its_own_past_and_beyond_it_is_rejected(spark, tmp_path, make_readings, make_stations):
    readings = narrow(make_readings({1: {"temperature": [20.0, 40.0, 21.0, 22.0, 23.0, 24.0]}}))
    late = lambda *ids: F.col("reading_id").isin(*ids)
    stream = batches(spark, tmp_path, readings.filter(~late(1001, 1004)), readings.filter(late(1004)), readings.filter(late(1001)))
    done = J.run_to_table(J.stream_rules(stream, make_stations((1, 28.0, 77.0)), ["temperature"], delay_minutes=90), "t", str(tmp_path / "o"))
    got = {r["reading_id"]: (r["late"], r["reason_code"]) for r in done.collect()}
    assert got[1001] == (True, None)  # four hours late: not judged, and no step for its successor
    assert got[1004] == (False, "VALID_READING") and got[1002] == (False, "VALID_READING")
    assert len(got) == 6


def test_dedup_across_batches(spark, tmp_path, make_readings):
    readings = narrow(make_readings({1: {"temperature": [1.0, 2.0, 3.0]}}))
    stream = batches(spark, tmp_path, readings, readings, readings.filter("reading_id = 1002"))
    assert J.run_to_table(J.stream_dedup(stream, "1 day"), "t", str(tmp_path / "o")).count() == 3


@pytest.mark.parametrize("order", [(0, 1, 2), (1, 0, 2), (2, 1, 0)])
def test_debounce_across_batches(spark, tmp_path, order):
    """In whatever order batches bring the candidates, they fold as in event time."""
    rows = [(m, i, 1 + i % 2, "temperature", sev) for i, (m, sev) in enumerate(
        zip([0, 5, 30, 60, 61, 90, 200, 260, 261, 262], ["low", "high"] * 5))]
    df = spark.createDataFrame(
        [(qc, s, v, sev, T0 + timedelta(minutes=m)) for m, qc, s, v, sev in rows],
        "qc_id long, station_id long, variable string, severity string, created_at timestamp",
    )
    parts = [df.filter(F.col("qc_id").between(a, b)) for a, b in ((0, 2), (3, 5), (6, 9))]
    stream, drain = J.with_drain(batches(spark, tmp_path, *[parts[k] for k in order]), "created_at", "t")
    done = J.run_to_table(J.stream_debounce(stream, delay="1 day"), "t", str(tmp_path / "o"), drain)
    expected = fold(rows, 60)
    assert {r["alert_id"] for r in done.filter("opened").collect()} == set(expected)
    last = {}
    for r in done.orderBy("at", "qc_id").collect():
        last[r["alert_id"]] = (r["qc_id"], r["severity"])
    assert last == {k: (v[0], v[1]) for k, v in expected.items()}


def test_spatial_stream_equals_batch(spark, tmp_path, make_readings, make_stations):
    data = {s: {"temperature": [20.0 + s + (30 if (s, i) == (2, 1) else 0) for i in range(4)]} for s in range(1, 5)}
    readings = make_readings(data)
    edges = knn_stations(make_stations(*[(s, 28.0 + s * 0.1, 77.0) for s in range(1, 5)])).cache()
    long = readings.select("station_id", "ts", F.lit("temperature").alias("variable"), F.col("temperature").alias("value"))
    flush = long.limit(1).withColumn("ts", F.lit(T0 + timedelta(days=2)))
    stream = batches(spark, tmp_path, long, flush)
    done = J.run_to_table(J.stream_spatial(stream, edges), "t", str(tmp_path / "o")).filter(F.col("ts") < T0 + timedelta(days=1))
    batch = {(r["station_id"], r["ts"]): (r["n"], r["mean"]) for r in neighbor_values(long, edges).collect()}
    assert {(r["station_id"], r["ts"]): (r["n"], r["mean"]) for r in done.collect()} == batch
    assert done.filter("spatial_reason = 'SPATIAL_MISMATCH'").count() == 1


def test_silence_is_reported(spark, tmp_path, make_readings):
    readings = narrow(make_readings({1: {"temperature": [1.0] * 3}, 2: {"temperature": [1.0] * 30}}))
    half = F.col("ts") < T0 + timedelta(hours=15)
    stream = batches(spark, tmp_path, readings.filter(half), readings.filter(~half))
    done = J.run_to_table(J.stream_dropout(readings=stream, limit_minutes=600), "t", str(tmp_path / "o")).collect()
    assert [r["station_id"] for r in done] == [1]


SF = "/root/testdata/sf0.001"


def listed(df):
    return sorted(map(tuple, df.collect()))


def test_spatial_query_emits_the_last_day(spark):
    """The streamed query equals the same comparison over the whole table at once."""
    events = A.events(spark, SF)
    long = events.select(F.col("user_id").alias("station_id"), F.date_trunc("day", "ts").alias("ts"), F.col("event_type").alias("variable"), "value")
    whole = J.stream_spatial(long, knn_stations(A.stations(spark, SF)))
    expected = whole.select("station_id", F.date_format("ts", "yyyy-MM-dd"), "variable", "n", "spatial_reason")
    done = streams.stream_spatial(spark, SF)
    assert listed(done) == listed(expected)
    last = events.agg(F.date_format(F.max("ts"), "yyyy-MM-dd")).first()[0]
    assert done.agg(F.max("day")).first()[0] == last


def test_window_query_emits_the_last_windows(spark):
    """Every event is counted in each of its ten windows, and nothing else is."""
    done = streams.stream_window_stats(spark, SF)
    assert done.agg(F.sum("n")).first()[0] == 10 * A.events(spark, SF).filter("value is not null").count()
    assert done.filter("station_id is null or start >= '2100'").count() == 0
