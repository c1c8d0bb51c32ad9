from __future__ import annotations

import json
from datetime import datetime

import pytest
from conftest import T0
from pyspark.sql import functions as F

from stratusqc.functions.cleaning import clamp_percent, lenient_double, lenient_timestamp
from stratusqc.sources import ingest as I
from stratusqc.sources import readers as RD
from stratusqc.sources import sinks as SK


def test_csv_aliases_and_null_tokens(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        " Station_Code ,TIME,temp,air_temp,RH,wdir\n"
        "st1,2024-06-01T10:00:00Z,NaN,21.5,120,90\n"
        "ST2,2024-06-01 11:00,null,,-5,\n"
        "ST3,01/06/2024 12:30:00,abc,,50,370\n"
    )
    raw = RD.read_readings_csv(spark, str(tmp_path / "a.csv"))
    rows = I.clamp_humidity(RD.typed_readings(RD.harmonize_columns(raw))).orderBy("ts").collect()
    assert [r["station_code"] for r in rows] == ["st1", "ST2", "ST3"]
    assert [r["temperature"] for r in rows] == [21.5, None, None]
    assert [r["humidity"] for r in rows] == [100.0, 0.0, 50.0]
    assert [r["ts"] for r in rows] == [datetime(2024, 6, 1, 10), datetime(2024, 6, 1, 11), datetime(2024, 6, 1, 12, 30)]


def test_csv_files_are_read_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("station_code,timestamp,temperature,humidity\nST1,2024-01-01 00:00:00,20,60\n")
    (tmp_path / "b.csv").write_text("humidity,station_code,temperature,timestamp\n60,ST2,20,2024-01-01 00:00:00\n")
    (tmp_path / "c.csv").write_text("timestamp,station_code\r\n2024-01-01 00:00:00,ST3\r\n")
    rows = RD.typed_readings(RD.harmonize_columns(RD.read_readings_csv(spark, str(tmp_path)))).collect()
    got = {r["station_code"]: (r["temperature"], r["humidity"]) for r in rows}
    assert got == {"ST1": (20.0, 60.0), "ST2": (20.0, 60.0), "ST3": (None, None)}


def test_csv_without_required_columns_is_refused(spark, tmp_path):
    (tmp_path / "b.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="station_code"):
        RD.read_readings_csv(spark, str(tmp_path / "b.csv"))


@pytest.mark.parametrize("wrapped", [True, False])
def test_json_layouts(spark, tmp_path, wrapped):
    rows = [{"Station": "ST1", "datetime": "2024-06-01 10:00:00", "temp_c": 20.5}, {"Station": "ST2", "datetime": "x", "rain": "1.5"}]
    (tmp_path / "c.json").write_text(json.dumps({"readings": rows} if wrapped else rows, indent=1))
    got = RD.typed_readings(RD.harmonize_map(RD.read_readings_json(spark, str(tmp_path / "c.json")))).orderBy("station_code").collect()
    assert [(r["station_code"], r["temperature"], r["rainfall"], r["ts"]) for r in got] == [
        ("ST1", 20.5, None, datetime(2024, 6, 1, 10)), ("ST2", None, 1.5, None)]


@pytest.mark.parametrize(
    "text,expected",
    [("1.5", 1.5), (" 1e3 ", 1000.0), ("-.5", -0.5), ("1d", None), ("abc", None), ("", None), (None, None), ("inf", float("inf"))],
)
def test_lenient_numbers(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(lenient_double(F.col("t"))).first()[0] == expected


@pytest.mark.parametrize(
    "text,expected",
    [("2024-06-01T10:00:00+05:30", datetime(2024, 6, 1, 4, 30)), ("2024-06-01", datetime(2024, 6, 1)), ("2024/06/01 10:05", datetime(2024, 6, 1, 10, 5)),
     ("01-06-2024 10:00:00", datetime(2024, 6, 1, 10)), ("10:00", None), ("2024", None), ("31/02/2024 10:00:00", None)],
)
def test_lenient_times(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(lenient_timestamp(F.col("t"))).first()[0] == expected


def test_clamp_keeps_missing(spark):
    assert spark.createDataFrame([(None,)], "h double").select(clamp_percent(F.col("h"))).first()[0] is None


def test_strict_path_counts_rejects(make_readings):
    readings = make_readings({1: {"humidity": [50, 101, -1, None], "wind_direction": [0, 10, 10, 361]}})
    ok, bad = I.validate_readings(readings)
    assert ok.count() == 1
    assert sorted(r["reason"] for r in bad.collect()) == ["humidity_out_of_bounds"] * 2 + ["wind_direction_out_of_bounds"]


def test_code_wins_over_id_and_unknown_is_rejected(spark, make_stations):
    stations = make_stations((1, 0, 0), (2, 0, 1)).withColumn(
        "station_code", F.when(F.col("station_id") == 2, "1").otherwise(F.col("station_code"))
    )
    rows = spark.createDataFrame([("1",), (" ST1 ",), ("2",), ("nope",), (None,)], "station_code string")
    known, unknown = I.resolve_station(rows, stations)
    assert {r["station_code"]: r["station_id"] for r in known.collect()} == {"1": 2, " ST1 ": 1, "2": 2}
    assert unknown.count() == 2
    filled, none_left = I.resolve_with_default(rows, stations, "st1")
    assert filled.count() == 5 and none_left.count() == 0
    assert I.resolve_with_default(rows, stations)[1].count() == 2


def test_dedup_keeps_first_and_skips_stored(make_readings):
    batch = make_readings({1: {"temperature": [1, 2, 3]}})
    repeated = batch.unionByName(batch.withColumn("reading_id", F.col("reading_id") + 500))
    stored = batch.filter("reading_id = 1000")
    got = I.dedup_readings(repeated, stored, ["reading_id"]).orderBy("reading_id").collect()
    assert [r["reading_id"] for r in got] == [1001, 1002]


def test_upsert_priority(spark):
    cols = "station_code string, name string"
    current = spark.createDataFrame([("A", "old"), ("B", "old")], cols)
    file = spark.createDataFrame([("A", "file"), ("C", "file")], cols)
    builtin = spark.createDataFrame([("C", "builtin"), ("D", "builtin")], cols)
    got = {r["station_code"]: (r["name"], r["action"]) for r in I.upsert_stations(current, file, builtin).collect()}
    assert got == {"A": ("file", "update"), "B": ("old", "keep"), "C": ("file", "insert"), "D": ("builtin", "insert")}


def test_results_are_partitioned_by_day(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, T0), (2, 5, datetime(2024, 6, 2))], "qc_id long, station_id long, created_at timestamp")
    SK.write_results(df, str(tmp_path / "out"))
    SK.write_results(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 4 and {str(r["day"]) for r in back.select("day").distinct().collect()} == {"2024-06-01", "2024-06-02"}
    assert "PartitionFilters: [isnotnull(day" in back.filter("day = date'2024-06-01'")._jdf.queryExecution().toString()


def test_series_end_is_excluded(spark):
    df = spark.createDataFrame([(1, T0, datetime(2024, 6, 1, 3), 3600, [1.005, 2.0, 3.0])], "station_id long, start timestamp, end timestamp, step int, a array<double>")
    from stratusqc.constants import VARIABLES

    rows = RD.zip_series_to_rows(df.select("station_id", "start", "end", "step", *[F.col("a").alias(v) for v in VARIABLES])).orderBy("ts").collect()
    assert [r["ts"].hour for r in rows] == [0, 1, 2] and [r["wind_direction"] for r in rows] == [1.0, 2.0, 3.0]
