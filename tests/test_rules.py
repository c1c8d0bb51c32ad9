from __future__ import annotations

from datetime import timedelta

import pytest
from conftest import T0
from pyspark.sql import functions as F

from stratusqc.functions.rules import range_violation, step_fails
from stratusqc.operators.qc import rule_verdicts
from stratusqc.plans import checks

HERE = (1, 28.58, 77.20)


def verdicts(df, variable="temperature"):
    rows = df.filter(F.col("variable") == variable).orderBy("station_id", "ts").collect()
    return [r["reason_code"] for r in rows]


@pytest.mark.parametrize(
    "value,expected",
    [(None, None), (-10.0, None), (55.0, None), (-10.01, "below_min"), (55.01, "above_max"),
     (float("nan"), "non_finite_number"), (float("inf"), "non_finite_number"), (float("-inf"), "non_finite_number")],
)
def test_range_is_inclusive_and_refuses_non_finite(spark, value, expected):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(range_violation(F.col("v"), F.lit(-10.0), F.lit(55.0))).first()[0] == expected


@pytest.mark.parametrize(
    "cur,prev,limit,circular,fails",
    [(30.0, 22.0, 8.0, False, False), (30.1, 22.0, 8.0, False, True), (None, 1.0, 1.0, False, False),
     (5.0, None, 1.0, False, False), (float("nan"), 1.0, 1.0, False, False), (5.0, 355.0, 20.0, True, False),
     (90.0, 300.0, 140.0, True, True), (float("inf"), 10.0, 20.0, True, False), (float("inf"), 10.0, 20.0, False, True)],
)
def test_step(spark, cur, prev, limit, circular, fails):
    df = spark.createDataFrame([(cur, prev)], "c double, p double")
    assert df.select(step_fails(F.col("c"), F.col("p"), F.lit(limit), F.lit(circular))).first()[0] is fails


def test_flatline_needs_full_window_and_exempts_dry_and_dark(make_readings, make_stations):
    readings = make_readings(
        {1: {"temperature": [20, 25, 25, 25, 25, 25, 25], "rainfall": [0.0] * 7, "solar_radiation": [0.0] * 7,
             "humidity": [50.0] * 5 + [None, 50.0], "pressure": [1000.0] * 7}}
    )
    out = rule_verdicts(readings, make_stations(HERE))
    assert verdicts(out) == ["VALID_READING"] * 6 + ["RULE_PERSISTENCE_FAIL"]
    for exempt in ("rainfall", "solar_radiation", "humidity"):
        assert set(verdicts(out, exempt)) == {"VALID_READING"}
    assert verdicts(out, "pressure") == ["VALID_READING"] * 5 + ["RULE_PERSISTENCE_FAIL"] * 2


def test_nonzero_rain_can_freeze(make_readings, make_stations):
    out = rule_verdicts(make_readings({1: {"rainfall": [4.0] * 6}}), make_stations(HERE))
    assert verdicts(out, "rainfall")[-1] == "RULE_PERSISTENCE_FAIL"


def test_station_record_replaces_default_as_a_whole(make_readings, make_stations):
    own = {"temperature": (None, 38.0, None, 4, None)}
    stations = make_stations((1, 28.0, 77.0, own), (2, 28.1, 77.1))
    readings = make_readings({1: {"temperature": [42, -500, 30, 30, 30, 30]}, 2: {"temperature": [42, -500, 30, 30, 30, 30]}})
    out = rule_verdicts(readings, stations).filter("variable = 'temperature'")
    first = verdicts(out.filter("station_id = 1"))
    second = verdicts(out.filter("station_id = 2"))
    # Own record: 42 breaks its maximum, minimum and step are open, four equal values freeze.
    assert first == ["RULE_RANGE_FAIL", "VALID_READING", "VALID_READING", "VALID_READING", "VALID_READING", "RULE_PERSISTENCE_FAIL"]
    # Default record: 42 is fine, -500 is not, and the jump back to 30 is too large.
    assert second == ["VALID_READING", "RULE_RANGE_FAIL", "RULE_STEP_FAIL", "VALID_READING", "VALID_READING", "VALID_READING"]


def test_persistence_beyond_history_never_fires(make_readings, make_stations):
    stations = make_stations((1, 28.0, 77.0, {"temperature": (0.0, 50.0, 10.0, 22, None)}))
    out = rule_verdicts(make_readings({1: {"temperature": [20.0] * 30}}), stations)
    assert set(verdicts(out)) == {"VALID_READING"}
    stations = make_stations((1, 28.0, 77.0, {"temperature": (0.0, 50.0, 10.0, 21, None)}))
    out = rule_verdicts(make_readings({1: {"temperature": [20.0] * 30}}), stations)
    assert verdicts(out).count("RULE_PERSISTENCE_FAIL") == 10


def test_persistence_of_one_flags_every_value(make_readings, make_stations):
    stations = make_stations((1, 28.0, 77.0, {"temperature": (0.0, 50.0, 10.0, 1, None)}))
    out = rule_verdicts(make_readings({1: {"temperature": [20.0, None, 21.0]}}), stations)
    assert verdicts(out) == ["RULE_PERSISTENCE_FAIL", "VALID_READING", "RULE_PERSISTENCE_FAIL"]


def test_spans_do_not_change_verdicts(make_readings, make_stations):
    series = [20 + (i % 3) * 5 if i % 9 < 5 else 30 for i in range(60)]
    readings = make_readings({1: {"temperature": series}, 2: {"temperature": series[::-1]}}, minutes=50)
    stations = make_stations(HERE, (2, 28.7, 77.2))
    whole = rule_verdicts(readings, stations)
    for seconds in (3600, 20000, 86400):
        cut = rule_verdicts(readings, stations, span_seconds=seconds)
        assert verdicts(cut) == verdicts(whole)


@pytest.mark.parametrize("name", ["check_step", "check_persistence"])
def test_history_is_gathered_on_wide_readings(spark, tmp_path, name):
    """Long rows are seven times as many; none of them may be sorted for a window."""
    rows = [(k, T0 + timedelta(hours=k), k % 3, ("view", "click")[k % 2], float(k)) for k in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    df = getattr(checks, name)(spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    windows = [line.split("windowspecdefinition(")[1] for line in plan.splitlines() if "windowspecdefinition(" in line]
    assert windows and not any("variable" in w for w in windows)
