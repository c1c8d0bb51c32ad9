from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stratusqc.functions.merge import imputed, merged_verdict
from stratusqc.operators.qc import merged_verdicts, reading_rollup, verdict_details
from stratusqc.operators.spatial import knn_stations

OK = "VALID_READING"
SAME, APART, NONE = "SPATIAL_CONSISTENT", "SPATIAL_MISMATCH", "SPATIAL_INSUFFICIENT_DATA"


@pytest.mark.parametrize(
    "rule,flag,score,conf,model,delta,spatial,expected",
    [
        ("RULE_RANGE_FAIL", False, 0.2, 0.5, None, 0.0, SAME, ("anomalous", "spike", "RULE_RANGE", 0.99)),
        ("RULE_PERSISTENCE_FAIL", False, 0.2, 0.5, None, 0.0, SAME, ("anomalous", "flatline", "RULE_FLATLINE", 0.98)),
        ("RULE_STEP_FAIL", False, 0.2, 0.5, None, 0.0, APART, ("anomalous", "spike", "RULE_STEP", 0.95)),
        ("RULE_STEP_FAIL", False, 0.2, 0.5, None, 0.0, NONE, ("anomalous", "spike", "RULE_STEP", 0.95)),
        ("RULE_STEP_FAIL", False, 0.2, 0.5, None, 0.0, SAME, ("valid", "plausible_extreme", "SPATIAL_OVERRIDE_EXTREME", 0.88)),
        (OK, True, 0.85, 0.5, None, None, APART, ("anomalous", "drift", "ML_AND_SPATIAL_CONFIRMED", 0.88)),
        (OK, True, 0.85, 0.99, None, -4.5, APART, ("anomalous", "spike", "ML_AND_SPATIAL_CONFIRMED", 0.98)),
        (OK, True, 0.85, 0.5, None, 0.0, SAME, ("valid", "plausible_extreme", "SPATIAL_VALIDATED_EXTREME", 0.92)),
        (OK, True, 0.75, 0.7, "isolation_forest", 0.0, NONE, ("anomalous", "drift", "ML_ISOFOREST", 0.7)),
        (OK, True, 0.80, 0.9, "reconstruction", 0.0, NONE, ("anomalous", "drift", "ML_LSTM_AE", 0.9)),
        (OK, True, 0.74, 0.7, "isolation_forest", 0.0, NONE, ("suspect", "drift", "ML_BORDERLINE", 0.65)),
        (OK, False, 0.9, 0.5, None, 0.0, APART, ("anomalous", "spatial_inconsistency", "SPATIAL_MISMATCH", 0.92)),
        (OK, False, 0.55, 0.5, None, 0.0, SAME, ("valid", None, OK, 0.95)),
        (OK, False, 0.55, 0.5, None, 0.0, NONE, ("suspect", None, "ML_SUSPECT", 0.60)),
        (OK, False, 0.2, 0.5, None, 0.0, SAME, ("valid", None, OK, 1.0)),
    ],
)
def test_decision_table(spark, rule, flag, score, conf, model, delta, spatial, expected):
    df = spark.createDataFrame(
        [(rule, flag, score, conf, model, delta, spatial)],
        "rule string, flag boolean, score double, conf double, model string, delta double, spatial string",
    )
    assert tuple(df.select(merged_verdict(*[F.col(c) for c in df.columns]).alias("m")).first()["m"]) == expected


@pytest.mark.parametrize(
    "value,n,mean,diff,expected",
    [(40.0, 2, 31.456, None, (31.46, "spatial_kdtree_neighbors", 0.94)), (40.0, 1, 31.0, 2.5, (37.5, "temporal_rolling_baseline", 0.82)),
     (40.0, None, None, None, (None, None, None))],
)
def test_imputation(spark, value, n, mean, diff, expected):
    df = spark.createDataFrame([(value, n, mean, diff)], "v double, n long, m double, d double")
    assert tuple(df.select(imputed(*[F.col(c) for c in df.columns]).alias("i")).first()["i"]) == expected


def network(make_readings, make_stations, bump):
    """Five close stations over 24 hours; ``bump[station]`` is added from hour 12 on."""
    base = [20 + 5 * ((i % 12) / 12) for i in range(24)]
    data = {s: {"temperature": [v + s * 0.1 + (bump.get(s, 0) if i >= 12 else 0) for i, v in enumerate(base)]} for s in range(1, 6)}
    stations = make_stations(*[(s, 28.5 + 0.05 * s, 77.2 + 0.05 * s) for s in range(1, 6)])
    return make_readings(data), stations, knn_stations(stations)


def test_regional_event_is_weather(make_readings, make_stations):
    qc = merged_verdicts(*network(make_readings, make_stations, {s: 14 for s in range(1, 6)}))
    assert qc.filter("verdict = 'anomalous'").count() == 0
    assert qc.filter("reason_code = 'SPATIAL_OVERRIDE_EXTREME'").count() == 5


def test_single_departure_is_a_fault(make_readings, make_stations):
    qc = merged_verdicts(*network(make_readings, make_stations, {3: 15}))
    bad = qc.filter("verdict = 'anomalous'").collect()
    assert {r["station_id"] for r in bad} == {3}
    assert {r["reason_code"] for r in bad} == {"RULE_STEP", "SPATIAL_MISMATCH"}
    assert all(abs(r["corrected_value"] - r["neighbor_mean"]) < 0.006 for r in bad)
    worst = {r["reading_id"]: (r["verdict"], r["fault_type"]) for r in reading_rollup(qc).collect()}
    assert worst[3012] == ("anomalous", "spike") and worst[3013] == ("anomalous", "spatial_inconsistency")
    assert worst[1012] == ("valid", None)
    assert verdict_details(qc).select("details.spatial.z_score").filter("z_score > 3").count() > 0


def test_missing_values_get_no_verdict(make_readings, make_stations):
    stations = make_stations((1, 28.0, 77.0))
    readings = make_readings({1: {"temperature": [20.0, None, float("nan")]}})
    assert merged_verdicts(readings, stations, knn_stations(stations)).count() == 1


@pytest.mark.parametrize(
    "rows,expected",
    [([(1, "suspect", None, "ML_SUSPECT"), (2, "suspect", "drift", "ML_BORDERLINE")], ("suspect", "drift")),
     ([(1, "anomalous", "spike", "RULE_STEP"), (2, "anomalous", "flatline", "RULE_FLATLINE")], ("anomalous", "spike")),
     ([(1, "valid", "plausible_extreme", "X"), (2, "valid", None, "Y")], ("valid", None))],
)
def test_rollup_speaker(spark, rows, expected):
    qc = spark.createDataFrame([(9, *r) for r in rows], "reading_id long, qc_id long, verdict string, fault_type string, reason_code string")
    assert tuple(reading_rollup(qc).first())[1:] == expected
