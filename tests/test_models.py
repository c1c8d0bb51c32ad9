from __future__ import annotations

import math
import random
from datetime import timedelta

import numpy as np
import pytest
from conftest import T0
from pyspark.sql import functions as F

from stratusqc.operators import evaluate as EV
from stratusqc.operators import faults as FA
from stratusqc.operators import feedback as FB
from stratusqc.operators import features as FE
from stratusqc.operators import forest as FO
from stratusqc.operators import models as MO
from stratusqc.operators import reconstruction as RE
from stratusqc.operators.quantiles import exact_quantile
from stratusqc.operators.reshape import wide_to_long


def diurnal(n, seed=0, amplitude=6):
    rng = random.Random(seed)
    return [30 + amplitude * math.sin(2 * math.pi * (i - 9) / 24) + rng.gauss(0, 0.3) for i in range(n)]


def long_of(readings, variable="temperature"):
    return wide_to_long(readings).filter(F.col("variable") == variable)


def test_series_features(make_readings):
    values = [20.0, 22.0, 25.0, 24.0, 26.0, 28.0]
    rows = FE.series_features(long_of(make_readings({1: {"temperature": values}})), window=3).orderBy("ts").collect()
    assert [r["delta_1"] for r in rows] == [0, 2, 3, -1, 2, 2]
    assert rows[2]["rolling_mean_diff"] == pytest.approx(25 - 67 / 3)
    assert rows[2]["rolling_std"] == pytest.approx(np.std([20, 22, 25], ddof=1)) and rows[0]["rolling_std"] == 0
    assert rows[3]["hour_sin"] == pytest.approx(math.sin(2 * math.pi * 3 / 24))


def test_twenty_values_make_nine_windows(make_readings):
    long = long_of(make_readings({1: {"temperature": [float(i) for i in range(20)]}}))
    assert FE.sequence_windows(long, 12).count() == 9
    padded = FE.sequence_windows(long, 12, padded=True).orderBy("ts").first()["window"]
    assert padded == [0.0] * 12


@pytest.mark.parametrize("q", [0.0, 0.03, 0.25, 0.5, 0.98, 1.0])
def test_quantiles_are_exact(spark, q):
    rng = random.Random(1)
    # A third of all values are equal, some are missing.
    values = {"a": [rng.choice([5.0, rng.random() * 100, 5.0 if rng.random() < 0.5 else rng.gauss(0, 1)]) for _ in range(1500)], "b": [1.0, 2.0], "c": [7.0]}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("a", float("nan"))]
    got = {r["g"]: r for r in exact_quantile(spark.createDataFrame(rows, "g string, v double"), "g", "v", q, 100).collect()}
    for g, vs in values.items():
        assert got[g]["quantile"] == pytest.approx(float(np.quantile(vs, q)), abs=1e-12)
        assert got[g]["lower"] == sorted(vs)[math.floor((len(vs) - 1) * q)]


@pytest.fixture(scope="module")
def trained(make_readings):
    readings = make_readings({s: {"temperature": diurnal(168, s)} for s in (1, 2)})
    return FO.fit_forest(FE.series_features(long_of(readings)), trees=60)


def scored(model, readings):
    seen = FE.value_series(long_of(readings), 20)
    return FO.score_forest(FE.add_features(seen, ddof=0), model)


def test_forest_flags_a_spike(make_readings, trained):
    clean = diurnal(48, 5)
    spiked = clean[:40] + [clean[40] + 18] + clean[41:]
    rows = {r["reading_id"]: r for r in scored(trained, make_readings({9: {"temperature": spiked}})).collect()}
    spike = rows[9040]
    assert spike["ml_flag"] and spike["ml_score"] > 0.5
    assert all(0 <= r["ml_score"] <= 1 and 0.5 <= r["ml_confidence"] <= 0.99 for r in rows.values())
    assert spike["ml_score"] == max(r["ml_score"] for r in rows.values())


def test_forest_is_reproducible(make_readings, trained):
    readings = make_readings({s: {"temperature": diurnal(168, s)} for s in (1, 2)})
    again = FO.fit_forest(FE.series_features(long_of(readings)).repartition(7), trees=60)
    order = ["tree", "node"]
    assert [tuple(r) for r in trained.nodes.orderBy(*order).collect()] == [tuple(r) for r in again.nodes.orderBy(*order).collect()]


def test_forest_marks_its_contamination_share(make_readings, trained):
    readings = make_readings({s: {"temperature": diurnal(168, s)} for s in (1, 2)})
    flagged = FO.score_forest(FE.series_features(long_of(readings)), trained).filter("ml_flag").count()
    assert 8 <= flagged <= 11  # three percent of 336


def test_too_few_rows_get_no_forest(make_readings):
    model = FO.fit_forest(FE.series_features(long_of(make_readings({1: {"temperature": diurnal(11)}}))), trees=5)
    assert model.nodes.count() == 0


def test_reconstruction_flags_deformed_windows(make_readings):
    train = long_of(make_readings({s: {"temperature": diurnal(200, s)} for s in (1, 2, 3)}))
    model = RE.fit_reconstruction(train, k=3)
    fitted = model.fitted.first()
    assert fitted["threshold"] > fitted["error_mean"]
    clean = diurnal(60, 9)
    jagged = clean[:40] + [v + (6 if i % 2 else -6) for i, v in enumerate(clean[40:])]
    windows = FE.sequence_windows(long_of(make_readings({9: {"temperature": jagged}})), 12, padded=True)
    rows = {r["reading_id"]: r for r in RE.score_reconstruction(windows, model).collect()}
    assert rows[9055]["ml_flag"] and rows[9055]["ml_score"] > 0.9
    assert sum(rows[9000 + i]["ml_flag"] for i in range(12, 40)) <= 3


def test_model_choice(spark):
    rows = spark.createDataFrame([(1, "t"), (2, "t"), (3, "t")], "reading_id long, variable string")

    def part(ids, score, model):
        return spark.createDataFrame(
            [(i, "t", True, score, 0.9, model, "v") for i in ids],
            "reading_id long, variable string, ml_flag boolean, ml_score double, ml_confidence double, ml_model string, ml_model_version string",
        )

    got = {r["reading_id"]: (r["ml_model"], r["ml_score"]) for r in MO.model_select(rows, part([1], 0.8, "s"), part([1, 2], 0.6, "f")).collect()}
    assert got == {1: ("s", 0.8), 2: ("f", 0.6), 3: (None, 0.0)}


def test_one_active_version(spark):
    schema = "model_id long, variable string, version string, trained_at timestamp, activated_at timestamp"
    reg = spark.createDataFrame([(1, "t", "v1.1.0", T0, T0), (2, "t", "v1.2.0", T0, T0 + timedelta(days=1)), (3, "h", "v1.1.0", T0, None)], schema)
    active = lambda df: {r["model_id"] for r in MO.with_active_flag(df).filter("is_active").collect()}
    assert active(reg) == {2}
    assert active(MO.activate(reg, 1, "2025-01-01 00:00:00")) == {1}
    assert {r["variable"]: r["next_version"] for r in MO.next_version(reg).collect()} == {"t": "v1.3.0", "h": "v1.2.0"}


# Faults and evaluation


def test_injectors(make_readings):
    readings = make_readings({1: {"temperature": diurnal(30)}, 2: {"temperature": diurnal(5)}})
    values = lambda df: [r["temperature"] for r in df.filter("station_id = 1").orderBy("ts").collect()]
    clean = values(readings)
    flat = FA.inject_flatline(readings)
    assert values(flat)[12:20] == [clean[12]] * 8 and flat.filter("is_anomalous").count() == 8
    spike = values(FA.inject_spike(readings, magnitude=-16.0))
    assert [i for i in range(30) if spike[i] != clean[i]] == [15] and spike[15] == pytest.approx(clean[15] - 16)
    drift = values(FA.inject_drift(readings))
    offsets = [d - c for d, c in zip(drift, clean)][10:]
    assert offsets == pytest.approx(list(np.linspace(0, 9, 20)))
    assert FA.inject_dropout(readings, 1).count() == 29
    nulls = values(FA.inject_dropout(readings, 1, remove_rows=False))
    assert [i for i in range(30) if nulls[i] is None] == list(range(14, 20))
    spatial = FA.inject_spatial_inconsistency(readings, 1)
    assert spatial.filter("is_anomalous").select("station_id").distinct().count() == 1
    event = FA.inject_regional_event(readings)
    assert event.filter("fault_type = 'plausible_extreme'").count() == 6 and event.filter("is_anomalous").count() == 0


def test_benchmark_has_one_fault_per_station(make_readings):
    readings = make_readings({s: {"temperature": diurnal(48, s), "humidity": [60.0] * 48} for s in range(1, 7)})
    bench = FA.labelled_benchmark(readings)
    counts = {(r["station_id"], r["fault_type"], r["fault_variable"]): r["count"] for r in bench.filter("is_anomalous").groupBy("station_id", "fault_type", "fault_variable").count().collect()}
    assert counts == {(1, "flatline", "temperature"): 8, (2, "spike", "temperature"): 1, (3, "spike", "humidity"): 1,
                      (4, "drift", "temperature"): 24, (5, "dropout", "temperature"): 6}


def test_metrics_when_undefined(spark):
    df = spark.createDataFrame([(False, False, "valid")], "is_anomalous boolean, predicted boolean, fault_type string")
    row = EV.confusion(df).first()
    assert (row["precision"], row["recall"], row["f1"], row["tn"]) == (0.0, 0.0, 0.0, 1)
    assert EV.model_comparison(df.withColumn("b", F.col("predicted")), "predicted", "b").first()["recall_a"] == 1.0


def test_merged_quality_floors(make_readings, make_stations):
    """Five neighbouring stations, 48 hours, one fault each, no model tier.

    What can be found follows from the thresholds: drift once it has passed 3.5 (noise aside), a frozen
    sensor once six values agree or its neighbours have moved away, and every spike.
    """
    base = diurnal(48, 3, 8)
    rng = random.Random(3)
    data = {s: {"temperature": [v + rng.gauss(0, 0.2) for v in base], "humidity": [60 + rng.gauss(0, 1) for _ in base]} for s in range(1, 6)}
    stations = make_stations(*[(s, 28.5 + 0.05 * s, 77.2 + 0.05 * s) for s in range(1, 6)])
    judged = EV.merged_predictions(FA.labelled_benchmark(make_readings(data)), stations)
    m = EV.confusion(judged).first()
    assert m["tp"] + m["fp"] + m["fn"] + m["tn"] == 240 - 6 - 1
    assert m["precision"] >= 0.90 and m["recall"] >= 0.60 and m["f1"] >= 0.75
    drift = judged.filter("fault_type = 'drift'").withColumn("offset", (F.col("reading_id") - 4012) * 10 / 23)
    assert drift.filter("offset >= 4.2 and not predicted").count() == 0
    assert drift.filter("offset <= 2.8 and predicted").count() == 0
    assert judged.filter("reading_id between 1015 and 1017 and predicted").count() == 3
    recall = {r["fault_type"]: r["recall"] for r in EV.per_fault_recall(judged).collect()}
    assert recall["spike"] == 1.0 and recall["flatline"] > 0


# Feedback


@pytest.mark.parametrize(
    "fa,cf,target,expected",
    [([], [-0.2], 1.0, 0.0), ([-0.1, 0.05], [], 1.0, -0.102), ([0.1, 0.2], [-0.2, 0.0], 1.0, 0.05),
     ([-0.3, -0.1, 0.1, 0.2, 0.4], [-0.2], 1.0, -0.301), ([-0.3, -0.1, 0.1, 0.2, 0.4], [-0.2], 0.5, 0.099)],
)
def test_calibration(spark, fa, cf, target, expected):
    rows = [("t", "false_alarm", d) for d in fa] + [("t", "confirmed_fault", d) for d in cf]
    df = spark.createDataFrame(rows, "variable string, label string, decision double")
    assert FB.calibrate_threshold(df, target).first()["threshold"] == pytest.approx(expected)


def test_retraining_clears_a_false_alarm(spark, make_readings):
    readings = make_readings({1: {"temperature": diurnal(168, 1)}, 2: {"temperature": diurnal(60, 2)[:50] + [40.0] + diurnal(60, 2)[51:]}})
    qc = spark.createDataFrame([(7, 2050, "temperature")], "qc_id long, reading_id long, variable string")
    feedback = spark.createDataFrame([(1, 7, "false_alarm")], "feedback_id long, qc_result_id long, label string")
    samples = FB.feedback_samples(feedback, qc, readings, ["temperature"])
    assert samples.first()["value"] == 40.0
    model, outcome = FB.retrain(long_of(readings.filter("station_id = 1")), samples, trees=40)
    row = outcome.first()
    assert (row["prior_flagged"], row["new_flagged"], row["reduction_pct"]) == (1, 0, 100.0)
    assert not FO.score_forest(samples, model).first()["ml_flag"]


def test_retraining_covers_all_variables_and_registers(spark, make_readings):
    """A value the model before never flagged is no removed alarm; variables without feedback are trained and registered too."""
    readings = make_readings({1: {"temperature": diurnal(168, 1), "rainfall": diurnal(168, 3)}, 2: {"temperature": diurnal(60, 2)}})
    qc = spark.createDataFrame([(7, 2030, "temperature")], "qc_id long, reading_id long, variable string")
    feedback = spark.createDataFrame([(1, 7, "false_alarm")], "feedback_id long, qc_result_id long, label string")
    samples = FB.feedback_samples(feedback, qc, readings, ["temperature"])
    long = wide_to_long(readings.filter("station_id = 1"))
    previous = FB.baseline_forest(long, trees=20)
    flagged = FO.score_forest(samples, previous).first()["ml_flag"]
    model, outcome = FB.retrain(long, samples, previous, trees=20)
    rows = {r["variable"]: r for r in outcome.collect()}
    assert {"temperature", "rainfall"} <= set(rows)
    assert rows["temperature"]["prior_flagged"] == int(flagged) and rows["rainfall"]["prior_flagged"] == 0
    assert {r["variable"] for r in model.cutoffs.collect()} == set(rows)
    registry = spark.createDataFrame(
        [(1, "isolation_forest", "temperature", "v1.1.0", T0, T0 + timedelta(hours=5)), (2, "isolation_forest", "temperature", "v1.2.0", T0, None)],
        "model_id long, model_type string, variable string, version string, trained_at timestamp, activated_at timestamp",
    )
    after = FB.register_trained(registry, model)
    assert after.count() == 2 + len(rows)
    active = {r["variable"]: r["version"] for r in MO.active_models(after).collect()}
    assert active["temperature"] == "v1.3.0" and active["rainfall"] == "v1.1.0"
    first = FB.register_trained(registry.filter("model_id < 0"), model).collect()
    assert sorted(r["model_id"] for r in first) == list(range(1, len(rows) + 1))
    assert all(r["version"] == "v1.1.0" and r["activated_at"] is not None for r in first)


def test_every_row_can_be_drawn_for_every_tree(spark):
    """Samples are thresholds on hashes over all rows; nothing is ranked over a whole variable."""
    n, trees, sample = 40_000, 20, 64
    rows = spark.range(n).select(
        F.lit("temperature").alias("variable"),
        (F.col("id") % 7).alias("station_id"),
        F.timestamp_seconds("id").alias("ts"),
        *[F.rand(1).alias(z) for z in FO.Z],
    )
    drawn = FO._tree_samples(rows, trees, sample, 42)
    sizes = {r["tree"]: r["count"] for r in drawn.groupBy("tree").count().collect()}
    assert sizes == dict.fromkeys(range(trees), sample)
    # Early and late rows alike, and not the same rows in every tree.
    late = drawn.filter(F.unix_timestamp("ts") >= n // 2).count()
    assert 0.4 < late / (trees * sample) < 0.6
    assert drawn.select("ts").distinct().count() > 0.6 * trees * sample


def test_ranks_are_cut_before_the_shuffle(make_readings):
    readings = make_readings({1: {"temperature": list(range(50))}, 2: {"temperature": [1.0]}})
    plan = FA.row_position(readings, 11)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert FA.row_position(readings, 11).count() == 13 and FA.row_position(readings).count() == 51
