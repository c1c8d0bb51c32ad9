"""Model versions in a store: commits, roll-back, another session, sequence model first."""

from __future__ import annotations

import json
import random
from datetime import timedelta
from pathlib import Path

import pytest
from conftest import T0
from pyspark.sql import functions as F

from stratusqc.constants import VARIABLES
from stratusqc.operators import model_store as MS
from stratusqc.operators.features import series_features
from stratusqc.operators.forest import fit_forest, score_forest
from stratusqc.operators.qc import merged_verdicts
from stratusqc.operators.reconstruction import fit_reconstruction
from stratusqc.operators.reshape import wide_to_long
from stratusqc.operators.spatial import knn_stations
from stratusqc.session import scratch_dir, write_and_reread


@pytest.fixture(scope="module")
def long(spark):
    rng = random.Random(2)
    rows = [(s * 1000 + k, s, T0 + timedelta(hours=k), v, 20 + 5 * rng.gauss(0, 1)) for s in (1, 2) for k in range(60) for v in ("temperature", "humidity")]
    return write_and_reread(spark.createDataFrame(rows, "reading_id long, station_id long, ts timestamp, variable string, value double"), "long")


@pytest.fixture(scope="module")
def features(long):
    return write_and_reread(series_features(long), "features")


@pytest.fixture(scope="module")
def forests(features):
    return [fit_forest(features, trees=5, seed=s) for s in (1, 2)]


def decisions(scored):
    return {(r["reading_id"], r["variable"]): r["decision"] for r in scored.collect()}


def test_roll_back_scores_with_the_older_trees(spark, features, forests):
    path = scratch_dir(spark, "models")
    assert MS.ModelStore(spark, path).save_forest(forests[0]) == {"temperature": "v1.1.0", "humidity": "v1.1.0"}
    assert MS.ModelStore(spark, path).save_forest(forests[1]) == {"temperature": "v1.2.0", "humidity": "v1.2.0"}
    first, second = (decisions(score_forest(features, f)) for f in forests)
    assert first != second
    other = MS.ModelStore(spark.newSession(), path)  # nothing but the folder is shared
    here = spark.newSession().read.parquet(*features.inputFiles())
    assert decisions(MS.score_stored(here, other.load_forest())) == second
    other.activate(MS.FOREST, {"humidity": "v1.1.0"})
    scored = MS.score_stored(here, other.load_forest())
    assert decisions(scored) == {k: (first if k[1] == "humidity" else second)[k] for k in first}
    assert {(r["variable"], r["ml_model_version"]) for r in scored.collect()} == {("humidity", "v1.1.0"), ("temperature", "v1.2.0")}
    rows = other.versions().collect()
    assert len(rows) == 4 and {v: sum(r["is_active"] for r in rows if r["variable"] == v) for v in ("humidity", "temperature")} == {"humidity": 1, "temperature": 1}
    other.activate(MS.FOREST, {"humidity": "v1.2.0"})
    assert decisions(MS.score_stored(here, other.load_forest())) == second


def test_only_active_trainings_are_read(spark, forests):
    store = MS.ModelStore(spark, scratch_dir(spark, "models"))
    store.save_forest(forests[0])
    old = set(store.load_forest().nodes.inputFiles())
    store.save_forest(forests[1])
    assert "artefact" in store.load_forest().nodes._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    store.activate(MS.FOREST, {"humidity": "v1.1.0", "temperature": "v1.1.0"})
    artefacts = {r["artefact"] for r in store.active(MS.FOREST).collect()}
    assert len(artefacts) == 1 and all(f"artefact={a}" in f for a in artefacts for f in old)


def test_two_writers_get_two_numbers(spark):
    """The second one finds the number taken, looks again and counts on from the first one's versions."""
    path = scratch_dir(spark, "models")
    table = spark.createDataFrame([("humidity", 1.0)], "variable string, x double")
    a, b = MS.ModelStore(spark, path), MS.ModelStore(spark, path)
    move, calls = a._move_into_place, []

    def late(number, text):
        if not calls:
            calls.append(b.save("m", {"t": table}))
        return move(number, text)

    a._move_into_place = late
    assert a.save("m", {"t": table}) == {"humidity": "v1.2.0"}
    assert calls == [{"humidity": "v1.1.0"}]
    assert [(r["version"], r["is_active"]) for r in a.versions().orderBy("version").collect()] == [("v1.1.0", False), ("v1.2.0", True)]
    assert a.last_commit() == 2


def test_unfinished_work_is_not_seen(spark):
    path = scratch_dir(spark, "models")
    store = MS.ModelStore(spark, path)
    assert store.versions().count() == 0 and store.last_commit() == 0
    with pytest.raises(LookupError):
        store.load_forest()
    table = spark.createDataFrame([("humidity", 1.0)], "variable string, x double")
    store.save("m", {"t": table})
    table.write.parquet(f"{path}/tables/t/artefact=never")  # a training that stopped before its commit
    Path(path, "commits", ".aside").write_text(json.dumps({"commit": 9, "action": "activate"}))
    assert store.last_commit() == 1
    assert store.load("m", ["t"])["t"].count() == 1
    with pytest.raises(ValueError):
        store.activate("m", {"humidity": "v9.9.0"})
    assert store.last_commit() == 1


def test_sequence_model_first_then_forest_then_neutral(spark, long, forests, make_readings, make_stations):
    rng = random.Random(3)
    series = {v: [20 + rng.gauss(0, 3) for _ in range(40)] for v in ("temperature", "humidity", "pressure")}
    readings = make_readings({1: series, 2: {v: x[::-1] for v, x in series.items()}}).select("reading_id", "station_id", "ts", *VARIABLES)
    stations = make_stations((1, 28.5, 77.2), (2, 28.6, 77.2))
    store = MS.ModelStore(spark, scratch_dir(spark, "models"))
    store.save_forest(forests[0])
    sequence = fit_reconstruction(wide_to_long(readings).filter("variable = 'temperature'"))
    store.save_sequence(sequence)
    qc = merged_verdicts(readings, stations, knn_stations(stations), MS.active_scorer(store))
    found = {(r["variable"], r["ml_model_version"]): r["n"] for r in qc.groupBy("variable", "ml_model_version").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert found == {("temperature", "v1.1.0"): 80, ("humidity", "v1.1.0"): 80, ("pressure", None): 80}
    by = {(r["variable"], r["ml_flag"]) for r in qc.select("variable", "ml_flag").distinct().collect()}
    assert ("pressure", True) not in by
    scores = qc.groupBy("variable").agg(F.max("ml_score").alias("m"), F.min("ml_score").alias("l")).collect()
    assert {r["variable"]: r["m"] > 0 for r in scores} == {"temperature": True, "humidity": True, "pressure": False}
