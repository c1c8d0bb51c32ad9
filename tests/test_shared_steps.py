"""Steps that several passes need are taken once, and small tables of much work are dealt over all cores."""

from __future__ import annotations

from datetime import timedelta
from pathlib import Path

import pytest
from conftest import T0

from stratusqc.operators import feedback as FB
from stratusqc.operators import reconstruction as RE
from stratusqc.operators import recurrent as RC
from stratusqc.streaming import jobs as J


@pytest.fixture(scope="module")
def long(spark):
    rows = [(s * 100 + k, s, T0 + timedelta(hours=k), "temperature", float((k * 7 + s) % 11)) for s in range(4) for k in range(40)]
    return spark.createDataFrame(rows, "reading_id long, station_id long, ts timestamp, variable string, value double")


def test_features_of_the_baseline_are_gathered_once(long, monkeypatch):
    features = FB.baseline_features(long)
    assert "Window" not in features._jdf.queryExecution().optimizedPlan().toString()
    fitted = []
    monkeypatch.setattr(FB, "fit_forest", lambda rows, **_: fitted.append(rows))
    monkeypatch.setattr(FB, "series_features", None)
    FB.baseline_forest(long, features=features)
    assert fitted == [features]


def test_all_cores_work_on_a_slice(long, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(RC, "scratch_dir", lambda _, label: f"{tmp_path}/{label}")
    model = RC.fit_recurrent(long, hidden=2, epochs=1, slices=2)
    assert model.fitted.first()["n_windows"] == 4 * 29
    for k in range(2):
        assert len(list(Path(tmp_path, "windows", f"slice={k}").glob("*.parquet"))) >= spark.sparkContext.defaultParallelism


def test_windows_are_gathered_once(long, monkeypatch):
    written, write = [], RE.write_and_reread
    monkeypatch.setattr(RE, "write_and_reread", lambda df, label: written.append(label) or write(df, label))
    assert RE.fit_reconstruction(long).fitted.count() == 1
    assert written.count("seq-windows") == 1


def test_state_stores_do_not_count_rows(spark, tmp_path):
    events = spark.createDataFrame([(1, T0, "view", 2.0)], "station_id long, ts timestamp, variable string, value double")
    events.write.parquet(f"{tmp_path}/in")
    stream, drain = J.with_drain(J.file_stream(spark, f"{tmp_path}/in", events.schema, "*.parquet"), "ts", "few")
    assert J.run_to_table(J.stream_window_stats(stream), "few", drain=drain).count() == 10
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows") == "false"
