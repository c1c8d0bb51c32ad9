"""Results kept up to date by key."""

from __future__ import annotations

import json
from datetime import timedelta

from conftest import T0
from pyspark.sql import functions as F

from stratusqc.session import scratch_dir
from stratusqc.sources.sinks import upsert_results

SCHEMA = "qc_id long, verdict string, created_at timestamp, details struct<rule:struct<reason:string,value:double>>"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, T0 + timedelta(hours=h), ((r, x),)) for i, v, h, r, x in rows], SCHEMA)


def stored(spark, path):
    return {r["qc_id"]: (r["verdict"], json.loads(r["details"])) for r in spark.read.parquet(path).collect()}


def test_a_repeated_run_changes_nothing(spark):
    path = scratch_dir(spark, "results")
    rows = frame(spark, [(1, "valid", 1, "A", 1.5), (2, "suspect", 30, "B", None), (3, "valid", 60, "C", 2.0)])
    upsert_results(rows, path)
    first = stored(spark, path)
    assert first == {1: ("valid", {"rule": {"reason": "A", "value": 1.5}}), 2: ("suspect", {"rule": {"reason": "B"}}), 3: ("valid", {"rule": {"reason": "C", "value": 2.0}})}
    upsert_results(rows, path)
    assert stored(spark, path) == first and spark.read.parquet(path).count() == 3


def test_new_rows_replace_their_key_only(spark):
    path = scratch_dir(spark, "results")
    upsert_results(frame(spark, [(k, "valid", k, "A", float(k)) for k in range(48)]), path)
    untouched = {f for f in spark.read.parquet(path).inputFiles() if "day=2024-06-02" in f}
    upsert_results(frame(spark, [(5, "anomalous", 5, "B", 9.0), (100, "suspect", 6, "C", 1.0), (100, "anomalous", 7, "D", 2.0)]), path)
    got = stored(spark, path)
    assert len(got) == 49 == spark.read.parquet(path).count()
    assert got[5][0] == "anomalous" and got[100] == ("anomalous", {"rule": {"reason": "D", "value": 2.0}}) and got[4][0] == "valid"
    assert untouched and untouched <= set(spark.read.parquet(path).inputFiles())


def test_empty_writes_and_other_keys(spark):
    path = scratch_dir(spark, "results")
    rows = frame(spark, [(1, "valid", 1, "A", 1.0), (1, "valid", 2, "A", 1.0)])
    upsert_results(rows, path, keys=("qc_id", "created_at"))
    upsert_results(rows.filter(F.lit(False)), path, keys=("qc_id", "created_at"))
    assert spark.read.parquet(path).count() == 2
