"""The gate of a stream: every row once, late ones as rejects, batches that are run again."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratusqc.session import scratch_dir
from stratusqc.streaming import gate as G
from stratusqc.streaming import jobs as J

T = datetime(2024, 6, 1)
HOUR = timedelta(hours=1)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if h is None else T + h * HOUR) for i, h in rows], "id long, ts timestamp")


def outcomes(spark, path, schema):
    return {(r["id"], r["outcome"]) for r in G.gated(spark, path, schema).collect()}


def test_out_of_order_files(spark):
    """Against a plain loop over the batches."""
    rng = random.Random(1)
    arrivals, expected, newest, n = [], set(), None, 0
    for k in range(5):
        rows = [(n + j, 10 * k + rng.randint(-25, 10) if rng.random() > 0.1 else None) for j in range(30)]
        n += len(rows)
        mark = None if newest is None else newest - 12
        expected |= {(i, G.NO_TIME if h is None else G.LATE if mark is not None and h < mark else G.ACCEPTED) for i, h in rows}
        times = [h for _, h in rows if h is not None]
        newest = max([*times, *([newest] if newest is not None else [])])
        arrivals.append(rows)
    folder, path = scratch_dir(spark, "arrivals"), scratch_dir(spark, "gate")
    for rows in arrivals:
        frame(spark, rows).write.mode("append").parquet(folder)
        stream = J.file_stream(spark, folder, frame(spark, rows).schema)
        G.run_gate(stream, path, "ts", 12 * HOUR)
    assert outcomes(spark, path, frame(spark, []).schema) == expected
    assert {o for _, o in expected} == {G.ACCEPTED, G.LATE, G.NO_TIME}
    assert G.gated(spark, path, stream.schema).count() == n


def test_a_batch_run_again_counts_once(spark):
    path = scratch_dir(spark, "gate")
    first, second = frame(spark, [(1, 0), (2, 100)]), frame(spark, [(3, 10), (4, 99), (5, None)])
    G.pass_batch(first, 0, path, "ts", 24 * HOUR)
    # The second batch stops after its rows are written, before it is in the ledger.
    second.withColumn("outcome", F.lit(G.ACCEPTED)).write.partitionBy("outcome").parquet(f"{path}/rows/batch=1")
    assert outcomes(spark, path, first.schema) == {(1, G.ACCEPTED), (2, G.ACCEPTED)}
    for _ in range(2):
        G.pass_batch(second, 1, path, "ts", 24 * HOUR)
    assert outcomes(spark, path, first.schema) == {(1, G.ACCEPTED), (2, G.ACCEPTED), (3, G.LATE), (4, G.ACCEPTED), (5, G.NO_TIME)}
    assert G.gated(spark, path, first.schema).count() == 5
    # A later batch takes its watermark from the batches before it, also when the last one had late rows only.
    G.pass_batch(frame(spark, [(6, 20)]), 2, path, "ts", 24 * HOUR)
    G.pass_batch(frame(spark, [(7, 75), (8, 77)]), 3, path, "ts", 24 * HOUR)
    assert {(6, G.LATE), (7, G.LATE), (8, G.ACCEPTED)} <= outcomes(spark, path, first.schema)


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nothing_to_take_the_watermark_from(spark, rows):
    path = scratch_dir(spark, "gate")
    df = frame(spark, rows)
    assert G.gated(spark, path, df.schema).count() == 0
    G.pass_batch(df, 0, path, "ts", HOUR)
    G.pass_batch(frame(spark, [(9, -1000)]), 1, path, "ts", HOUR)
    assert outcomes(spark, path, df.schema) == {(i, G.NO_TIME) for i, _ in rows} | {(9, G.ACCEPTED)}


def test_jobs_behind_the_gate_lose_nothing(spark):
    """What comes behind the newest accepted row by less than the delay is there, and only its files are read."""
    path = scratch_dir(spark, "gate")
    for k, rows in enumerate([[(1, 0), (2, 50)], [(3, 10), (4, 45), (5, 49)], [(6, 90), (7, 41)]]):
        G.pass_batch(frame(spark, rows), k, path, "ts", 12 * HOUR)
    kept = G.gated(spark, path, frame(spark, []).schema).filter(F.col("outcome") == G.ACCEPTED)
    assert {r["id"] for r in kept.collect()} == {1, 2, 4, 5, 6, 7}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "outcome" in plan.split("PartitionFilters: [")[1].split("]")[0]
