"""Sliding windows of a stream: kept once per pane, and row for row what Spark's own windows give."""

from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stratusqc.streaming import jobs as J

T = datetime(2024, 6, 1)
LONG = "station_id {}, ts timestamp, variable string, value double"
NAN = float("nan")


def own_windows(long, length="10 hours", slide="1 hour"):
    """Spark's windows, which hold every value once for each window it lies in."""
    stats = [F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean")]
    found = long.withWatermark("ts", "1 hour").groupBy(F.window("ts", length, slide), "station_id", "variable").agg(*stats)
    return found.select("window.start", "window.end", "station_id", "variable", "n", "min", "max", "mean")


def pane_windows(long, length="10 hours", slide="1 hour"):
    return J.stream_window_stats(long, length, slide, buckets=6)


def deliver(spark, folder, rows, station="long"):
    spark.createDataFrame(rows, LONG.format(station)).coalesce(1).write.mode("append").parquet(folder)


def outputs(spark, folder, windows, deliveries, station="long", apart=True, drain=True):
    """What is out after each delivery (``apart``), or after one run with a micro-batch for each; then after the end."""
    deliver(spark, f"{folder}/in", [], station)
    schema = spark.read.parquet(f"{folder}/in").schema
    stream, end = J.with_drain(J.file_stream(spark, f"{folder}/in", schema, "*.parquet", max_files=1), "ts", "w")
    seen, listed = [], lambda df: sorted(map(repr, df.select(*df.columns[:-1], F.round("mean", 6)).collect()))
    for k, rows in enumerate(deliveries):
        deliver(spark, f"{folder}/in", [(s, T + timedelta(hours=h), v, x) for s, h, v, x in rows], station)
        if apart or k + 1 == len(deliveries):
            last = drain and k + 1 == len(deliveries)
            seen.append(listed(J.run_to_table(windows(stream), "w", f"{folder}/out", end if last else None)))
    return seen


LATE = [
    [(1, 0, "a", 1.0), (1, 0.5, "a", 3.0), (2, 11 - 1e-6, "b", None), (None, 3, "a", 2.0), (2, 4, None, 5.0)],
    [(1, 11, "a", 4.0), (1, 5, "a", NAN)],
    [(2, 11 + 2e-6, "a", -1.0), (1, 1.5, "a", 9.0), (1, 30, "a", NAN)],
    [(1, 25, "a", 7.0), (3, 19.5, "a", 7.0), (3, 3, "a", 1.0), (1, 45, "a", float("inf"))],
    [(1, 47, "b", float("-inf")), (1, 44, "b", float("inf")), (1, 90, "a", 0.0)],
]


@pytest.mark.parametrize("apart", [True, False])
def test_late_values_count_in_windows_that_are_open(spark, tmp_path, apart):
    made = [outputs(spark, f"{tmp_path}/{k}", w, LATE, apart=apart) for k, w in enumerate((own_windows, pane_windows))]
    assert made[0][-1] and made[1] == made[0]


@pytest.mark.parametrize(("length", "slide"), [("7 minutes", "3 minutes"), ("1 day", "1 day"), ("90 minutes", "1 hour")])
def test_any_length_and_slide(spark, tmp_path, length, slide):
    rows = [[(f"s{k % 3}", k * 0.031, "ab"[k % 2], float(k * 7 % 13)) for k in range(60)]]
    made = [
        outputs(spark, f"{tmp_path}/{k}", lambda long, w=w: w(long, length, slide), rows, "string")
        for k, w in enumerate((own_windows, pane_windows))
    ]
    assert made[0][-1] and made[1] == made[0]


def test_state_holds_a_value_once(spark, tmp_path):
    """Less than 100 bytes a value in the checkpoint, not a row for each of its ten windows."""
    rows = [(k % 500, (k * 37 % 9973) / 14, "ab"[k % 2], k * 0.37) for k in range(20_000)]
    outputs(spark, tmp_path, J.stream_window_stats, [rows], drain=False)
    state = Path(tmp_path, "out", "checkpoint", "state")
    first = [f for f in state.rglob("1.zip")] + [f for f in state.rglob("*.sst")]
    assert sum(f.stat().st_size for f in first) < 100 * len(rows)
