"""Batches judged one after the other against one run over all readings."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratusqc.constants import VARIABLES
from stratusqc.operators import incremental as I
from stratusqc.operators.qc import merged_verdicts
from stratusqc.operators.spatial import knn_stations
from stratusqc.session import scratch_dir, write_and_reread

START, DAYS, STATIONS = datetime(2024, 6, 1), 6, 5
COLUMNS = ["qc_id", "verdict", "fault_type", "reason_code", "confidence", "rule_reason", "spatial_reason", "delta", "flat_value", "corrected_value"]


@pytest.fixture(scope="module")
def fleet(spark):
    """Six days, every three hours, with flat stretches, steps and gaps; station 5 is silent for three days."""
    rng = random.Random(1)
    rows = []
    for s in range(1, STATIONS + 1):
        values = {v: 20.0 for v in VARIABLES}
        for k in range(DAYS * 8):
            if s == 5 and 8 <= k < 32:
                continue
            for v in VARIABLES:
                values[v] += rng.choice([0, 0, 0, 1.5, -1.5, 40 if rng.random() < 0.1 else 0.3])
            shown = [values[v] if rng.random() > 0.1 else None for v in VARIABLES]
            rows.append((s * 1000 + k, s, START + timedelta(hours=3 * k), *shown))
    return write_and_reread(spark.createDataFrame(rows, I.READING), "fleet")


@pytest.fixture(scope="module")
def stations(make_stations):
    return make_stations(*[(s, 28.5 + 0.05 * s, 77.2) for s in range(1, STATIONS + 1)])


@pytest.fixture(scope="module")
def make_stations(spark):  # noqa: F811
    def build(*rows):
        full = [(r[0], float(r[1]), float(r[2]), None) for r in rows]
        spec = "map<string,struct<min:double,max:double,step_max:double,persistence_max:int,unit:string>>"
        return spark.createDataFrame(full, f"station_id long, latitude double, longitude double, sensor_specs {spec}")

    return build


@pytest.fixture(scope="module")
def edges(stations):
    return write_and_reread(knn_stations(stations), "edges")


@pytest.fixture(scope="module")
def whole(fleet, stations, edges):
    return rows_of(merged_verdicts(fleet, stations, edges))


def rows_of(qc):
    plain = [F.round(c, 9).alias(c) if c in ("delta", "flat_value", "corrected_value") else F.col(c) for c in COLUMNS]
    return sorted(qc.select(*plain).collect(), key=lambda r: r["qc_id"])


def day(k):
    return F.lit(START + timedelta(days=k))


def test_batches_in_order_equal_one_run(spark, fleet, stations, edges, whole):
    store = scratch_dir(spark, "store")
    for k in range(0, DAYS, 2):
        part = fleet.filter((F.col("ts") >= day(k)) & (F.col("ts") < day(k + 2)))
        assert I.judge_batch(store, part, stations, edges)["last_day"] == date(2024, 6, 2 + k)
    assert rows_of(I.stored_verdicts(spark, store)) == whole
    assert sorted(I.stored_readings(spark, store).select(*fleet.columns).collect()) == sorted(fleet.collect())


@pytest.mark.parametrize("seed", range(2))
def test_any_split_equals_one_run(spark, fleet, stations, edges, whole, seed):
    """Readings dealt at random, so that nearly every batch brings late ones; two are taken in twice."""
    store = scratch_dir(spark, "store")
    dealt = F.pmod(F.xxhash64("reading_id", F.lit(seed)), F.lit(3))
    for k in (0, 1, 2, 1):
        I.judge_batch(store, fleet.filter(dealt == k), stations, edges)
    assert rows_of(I.stored_verdicts(spark, store)) == whole


def test_late_station_moves_later_verdicts(spark, fleet, stations, edges, whole):
    store = scratch_dir(spark, "store")
    late = (F.col("station_id") == 2) & (F.col("ts") >= day(1)) & (F.col("ts") < day(3))
    I.judge_batch(store, fleet.filter((F.col("ts") < day(2)) & ~late), stations, edges)
    I.judge_batch(store, fleet.filter((F.col("ts") >= day(2)) & ~late), stations, edges)
    assert rows_of(I.stored_verdicts(spark, store)) != whole
    assert I.judge_batch(store, fleet.filter(late), stations, edges) == {"first_day": date(2024, 6, 2), "last_day": date(2024, 6, 6)}
    assert rows_of(I.stored_verdicts(spark, store)) == whole
    assert I.recent_days(spark, store) == [date(2024, 6, 2), date(2024, 6, 6)]


def test_batch_in_order_reads_no_old_readings(spark, fleet, stations, edges, whole):
    """Old readings and verdicts are spoilt in the store; a later batch neither sees nor touches them."""
    store = scratch_dir(spark, "store")
    I.judge_batch(store, fleet.filter(F.col("ts") < day(3)), stations, edges)
    spoilt = I.stored_readings(spark, store).withColumns({v: F.lit(-5e6) for v in VARIABLES})
    write_and_reread(spoilt, "spoilt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{store}/readings")
    before = files(I.stored_verdicts(spark, store))
    I.judge_batch(store, fleet.filter(F.col("ts") >= day(3)), stations, edges)
    assert rows_of(I.stored_verdicts(spark, store)) == whole
    assert before < files(I.stored_verdicts(spark, store))
    old = I.stored_readings(spark, store).filter(F.col("day") > F.lit(date(2024, 6, 6)))
    assert "PartitionFilters: [isnotnull(day" in old._jdf.queryExecution().toString()


def files(df):
    return {r["f"] for r in df.select(F.input_file_name().alias("f")).distinct().collect()}


def test_stored_readings_win_and_unusable_ones_stay_out(spark, fleet, stations, edges):
    store = scratch_dir(spark, "store")
    first = fleet.filter(F.col("ts") < day(1))
    I.judge_batch(store, first, stations, edges)
    again = first.withColumns({"reading_id": F.col("reading_id") - 900, "temperature": F.lit(1e6)})
    none = first.limit(3).withColumn("ts", F.lit(None).cast("timestamp")).unionByName(first.limit(3).withColumn("station_id", F.lit(None).cast("long")))
    I.judge_batch(store, again.unionByName(none), stations, edges)
    assert sorted(I.stored_readings(spark, store).select(*fleet.columns).collect()) == sorted(first.collect())
    assert I.judge_batch(store, none, stations, edges) is None
    assert I.judge_batch(scratch_dir(spark, "store"), fleet.limit(0), stations, edges) is None


def test_a_large_fleet_is_not_gathered_in_the_driver(spark, fleet, stations, edges, whole, monkeypatch):
    """Tables of the fleet's size, however few bytes their files have, are merged; a small fleet is broadcast."""
    written, plans = write_and_reread(stations, "stations"), []
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan_of(knn_stations(written))
    monkeypatch.setattr(I, "merged_verdicts", lambda *a: plans.append(plan_of(merged_verdicts(*a))) or merged_verdicts(*a))
    monkeypatch.setattr(I, "BROADCAST_ROWS", 3, raising=False)
    store = scratch_dir(spark, "store")
    I.judge_batch(store, fleet, written, edges)
    assert "Broadcast" not in plans[0] and rows_of(I.stored_verdicts(spark, store)) == whole
    monkeypatch.setattr(I, "BROADCAST_ROWS", 100)
    I.judge_batch(scratch_dir(spark, "store"), fleet, written, edges)
    assert "BroadcastHashJoin" in plans[1]
