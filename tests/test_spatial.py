from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from stratusqc.operators import spatial as S
from stratusqc.operators.reshape import wide_to_long


def brute(points, k, max_km):
    def xyz(lat, lon):
        la, lo = math.radians(lat), math.radians(lon)
        return 6371 * math.cos(la) * math.cos(lo), 6371 * math.cos(la) * math.sin(lo), 6371 * math.sin(la)

    out = set()
    for i, *p in points:
        near = sorted((round(math.dist(xyz(*p), xyz(*q)), 6), j) for j, *q in points if j != i)
        out |= {(i, j, r + 1) for r, (km, j) in enumerate([n for n in near if n[0] <= max_km][:k])}
    return out


def layouts():
    rng = random.Random(7)
    spread = [(i, rng.uniform(-60, 60), rng.uniform(-180, 180)) for i in range(80)]
    city = [(100 + i, 28.6 + rng.gauss(0, 0.01), 77.2 + rng.gauss(0, 0.01)) for i in range(120)]
    rural = [(300 + i, 28.6 + rng.uniform(-2, 2), 77.2 + rng.uniform(-2, 2)) for i in range(30)]
    same = [(400 + i, 28.61, 77.21) for i in range(25)]
    border = [(500 + i, rng.uniform(-0.5, 0.5), rng.choice([-179.9, 179.9])) for i in range(12)]
    polar = [(600 + i, 89.5, i * 36.0) for i in range(10)]
    return {
        "spread": spread, "city_and_rural": city + rural, "coincident": same + city[:20], "date_line": border, "polar": polar,
    }


@pytest.mark.parametrize("name", list(layouts()))
def test_neighbours_equal_brute_force(make_stations, name):
    points = layouts()[name]
    for k, km in ((5, 150.0), (2, 40.0)):
        got = {(r["station_id"], r["neighbor_id"], r["rank"]) for r in S.knn_stations(make_stations(*points), k, km).collect()}
        assert got == brute(points, k, km)


def test_far_station_is_no_neighbour(make_stations):
    stations = make_stations((1, 28.58, 77.20), (2, 28.65, 77.18), (3, 28.56, 77.11), (4, 18.90, 72.81))
    edges = S.knn_stations(stations).collect()
    assert {e["station_id"] for e in edges} == {1, 2, 3}
    assert all(e["neighbor_id"] != 4 for e in edges)


@pytest.mark.parametrize(
    "value,neighbours,reason",
    [(46.0, [31.0, 31.5, 32.0, 31.8], "SPATIAL_MISMATCH"), (45.5, [45.0, 45.8, 44.9, 45.2], "SPATIAL_CONSISTENT"),
     (46.0, [31.0], "SPATIAL_INSUFFICIENT_DATA"), (34.0, [31.0, 31.0, 31.0], "SPATIAL_CONSISTENT"),
     (None, [31.0, 31.0], "SPATIAL_INSUFFICIENT_DATA"), (34.5, [31.0, 31.0, None], "SPATIAL_MISMATCH")],
)
def test_isolated_or_regional(make_readings, make_stations, value, neighbours, reason):
    data = {1: {"temperature": [value]}} | {i + 2: {"temperature": [v]} for i, v in enumerate(neighbours)}
    stations = make_stations(*[(i, 28.5 + i * 0.05, 77.2) for i in data])
    long = wide_to_long(make_readings(data)).filter("variable = 'temperature'")
    stats = S.neighbor_values(long, S.knn_stations(stations))
    row = S.spatial_check(long.join(stats, ["station_id", "ts", "variable"], "left")).filter("station_id = 1").first()
    assert row["spatial_reason"] == reason


def test_station_without_neighbours_keeps_a_row(make_readings, make_stations):
    stations = make_stations((1, 28.5, 77.2), (2, 10.0, 10.0))
    long = wide_to_long(make_readings({1: {"temperature": [20.0]}, 2: {"temperature": [21.0]}}))
    rows = S.spatial_verdicts(long, S.knn_stations(stations)).collect()
    assert {(r["station_id"], r["spatial_reason"], r["confidence"]) for r in rows} == {
        (1, "SPATIAL_INSUFFICIENT_DATA", 0.5), (2, "SPATIAL_INSUFFICIENT_DATA", 0.5)}


def test_peers_survive_large_offsets(spark, make_readings):
    """Values far from zero with a tiny spread: taking one value out of the totals must not cancel."""
    data = {i: {"pressure": [1e9 + i * 0.25]} for i in range(1, 9)}
    long = wide_to_long(make_readings(data)).filter("variable = 'pressure'")
    for r in S.same_instant_peers(long).collect():
        others = [1e9 + i * 0.25 for i in range(1, 9) if i != r["station_id"]]
        mean = sum(others) / 7
        assert r["n"] == 7 and abs(r["mean"] - mean) < 1e-5
        assert abs(r["std"] - math.sqrt(sum((o - mean) ** 2 for o in others) / 7)) < 1e-4


def test_peers_of_an_extreme_value_have_no_invented_spread(make_readings):
    """Others agree, the row itself is far off: taking it out of the totals must leave nothing."""
    for others in ([20.0], [20.0, 20.0, 20.0]):
        data = {1: {"temperature": [987.65]}} | {i + 2: {"temperature": [v]} for i, v in enumerate(others)}
        long = wide_to_long(make_readings(data)).filter("variable = 'temperature'")
        row = S.same_instant_peers(long).filter("station_id = 1").first()
        assert row["std"] == 0.0 and abs(row["mean"] - 20.0) < 1e-9


def test_peers_of_missing_values(make_readings):
    long = wide_to_long(make_readings({1: {"temperature": [None]}, 2: {"temperature": [5.0]}})).filter("variable = 'temperature'")
    got = {r["station_id"]: (r["n"], r["mean"]) for r in S.same_instant_peers(long).collect()}
    assert got == {1: (1, 5.0), 2: (0, None)}


def test_plan_compares_no_cartesian_product(make_stations):
    plan = S.knn_stations(make_stations((1, 1.0, 1.0), (2, 1.1, 1.1)))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_search_is_dealt_into_partitions_and_bounded_before_ranking(spark):
    """A crowd of places: few bytes, many pairs. They may not meet in one task, nor be ranked beyond the bound."""
    points = spark.range(2500).select(
        F.col("id").alias("station_id"), (20 + 0.05 * (F.col("id") % 50)).alias("latitude"), (70 + 0.05 * F.floor(F.col("id") / 50)).alias("longitude")
    )
    edges = S.knn_stations(points)
    edges.collect()
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    # With k = 5, 27 whole cubes of the level above hold some 200 places, those within the diagonal about 60.
    assert "<= reach#" in edges._jdf.queryExecution().optimizedPlan().toString()
