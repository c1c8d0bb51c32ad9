from __future__ import annotations

import random
from datetime import timedelta

import pytest
from conftest import T0
from pyspark.sql import functions as F

from stratusqc.operators.history import position, range_parts, time_span, with_balanced_history, with_history
from stratusqc.session import write_and_reread


@pytest.mark.parametrize("depth,seconds", [(1, 3600), (3, 600), (5, 7200), (20, 86400)])
def test_cut_history_equals_brute_force(spark, depth, seconds):
    """One key holds most rows; spans are of very uneven size and often empty."""
    rng = random.Random(depth)
    rows, at = [], 0
    for i in range(400):
        at += rng.choice([1, 2, 30, 400, 9000])
        rows.append((1 if rng.random() < 0.8 else rng.randint(2, 5), T0 + timedelta(seconds=at), i if i % 7 else None))
    df = spark.createDataFrame(rows, "k long, ts timestamp, v long")
    got = {(r["k"], r["ts"]): [h["v"] for h in r["history"]] for r in with_history(
        df, ["k"], ["ts"], ["v"], depth, span=time_span("ts", seconds)).collect()}
    by_key: dict = {}
    for k, ts, v in sorted(rows, key=lambda r: (r[0], r[1])):
        by_key.setdefault(k, []).append(v)
        assert got[(k, ts)] == by_key[k][-depth - 1 :]
    assert len(got) == len(rows)


@pytest.fixture(scope="module")
def skewed(spark):
    """Nine of ten rows belong to one key, most of them to one hour."""
    rng = random.Random(6)
    rows, used = [], set()
    while len(rows) < 6000:
        k = 1 if rng.random() < 0.9 else rng.choice([2, 3, 4, None])
        at = rng.randint(0, 3_600_000) if rng.random() < 0.8 else rng.randint(0, 10**9)
        if (k, at) not in used:
            used.add((k, at))
            rows.append((k, T0 + timedelta(milliseconds=at), len(rows)))
    return write_and_reread(spark.createDataFrame(rows, "k long, ts timestamp, v long"), "skewed"), rows


def in_order(rows):
    by_key: dict = {}
    for k, ts, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        by_key.setdefault(k, []).append(v)
    return by_key


def test_parts_are_of_equal_size_and_in_order(skewed):
    dealt = range_parts(skewed[0], ["k"], ["ts"], parts=16)
    parts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "ts")).alias("low"), F.max(F.struct("k", "ts")).alias("high"))
    parts = sorted(parts.collect(), key=lambda r: r["_part"])
    sizes = sorted(r["n"] for r in parts)
    assert len(parts) == 16 and sizes[-1] <= 2 * sizes[8]
    key = lambda r: (r["k"] is not None, r["k"] or 0, r["ts"])
    assert all(key(a["high"]) < key(b["low"]) for a, b in zip(parts, parts[1:]))


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_positions_under_skew(skewed, parts):
    df, rows = skewed
    got = {r["v"]: r["pos"] for r in position(df, ["k"], ["ts"], parts=parts).collect()}
    assert len(got) == len(rows)
    for values in in_order(rows).values():
        assert [got[v] for v in values] == list(range(len(values)))


@pytest.mark.parametrize("depth", [1, 20])
def test_history_under_skew(skewed, depth):
    df, rows = skewed
    df = df.filter("k is not null")
    got = {r["v"]: [h["v"] for h in r["history"]] for r in with_balanced_history(df, ["k"], ["ts"], ["v"], depth, parts=40).collect()}
    for k, values in in_order(rows).items():
        if k is not None:
            assert all(got[v] == values[max(0, i - depth) : i + 1] for i, v in enumerate(values))


def test_no_task_numbers_a_whole_key(skewed):
    plan = position(skewed[0], ["k"], ["ts"], parts=16)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(k" in plan and "_part" in plan.split("row_number() windowspecdefinition(k")[1][:20]
