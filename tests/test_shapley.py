"""Shapley values of trees against the formula over all subsets and all orders."""

from __future__ import annotations

import random
from datetime import timedelta
from itertools import permutations

import numpy as np
import pytest
from conftest import T0
from pyspark.sql import functions as F

from stratusqc.constants import FEATURES
from stratusqc.operators import forest as FO
from stratusqc.operators import shapley as SH
from stratusqc.operators.features import series_features


def grown(seed, rows, features, trees=3):
    """Small trees as arrays, with the rows that reached each node counted while growing."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, features)).round(1)
    tables = [FO._grow(x, np.random.default_rng([seed, t])) for t in range(trees)]
    shape = (trees, max(len(t) for t in tables))
    names = ("feature", "split", "left_child", "right_child", "leaf_path")
    forest = {n: np.full(shape, -1 if n in ("feature", "left_child", "right_child") else 0.0).astype(int if n in ("feature", "left_child", "right_child") else float) for n in names}
    count = np.zeros(shape)
    for t, table in enumerate(tables):
        for node, *values in table:
            for n, v in zip(names, values):
                forest[n][t, node] = v
        for row in x:
            node = 0
            while True:
                count[t, node] += 1
                f = forest["feature"][t, node]
                if f < 0:
                    break
                node = forest["left_child" if row[f] <= forest["split"][t, node] else "right_child"][t, node]
    return forest, count, x


def worth(forest, count, t, node, row, known):
    """Path length expected of a row of which only some features are known."""
    f = forest["feature"][t, node]
    if f < 0:
        return forest["leaf_path"][t, node]
    left, right = forest["left_child"][t, node], forest["right_child"][t, node]
    if f in known:
        return worth(forest, count, t, left if row[f] <= forest["split"][t, node] else right, row, known)
    parts = [count[t, c] * worth(forest, count, t, c, row, known) for c in (left, right)]
    return sum(parts) / count[t, node]


def plain_shapley(forest, count, row):
    k = len(row)
    mean = lambda known: np.mean([worth(forest, count, t, 0, row, known) for t in range(len(count))])
    out = np.zeros(k)
    orders = list(permutations(range(k)))
    for order in orders:
        for i, f in enumerate(order):
            out[f] += mean(set(order[: i + 1])) - mean(set(order[:i]))
    return out / len(orders)


@pytest.mark.parametrize("seed,rows,features", [(1, 2, 1), (2, 9, 2), (3, 20, 3), (4, 33, 4), (5, 12, 4)])
def test_equal_to_all_orders(seed, rows, features):
    forest, count, x = grown(seed, rows, features)
    cover = SH.covers(forest, rows)
    assert (cover == count).all()
    points = np.concatenate([x[:4], np.random.default_rng(seed).normal(size=(3, features)) * 3])
    got = SH.explained(forest, cover, points)
    for row, told in zip(points, got):
        expected = plain_shapley(forest, count, row)
        assert np.allclose(told[2:], expected)
        assert told[2:].sum() == pytest.approx(told[1] - told[0])
        assert told[1] == pytest.approx(FO._mean_path(forest, row[None])[0])


def test_a_feature_no_tree_asks_for_is_worth_nothing():
    forest, count, x = grown(7, 30, 3)
    wide = np.column_stack([x, np.random.default_rng(1).normal(size=len(x))])
    got = SH.explained(forest, SH.covers(forest, 30), wide)
    assert np.allclose(got[:, 5], 0) and np.allclose(got[:, 2:5], SH.explained(forest, count, x)[:, 2:])


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(4)
    rows = [(k, 1, T0 + timedelta(hours=k), "temperature", 20 + rng.gauss(0, 1) + (60 if k == 250 else 0)) for k in range(400)]
    rows += [(1000 + k, 1, T0 + timedelta(hours=k), "humidity", 1.0) for k in range(5)]  # too few for a forest
    long = spark.createDataFrame(rows, "reading_id long, station_id long, ts timestamp, variable string, value double")
    features = series_features(long)
    return features, FO.fit_forest(features, trees=20)


def test_rows_are_explained_as_scored(fitted):
    features, model = fitted
    told = {r["reading_id"]: r for r in SH.tree_attribution(features, model).collect()}
    assert set(told) == set(range(400))
    for r in told.values():
        phi = [r[f"{c}_phi"] for c in FEATURES]
        assert sum(phi) == pytest.approx(r["path_length"] - r["expected_path"])
        assert sum(abs(r[f"{c}_share"]) for c in FEATURES) == pytest.approx(1, abs=1e-3)
    assert len({round(r["expected_path"], 9) for r in told.values()}) == 1
    jump = told[250]
    assert jump["path_length"] == min(r["path_length"] for r in told.values())
    assert jump["primary_driver"] in ("value", "delta_1", "rolling_mean_diff", "rolling_std")
    assert all(jump[f"{c}_phi"] < 0 for c in ("value", "delta_1", "rolling_mean_diff", "rolling_std"))
    assert abs(jump["hour_sin_share"]) < 0.2


def test_no_rows_and_too_many_features(fitted):
    features, model = fitted
    assert SH.tree_attribution(features.filter(F.lit(False)), model).count() == 0
    with pytest.raises(ValueError):
        SH.tree_attribution(features, model, columns=[f"c{k}" for k in range(11)])


def packed_forest(trees, rows, seed):
    """Trees as scoring packs them, grown on ``rows`` with two constant features."""
    rng = np.random.default_rng(seed)
    tables = []
    for _ in range(trees):
        x = rng.normal(size=(rows, 6))
        x[:, 4:] = 0
        tables.append(FO._grow(x, rng))
    shape = (trees, max(r[0] for table in tables for r in table) + 1)
    kinds = {"feature": np.int8, "split": float, "left_child": np.int32, "right_child": np.int32, "leaf_path": float}
    forest = {k: np.full(shape, 0.0 if kind is float else -1, dtype=kind) for k, kind in kinds.items()}
    for t, table in enumerate(tables):
        for node, *facts in table:
            for k, fact in zip(kinds, facts):
                forest[k][t, node] = fact
    points = rng.normal(size=(300, 6))
    points[3, 1] = points[7, 4] = np.nan
    return forest, points


def test_tables_of_leaves_equal_the_walk_over_coalitions():
    for rows in (1, 2, 40, 256):
        forest, points = packed_forest(3, rows, rows)
        cover = SH.covers(forest, rows)
        worth = SH.coalition_values(forest, cover, points)
        walked = np.column_stack([worth[:, 0], worth[:, -1], SH.shapley_values(worth)])
        assert np.allclose(SH.explained(forest, cover, points), walked, atol=1e-12)
        # The work of a row: its entries in the tables, not coalitions of all nodes.
        _, leads, table = SH.leaf_tables(forest, cover, 0, 6)
        assert leads[0].shape[1] << 6 == len(table) and leads[0].shape[1] == (forest["leaf_path"][0] > 0).sum() or rows == 1


def test_rows_are_dealt_before_they_are_explained(spark):
    rows = [(s * 100 + k, s, T0 + timedelta(days=k), "temperature", float(k % 9 + s)) for s in range(3) for k in range(20)]
    long = spark.createDataFrame(rows, "reading_id long, station_id long, ts timestamp, variable string, value double")
    features = series_features(long)
    told = SH.tree_attribution(features, FO.fit_forest(features, trees=2))
    assert "RepartitionByExpression" in (plan := told._jdf.queryExecution().optimizedPlan().toString()) or "Repartition " in plan


def test_mean_paths_equal_single_walks():
    """Rows go through all trees in bounded groups; missing values go right."""
    forest, points = packed_forest(9, 256, 1)
    walked = []
    for row in points:
        leaves = []
        for t in range(9):
            node = 0
            while forest["feature"][t, node] >= 0:
                left = row[forest["feature"][t, node]] <= forest["split"][t, node]
                node = forest["left_child" if left else "right_child"][t, node]
            leaves.append(forest["leaf_path"][t, node])
        walked.append(np.mean(leaves))
    assert len(points) > FO.CHUNK and np.array_equal(FO._mean_path(forest, points), np.array(walked))
    assert len(FO._mean_path(forest, points[:0])) == 0
