"""Which feature isolated a row: Shapley values over the trees of the isolation forest.

The explained number is the mean path length of a row. A coalition of features is worth what the trees give when only
its features are known: at a split on a known feature the row goes its way, at a split on another one it goes both
ways, each with the share of the tree's sample that went there. A feature's value is its mean contribution over all
orders of joining, so the values of a row sum up to its path length minus the forest's mean. Negative values shorten
the path, that is, speak for an anomaly.

With six features there are 64 coalitions. What a leaf adds to a row's values depends only on the set of features that
lead the row towards it, so each tree gets a table of leaves x 64 such sets, and a row looks up its entry of each leaf.
The work per row is trees x leaves x 8 look-ups.
"""

from __future__ import annotations

from functools import cache
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratusqc.constants import FEATURES
from stratusqc.operators.features import standardize
from stratusqc.operators.forest import Z, ForestModel, _expected_path, _packed, _steady

MOST_FEATURES = 10
#: Rows that look up a tree's table together, which bounds memory to a megabyte or two.
CHUNK = 64


def covers(forest: dict[str, np.ndarray], sample: int) -> np.ndarray:
    """Rows of its sample that each tree had at each node.

    A leaf's path length is its depth plus the expected path of its rows, which grows with their number: so it tells it.
    """
    trees, nodes = forest["feature"].shape
    expected = np.array([_expected_path(n) for n in range(1, sample + 1)])
    count, depth = np.zeros((trees, nodes)), np.zeros((trees, nodes))
    inner = forest["feature"] >= 0
    for t in range(trees):
        order = []
        pending = [0]
        while pending:
            node = pending.pop()
            order.append(node)
            if inner[t, node]:
                for child in (int(forest["left_child"][t, node]), int(forest["right_child"][t, node])):
                    depth[t, child] = depth[t, node] + 1
                    pending.append(child)
        for node in reversed(order):
            if inner[t, node]:
                count[t, node] = count[t, forest["left_child"][t, node]] + count[t, forest["right_child"][t, node]]
            else:
                count[t, node] = 1 + np.abs(expected - (forest["leaf_path"][t, node] - depth[t, node])).argmin()
    return count


def coalition_values(forest: dict[str, np.ndarray], cover: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Mean path length of each row for each coalition; bit k of a coalition's number stands for feature k."""
    n, k = x.shape
    known = (np.arange(1 << k)[None, :] >> np.arange(k)[:, None] & 1).astype(bool)
    total = np.zeros((n, 1 << k))
    for t in range(len(cover)):
        pending = [(0, np.ones((n, 1 << k)))]
        while pending:
            node, weight = pending.pop()
            f = int(forest["feature"][t, node])
            if f < 0:
                total += weight * forest["leaf_path"][t, node]
                continue
            left, right = int(forest["left_child"][t, node]), int(forest["right_child"][t, node])
            goes_left = (x[:, f] <= forest["split"][t, node])[:, None]
            share = cover[t, left] / cover[t, node]
            pending.append((left, weight * np.where(known[f], goes_left, share)))
            pending.append((right, weight * np.where(known[f], ~goes_left, 1 - share)))
    return total / len(cover)


def shapley_values(values: np.ndarray) -> np.ndarray:
    """Shapley values of all features from the worth of all coalitions (last axis)."""
    k = int(values.shape[-1]).bit_length() - 1
    coalitions = np.arange(1 << k)
    size = np.array([int(c).bit_count() for c in coalitions])
    out = np.empty((*values.shape[:-1], k))
    for f in range(k):
        without = coalitions[(coalitions >> f & 1) == 0]
        weight = np.array([factorial(s) * factorial(k - s - 1) / factorial(k) for s in size[without]])
        out[..., f] = ((values[..., without | (1 << f)] - values[..., without]) * weight).sum(axis=-1)
    return out


@cache
def _weights(k: int) -> np.ndarray:
    """What each coalition's worth counts for the mean, the path length and the Shapley values."""
    one = np.eye(1 << k)
    return np.column_stack([one[0], one[-1], shapley_values(one)])


def _leaves(forest: dict[str, np.ndarray], cover: np.ndarray, t: int, k: int, splits: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of each leaf of a tree: path length, per feature the stretch of places among its ``splits`` that leads there
    (first and last), and the product of the shares that its splits on the feature send there."""
    rows = []
    pending = [(0, np.zeros(k, dtype=int), np.array([len(s) for s in splits]), np.ones(k))]
    while pending:
        node, first, last, share = pending.pop()
        f = int(forest["feature"][t, node])
        if f < 0:
            rows.append((forest["leaf_path"][t, node], first, last, share))
            continue
        at = int(np.searchsorted(splits[f], forest["split"][t, node]))
        for child, low, high in ((int(forest["left_child"][t, node]), 0, at), (int(forest["right_child"][t, node]), at + 1, len(splits[f]))):
            narrow = first.copy(), last.copy(), share.copy()
            narrow[0][f], narrow[1][f] = max(first[f], low), min(last[f], high)
            narrow[2][f] *= cover[t, child] / cover[t, node]
            pending.append((child, *narrow))
    return tuple(np.array(column) for column in zip(*rows))


def leaf_tables(forest: dict[str, np.ndarray], cover: np.ndarray, t: int, k: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of one tree: each feature's splits in order; per place among them the leaves it leads to, as bit f; and what each
    leaf adds (mean, path length, Shapley values) for each set of features that lead to it."""
    used = forest["feature"][t]
    splits = [np.unique(forest["split"][t][used == f]) for f in range(k)]
    path, first, last, share = _leaves(forest, cover, t, k, splits)
    leads = []
    for f in range(k):
        place = np.arange(len(splits[f]) + 1)[:, None]
        leads.append(((first[:, f] <= place) & (place <= last[:, f])).astype(np.uint16) << f)
    # A coalition is worth something at a leaf if all its features lead there; the others count with their shares.
    coalitions = np.arange(1 << k)
    others = np.ones((len(path), 1 << k))
    for f in range(k):
        others *= np.where(coalitions >> f & 1, 1.0, share[:, f, None])
    worth = (path[:, None] * others)[:, :, None] * _weights(k)
    for f in range(k):  # sums over all subsets of the set
        halves = worth.reshape(len(path), -1, 2, 1 << f, k + 2)
        halves[:, :, 1] += halves[:, :, 0]
    return splits, leads, worth.reshape(-1, k + 2)


def explained(forest: dict[str, np.ndarray], cover: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Per row the forest's mean, the row's own path length, and the Shapley value of each feature."""
    n, k = x.shape
    total = np.zeros((n, 2 + k))
    for t in range(len(cover) if n else 0):
        splits, leads, worth = leaf_tables(forest, cover, t, k)
        entry = np.arange(len(worth) >> k) << k
        # Missing values are placed behind all splits, which is to the right.
        place = [np.searchsorted(s, x[:, f]) for f, s in enumerate(splits)]
        for at in range(0, n, CHUNK):
            towards = sum(lead[p[at : at + CHUNK]] for lead, p in zip(leads, place))
            total[at : at + CHUNK] += worth.take(entry + towards, axis=0).sum(axis=1)
    return total / len(cover)


def tree_attribution(features: DataFrame, model: ForestModel, columns=FEATURES) -> DataFrame:
    """Add expected_path, path_length, ``<feature>_phi``, signed ``<feature>_share`` and primary_driver.

    Shares are of the sum of the absolute values; the driver is the feature with the largest one, the first of equals.
    Rows of variables without trees are left out, as by scoring. Rows with a missing feature go right at its splits,
    as in scoring.
    """
    if len(columns) > MOST_FEATURES:
        raise ValueError(f"coalitions of more than {MOST_FEATURES} features are too many to value")
    spark = features.sparkSession
    sizes = {r["variable"]: r["sample_size"] for r in model.cutoffs.select("variable", "sample_size").collect()}
    packed = {v: f for v, f in _packed(model.nodes).items() if v in sizes}
    trees = spark.sparkContext.broadcast({v: (f, covers(f, int(sizes[v]))) for v, f in packed.items()})

    @F.pandas_udf("array<double>")
    def values(variable: pd.Series, *z: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in z])
        names = variable.to_numpy()
        out: list = [None] * len(x)
        for name in pd.unique(names):
            if name in trees.value:
                hit = np.flatnonzero(names == name)
                for i, row in zip(hit, explained(*trees.value[name], x[hit])):
                    out[i] = row
        return pd.Series(out)

    # Few bytes, much work: dealt by rows, since the files of a table may be one task's worth of bytes.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    scaled = _steady(standardize(features.repartition(parts), model.scaler)).withColumn("_values", values("variable", *Z))
    named = {"expected_path": F.col("_values")[0], "path_length": F.col("_values")[1]}
    named |= {f"{c}_phi": F.col("_values")[i + 2] for i, c in enumerate(columns)}
    out = scaled.filter(F.col("_values").isNotNull()).withColumns(named).drop("_values", *Z)
    total = sum((F.abs(F.col(f"{c}_phi")) for c in columns), F.lit(0.0)) + F.lit(1e-6)
    out = out.withColumns({f"{c}_share": F.bround(F.col(f"{c}_phi") / total, 4) for c in columns})
    best = F.greatest(*[F.abs(F.col(f"{c}_share")) for c in columns])
    return out.withColumn("primary_driver", F.coalesce(*[F.when(F.abs(F.col(f"{c}_share")) == best, F.lit(c)) for c in columns]))
