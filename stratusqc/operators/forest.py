"""Isolation forest (Liu, Ting and Zhou, 2008): trees grown in parallel, scoring vectorised.

Only bounded samples ever meet in one task: a tree is grown from at most ``sample`` rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratusqc.constants import FEATURES, FOREST_CONTAMINATION, FOREST_SAMPLE, FOREST_SEED, FOREST_TREES
from stratusqc.functions.scoring import isolation_confidence, isolation_flag, isolation_score, ml_fault
from stratusqc.operators.features import add_features, fit_scaler, standardize
from stratusqc.operators.quantiles import exact_quantile
from stratusqc.schemas import FOREST_NODES
from stratusqc.session import write_and_reread

Z = [f"{c}_z" for c in FEATURES]
MIN_ROWS = 12
MAX_NODES = 5_000_000  # about 150 MB as arrays


@dataclass(frozen=True)
class ForestModel:
    """Trees and their calibration, all small tables keyed by variable."""

    nodes: DataFrame
    scaler: DataFrame
    cutoffs: DataFrame  # variable, offset, threshold, sample_size
    version: str = "v1.0.0"

    def with_threshold(self, thresholds: DataFrame, version: str) -> ForestModel:
        cutoffs = self.cutoffs.drop("threshold").join(thresholds.select("variable", "threshold"), "variable")
        return replace(self, cutoffs=cutoffs, version=version)


def _expected_path(n: float) -> float:
    """Mean depth at which an unsuccessful search ends in a tree of ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _steady(scaled: DataFrame) -> DataFrame:
    """Inputs cut to nine places: the summation order of a distributed mean must not move a row
    to the other side of a split, in this run or the next."""
    return scaled.withColumns({c: F.round(c, 9) for c in Z})


def _grow(x: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """One tree as rows (node, feature, split, left, right, leaf_path); feature -1 marks a leaf."""
    limit = max(1, math.ceil(math.log2(max(len(x), 2))))
    rows: list[tuple] = []
    pending, next_id = [(0, np.arange(len(x)), 0)], 1
    while pending:
        node, members, depth = pending.pop()
        part = x[members]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(members) <= 1 or len(usable) == 0:
            rows.append((node, -1, 0.0, -1, -1, depth + _expected_path(len(members))))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        goes_left = part[:, f] <= cut
        if goes_left.all():  # the range is so narrow that the cut was rounded up to its end
            cut = float(low[f])
            goes_left = part[:, f] <= cut
        rows.append((node, f, cut, next_id, next_id + 1, 0.0))
        pending += [(next_id, members[goes_left], depth + 1), (next_id + 1, members[~goes_left], depth + 1)]
        next_id += 2
    return rows


def _tree_samples(scaled: DataFrame, trees: int, sample: int, seed: int) -> DataFrame:
    """Rows of every tree, drawn from all rows of a variable by thresholds on hashes.

    Nothing is ranked over a whole variable. A row is looked at further if its first hash is small enough for
    two times the rows that all trees need together, then each tree takes it by a hash of its own. Every row has
    the same chance in every tree, whatever the size of the table, and a retried task draws the same rows. Half as
    many again as needed are drawn; that fewer than ``sample`` remain of a larger table is a matter of six standard
    deviations. Only those few are ranked, per tree.
    """
    key = ["station_id", "ts"]
    counts = scaled.groupBy("variable").agg(F.count(F.lit(1)).alias("_n"))
    spread = 1 << 40
    first = F.least(F.lit(1.0), F.lit(2.0 * sample * trees) / F.col("_n"))
    drawn = F.least(F.lit(1.0), F.lit(1.5 * sample) / F.col("_n"))
    looked = (
        _steady(scaled.select("variable", *key, *Z))
        .join(counts, "variable")
        .filter(F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(spread)) < first * spread)
    )
    w = Window.partitionBy("variable", "tree").orderBy("_t", *key)
    return (
        looked.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        .withColumn("_t", F.xxhash64(*key, "tree", F.lit(seed + 1)))
        .filter(F.pmod(F.col("_t"), F.lit(spread)) < drawn / first * spread)
        .withColumn("_d", F.row_number().over(w))
        .filter(F.col("_d") <= sample)
        .select("variable", "tree", *key, *Z)
    )


def grow_forest(
    scaled: DataFrame, trees: int = FOREST_TREES, sample: int = FOREST_SAMPLE, seed: int = FOREST_SEED
) -> DataFrame:
    """Tree nodes from standardised features (variable, station_id, ts, ``*_z``)."""

    def grow(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        variable, tree = key
        x = frame.sort_values(["station_id", "ts"])[Z].to_numpy()
        rng = np.random.default_rng([seed, int(tree), *variable.encode()])
        rows = _grow(x, rng)
        out = pd.DataFrame(rows, columns=["node", "feature", "split", "left_child", "right_child", "leaf_path"])
        out.insert(0, "variable", variable)
        out.insert(1, "tree", int(tree))
        return out

    # A fixed number of partitions: the samples are few bytes but much work, so they must not be coalesced.
    drawn = _tree_samples(scaled, trees, sample, seed).repartition(trees, "variable", "tree")
    return drawn.groupBy("variable", "tree").applyInPandas(grow, FOREST_NODES)


def _packed(nodes: DataFrame) -> dict[str, dict[str, np.ndarray]]:
    """Model arrays per variable. The forest is metadata of fixed size: trees x 2*sample nodes.

    The size is checked before anything leaves the executors.
    """
    if nodes.count() > MAX_NODES:
        raise ValueError(f"forest has more than {MAX_NODES} nodes; score groups of variables separately")
    frame = nodes.toPandas()
    packed = {}
    for variable, part in frame.groupby("variable"):
        trees = {t: i for i, t in enumerate(sorted(part["tree"].unique()))}
        shape = (len(trees), int(part["node"].max()) + 1)
        at = (part["tree"].map(trees).to_numpy(), part["node"].to_numpy())
        arrays = {}
        for column, kind in (("feature", np.int8), ("split", float), ("left_child", np.int32),
                             ("right_child", np.int32), ("leaf_path", float)):
            a = np.full(shape, -1 if kind is not float else 0.0, dtype=kind)
            a[at] = part[column].to_numpy()
            arrays[column] = a
        packed[variable] = arrays
    return packed


#: Rows that walk through all trees together, which keeps their state in a processor's cache.
CHUNK = 256


def _mean_path(forest: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Average leaf path over all trees, walking rows and trees level by level.

    All trees are one table of nodes, in which a leaf leads to itself, so a level is four look-ups.
    """
    trees, nodes = forest["feature"].shape
    inner = (forest["feature"] >= 0).ravel()
    roots = np.arange(trees) * nodes
    first, own = np.repeat(roots, nodes), np.arange(trees * nodes)
    child = np.empty(2 * trees * nodes, dtype=np.intp)  # right at 2 * node, left behind it
    child[0::2] = np.where(inner, first + forest["right_child"].ravel(), own)
    child[1::2] = np.where(inner, first + forest["left_child"].ravel(), own)
    feature = np.maximum(forest["feature"], 0).astype(np.intp).ravel()
    split, leaf_path = forest["split"].ravel(), forest["leaf_path"].ravel()
    depth, level = 0, roots[inner[roots]]
    while len(level):
        depth, level = depth + 1, child.reshape(-1, 2)[level].ravel()
        level = level[inner[level]]
    out = np.empty(len(x))
    for at in range(0, len(x), CHUNK):
        part = np.ascontiguousarray(x[at : at + CHUNK])
        flat, row = part.ravel(), np.arange(len(part))[:, None] * part.shape[1]
        node = np.broadcast_to(roots, (len(part), trees))
        for _ in range(depth):
            left = flat.take(feature.take(node) + row) <= split.take(node)
            node = child.take(2 * node + left)
        out[at : at + CHUNK] = leaf_path.take(node).mean(axis=1)
    return out


def sample_scores(scaled: DataFrame, nodes: DataFrame, sample_sizes: DataFrame) -> DataFrame:
    """Add ``forest_score`` in [-1, 0], lower is more isolated; NULL for variables without trees."""
    forest = scaled.sparkSession.sparkContext.broadcast(_packed(nodes))

    @F.pandas_udf("double")
    def mean_path(variable: pd.Series, *columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        names = variable.to_numpy()
        out = np.full(len(x), np.nan)
        for name in pd.unique(names):
            if name in forest.value:
                hit = names == name
                out[hit] = _mean_path(forest.value[name], x[hit])
        return pd.Series(out)

    path = mean_path("variable", *Z)
    n = F.col("sample_size").cast("double")
    usual = 2.0 * (F.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n
    return (
        _steady(scaled)
        .join(sample_sizes.select("variable", "sample_size"), "variable")
        .withColumn("_path", path)
        .withColumn("forest_score", -F.pow(F.lit(2.0), -F.col("_path") / usual))
        .drop("_path", "sample_size")
    )


def fit_forest(
    features: DataFrame,
    trees: int = FOREST_TREES,
    sample: int = FOREST_SAMPLE,
    contamination: float = FOREST_CONTAMINATION,
    seed: int = FOREST_SEED,
    version: str = "v1.0.0",
) -> ForestModel:
    """Fit one forest per variable; variables with fewer than 12 rows get none.

    The offset is the ``contamination`` quantile of the training scores, so decisions below 0
    mark that share of the training rows.
    """
    counts = features.groupBy("variable").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= MIN_ROWS)
    sizes = counts.select("variable", F.least(F.col("_n"), F.lit(sample)).alias("sample_size"))
    scaler = write_and_reread(fit_scaler(features.join(counts, "variable", "left_semi")), "scaler")
    scaled = standardize(features, scaler)
    nodes = write_and_reread(grow_forest(scaled, trees, sample, seed), "forest")
    scores = write_and_reread(sample_scores(scaled, nodes, sizes).select("variable", "forest_score"), "scores")
    offsets = exact_quantile(scores, "variable", "forest_score", contamination)
    cutoffs = offsets.join(sizes, "variable").select(
        "variable", F.col("quantile").alias("offset"), F.lit(0.0).alias("threshold"), "sample_size"
    )
    return ForestModel(nodes, scaler, write_and_reread(cutoffs, "cutoffs"), version)


def score_forest(features: DataFrame, model: ForestModel) -> DataFrame:
    """Rows with features -> decision, ml_flag, ml_score, ml_confidence."""
    scaled = standardize(features, model.scaler)
    scored = sample_scores(scaled, model.nodes, model.cutoffs).join(model.cutoffs.drop("sample_size"), "variable")
    decision, threshold = F.col("decision"), F.col("threshold")
    return (
        scored.withColumn("decision", F.col("forest_score") - F.col("offset"))
        .withColumns(
            {
                "ml_flag": isolation_flag(decision, threshold),
                "ml_score": isolation_score(decision, threshold),
                "ml_confidence": isolation_confidence(decision),
                "ml_model": F.lit("isolation_forest"),
                "ml_model_version": F.lit(model.version),
            }
        )
        .drop("offset", "threshold", "forest_score", *Z)
    )


def forest_scorer(model: ForestModel):
    """Model tier for the merged job: rows with ``series`` gain the model columns."""

    def score(long: DataFrame) -> DataFrame:
        return score_forest(add_features(long, ddof=0), model)

    return score


def ml_verdicts(scored: DataFrame) -> DataFrame:
    """Stand-alone verdict rows of the model tier."""
    return scored.withColumns(
        {
            "verdict": F.when(F.col("ml_flag"), "anomalous").otherwise("valid"),
            "reason_code": F.lit("ML_ISOFOREST"),
            "fault_type": ml_fault(F.col("ml_flag"), F.col("delta_1")),
            "confidence": F.col("ml_confidence"),
        }
    )
