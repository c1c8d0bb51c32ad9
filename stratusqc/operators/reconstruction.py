"""Sequence model: windows of values are projected on their main components and rebuilt.

A linear autoencoder. What the components cannot express is the reconstruction error; frozen
and drifting sensors deform the window and raise it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratusqc.constants import SEQUENCE_LENGTH
from stratusqc.functions.features import padded_sequence
from stratusqc.functions.rules import finite
from stratusqc.functions.scoring import reconstruction_confidence, reconstruction_score
from stratusqc.operators.features import sequence_windows
from stratusqc.operators.quantiles import error_threshold
from stratusqc.session import write_and_reread


@dataclass(frozen=True)
class ReconstructionModel:
    """``fitted``: variable, value_mean, value_std, center, components, threshold, error_mean, error_std."""

    fitted: DataFrame
    length: int = SEQUENCE_LENGTH
    version: str = "v1.0.0-seq"


def _scaled_window(window: Column) -> Column:
    std = F.when(F.col("value_std") > 0, F.col("value_std")).otherwise(F.lit(1.0))
    return F.transform(window, lambda x: (x - F.col("value_mean")) / std)


def reconstruction_error(window: Column, center: Column, components: Column, length: int) -> Column:
    """Mean squared residual. The components are orthonormal, so only their lengths are subtracted."""
    centered = F.zip_with(window, center, lambda x, m: x - m)
    total = F.aggregate(centered, F.lit(0.0), lambda a, x: a + x * x)
    dot = lambda comp: F.aggregate(F.zip_with(centered, comp, lambda x, c: x * c), F.lit(0.0), lambda a, x: a + x)
    kept = F.aggregate(F.transform(components, dot), F.lit(0.0), lambda a, p: a + p * p)
    return F.greatest(total - kept, F.lit(0.0)) / F.lit(float(length))


def window_moments(windows: DataFrame, length: int) -> DataFrame:
    """Means and pairwise products of window positions per variable, in one combinable aggregation."""
    w = [F.get("window", F.lit(i)) for i in range(length)]
    means = F.array(*[F.avg(x) for x in w]).alias("center")
    cov = F.array(*[F.covar_pop(w[i], w[j]) for i in range(length) for j in range(i, length)]).alias("cov")
    return windows.groupBy("variable").agg(means, cov, F.count(F.lit(1)).alias("n_windows"))


def fit_reconstruction(
    long: DataFrame, k: int = 3, length: int = SEQUENCE_LENGTH, span_seconds: int | None = None, version: str = "v1.0.0-seq"
) -> ReconstructionModel:
    """Fit per variable. Needs three windows' worth of values, as one length per station counts."""
    spark = long.sparkSession
    present = long.filter(finite(F.col("value")))
    scaler = present.groupBy("variable").agg(
        F.avg("value").alias("value_mean"), F.stddev_pop("value").alias("value_std"), F.count(F.lit(1)).alias("n")
    )
    scaler = write_and_reread(scaler.filter(F.col("n") >= 3 * length).drop("n"), "seq-scaler")
    windows = sequence_windows(present, length, span_seconds=span_seconds).join(scaler, "variable")
    windows = windows.withColumn("window", _scaled_window(F.col("window"))).select("variable", "window")
    windows = write_and_reread(windows, "seq-windows")  # read for the components and for the errors
    upper = np.triu_indices(length)
    rows = []
    # One row per variable: the model itself, of fixed size.
    for r in window_moments(windows, length).collect():
        cov = np.zeros((length, length))
        cov[upper] = r["cov"]
        cov = cov + cov.T - np.diag(cov.diagonal())
        _, vectors = np.linalg.eigh(cov)
        components = vectors[:, ::-1][:, :k].T
        rows.append((r["variable"], [float(x) for x in r["center"]], [[float(x) for x in c] for c in components]))
    basis = spark.createDataFrame(rows, "variable string, center array<double>, components array<array<double>>")
    errors = windows.join(basis, "variable").select(
        "variable", reconstruction_error(F.col("window"), F.col("center"), F.col("components"), length).alias("error")
    )
    cutoffs = error_threshold(write_and_reread(errors, "errors")).select(
        "variable", "threshold", F.col("mean").alias("error_mean"), F.col("std").alias("error_std")
    )
    fitted = scaler.join(basis, "variable").join(cutoffs, "variable")
    return ReconstructionModel(write_and_reread(fitted, "reconstruction"), length, version)


def score_reconstruction(rows: DataFrame, model: ReconstructionModel) -> DataFrame:
    """Rows with a full or padded ``window`` -> error, ml_flag, ml_score, ml_confidence."""
    joined = rows.join(model.fitted, "variable").withColumn("_w", _scaled_window(F.col("window")))
    error, threshold = F.col("error"), F.col("threshold")
    return (
        joined.withColumn(
            "error", reconstruction_error(F.col("_w"), F.col("center"), F.col("components"), model.length)
        )
        .withColumns(
            {
                "ml_flag": error > threshold,
                "ml_score": reconstruction_score(error, threshold),
                "ml_confidence": reconstruction_confidence(error, threshold),
                "ml_model": F.lit("reconstruction"),
                "ml_model_version": F.lit(model.version),
            }
        )
        .drop("_w", *[c for c in model.fitted.columns if c not in ("variable", "threshold")])
    )


def reconstruction_scorer(model: ReconstructionModel):
    """Model tier for the merged job; brings no rolling features, as the sequence model has none."""

    def score(long: DataFrame) -> DataFrame:
        rows = long.withColumn("window", padded_sequence(F.col("series"), model.length))
        return (
            score_reconstruction(rows, model)
            .drop("threshold", "window")
            .withColumns({c: F.lit(None).cast("double") for c in ("delta_1", "rolling_mean_diff")})
        )

    return score
