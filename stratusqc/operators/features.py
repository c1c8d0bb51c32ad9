"""Model inputs from readings: rolling features, sequences and their standardisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratusqc.constants import FEATURE_WINDOW, FEATURES, SEQUENCE_LENGTH
from stratusqc.functions.features import array_mean, feature_columns, last_of, padded_sequence
from stratusqc.functions.rules import finite
from stratusqc.operators.history import time_span, with_history

KEYS = ["station_id", "variable"]


def value_series(long: DataFrame, depth: int, span_seconds: int | None = None) -> DataFrame:
    """Present values only, each with ``series``: up to ``depth`` earlier ones, then itself."""
    present = long.filter(finite(F.col("value")))
    span: Column | None = time_span("ts", span_seconds) if span_seconds else None
    return with_history(present, KEYS, ["ts"], ["value"], depth, name="_h", span=span).withColumn(
        "series", F.transform("_h", lambda x: x["value"])
    ).drop("_h")


def add_features(df: DataFrame, window: int = FEATURE_WINDOW, ddof: int = 0) -> DataFrame:
    """Six model features of rows carrying ``series``. Serving uses ddof 0, training ddof 1."""
    return (
        df.withColumn("_recent", last_of(F.col("series"), window))
        .withColumn("_mean", array_mean(F.col("_recent")))
        .withColumns(
            feature_columns(
                F.col("series"), F.col("value"), F.col("ts"), F.col("_mean"), F.col("_recent"), ddof
            )
        )
        .drop("_recent", "_mean")
    )


def series_features(
    long: DataFrame, window: int = FEATURE_WINDOW, ddof: int = 1, span_seconds: int | None = None
) -> DataFrame:
    """Training features: rolling statistics over each station's present values."""
    return add_features(value_series(long, window - 1, span_seconds), window, ddof).drop("series")


def sequence_windows(
    long: DataFrame, length: int = SEQUENCE_LENGTH, padded: bool = False, span_seconds: int | None = None
) -> DataFrame:
    """Windows of ``length`` consecutive present values; short ones are dropped, or padded."""
    df = value_series(long, length - 1, span_seconds)
    if padded:
        return df.withColumn("window", padded_sequence(F.col("series"), length)).drop("series")
    return df.filter(F.size("series") == length).withColumnRenamed("series", "window")


def fit_scaler(features: DataFrame, columns=FEATURES) -> DataFrame:
    """Mean and population spread per variable: a table of one row per variable."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return features.groupBy("variable").agg(*aggs)


def standardize(features: DataFrame, fitted: DataFrame, columns=FEATURES) -> DataFrame:
    """Add ``<feature>_z``. A constant feature is only centred. ``fitted`` has one row per variable."""
    scaled = {
        f"{c}_z": (F.col(c) - F.col(f"{c}_mean"))
        / F.when(F.col(f"{c}_std") > 0, F.col(f"{c}_std")).otherwise(F.lit(1.0))
        for c in columns
    }
    return (
        features.join(fitted, "variable")
        .withColumns(scaled)
        .drop(*[f"{c}_{s}" for c in columns for s in ("mean", "std")])
    )


def attribution(scaled: DataFrame, columns=FEATURES) -> DataFrame:
    """Share of each feature in the total deviation, and the largest one's name."""
    total = sum((F.abs(F.col(f"{c}_z")) for c in columns), F.lit(0.0)) + F.lit(1e-6)
    shares = {f"{c}_share": F.bround(F.abs(F.col(f"{c}_z")) / total, 4) for c in columns}
    best = F.greatest(*[F.col(f"{c}_share") for c in columns])
    driver = F.coalesce(*[F.when(F.col(f"{c}_share") == best, F.lit(c)) for c in columns])
    return scaled.withColumns(shares).withColumn("primary_driver", driver)
