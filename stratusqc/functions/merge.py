"""Column expressions of the merge layer: one verdict from rule, model and neighbour signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratusqc.constants import MIN_NEIGHBORS


def _row(verdict: str, fault: Column | str | None, reason: Column | str, confidence: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(verdict).alias("verdict"),
        as_col(fault).cast("string").alias("fault_type"),
        as_col(reason).alias("reason_code"),
        as_col(confidence).cast("double").alias("confidence"),
    )


def merged_verdict(
    rule_reason: Column,
    ml_flag: Column,
    ml_score: Column,
    ml_confidence: Column,
    ml_model: Column,
    delta_1: Column,
    spatial_reason: Column,
) -> Column:
    """Decision table, first matching row wins."""
    consistent = F.coalesce(spatial_reason == "SPATIAL_CONSISTENT", F.lit(False))
    mismatch = F.coalesce(spatial_reason == "SPATIAL_MISMATCH", F.lit(False))
    flagged = F.coalesce(ml_flag, F.lit(False))
    jump = F.abs(F.coalesce(delta_1, F.lit(0.0)))
    model_code = F.when(ml_model == "reconstruction", "ML_LSTM_AE").otherwise("ML_ISOFOREST")
    return (
        F.when(rule_reason == "RULE_RANGE_FAIL", _row("anomalous", "spike", "RULE_RANGE", 0.99))
        .when(rule_reason == "RULE_PERSISTENCE_FAIL", _row("anomalous", "flatline", "RULE_FLATLINE", 0.98))
        .when(
            (rule_reason == "RULE_STEP_FAIL") & consistent,
            _row("valid", "plausible_extreme", "SPATIAL_OVERRIDE_EXTREME", 0.88),
        )
        .when(rule_reason == "RULE_STEP_FAIL", _row("anomalous", "spike", "RULE_STEP", 0.95))
        .when(
            flagged & mismatch,
            _row(
                "anomalous",
                F.when(jump < 4.0, "drift").otherwise("spike"),
                "ML_AND_SPATIAL_CONFIRMED",
                F.least(F.lit(0.98), F.greatest(ml_confidence, F.lit(0.88))),
            ),
        )
        .when(flagged & consistent, _row("valid", "plausible_extreme", "SPATIAL_VALIDATED_EXTREME", 0.92))
        .when(flagged & (ml_score >= 0.75), _row("anomalous", "drift", model_code, ml_confidence))
        .when(flagged, _row("suspect", "drift", "ML_BORDERLINE", 0.65))
        .when(mismatch, _row("anomalous", "spatial_inconsistency", "SPATIAL_MISMATCH", 0.92))
        .when((ml_score >= 0.55) & consistent, _row("valid", None, "VALID_READING", 0.95))
        .when(ml_score >= 0.55, _row("suspect", None, "ML_SUSPECT", 0.60))
        .otherwise(_row("valid", None, "VALID_READING", 1.0))
    )


def imputed(
    value: Column,
    neighbor_count: Column,
    neighbor_mean: Column,
    rolling_mean_diff: Column,
    min_neighbors: int = MIN_NEIGHBORS,
) -> Column:
    """Corrected value with its method: neighbour mean first, own rolling mean second.

    Means are cut to six places before the half-even rounding, so that the order in
    which a distributed sum was formed cannot decide a tie.
    """
    by_neighbors = F.coalesce(neighbor_count, F.lit(0)) >= min_neighbors
    by_history = value.isNotNull() & rolling_mean_diff.isNotNull()
    return F.struct(
        F.when(by_neighbors, F.bround(F.round(neighbor_mean, 6), 2))
        .when(by_history, F.bround(F.round(value - rolling_mean_diff, 6), 2))
        .alias("corrected_value"),
        F.when(by_neighbors, "spatial_kdtree_neighbors")
        .when(by_history, "temporal_rolling_baseline")
        .alias("method"),
        F.when(by_neighbors, 0.94).when(by_history, 0.82).alias("confidence"),
    )


def verdict_rank(verdict: Column) -> Column:
    return F.when(verdict == "anomalous", 2).when(verdict == "suspect", 1).otherwise(0)
