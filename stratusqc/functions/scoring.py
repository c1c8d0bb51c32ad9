"""Column expressions turning raw model outputs into flag, score and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def isolation_flag(decision: Column, threshold: Column) -> Column:
    return decision < threshold


def isolation_score(decision: Column, threshold: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(10.0) * (decision - threshold)))


def _two_places(confidence: Column) -> Column:
    """Kept within [0.5, 0.99]; representation noise is cut off before it can decide a tie."""
    return F.bround(F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.5), confidence)), 9), 2)


def isolation_confidence(decision: Column) -> Column:
    return _two_places(F.lit(0.5) + F.abs(decision))


def error_ratio(error: Column, threshold: Column) -> Column:
    return error / (threshold + F.lit(1e-6))


def reconstruction_score(error: Column, threshold: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-5.0) * (error_ratio(error, threshold) - F.lit(1.0))))


def reconstruction_confidence(error: Column, threshold: Column) -> Column:
    ratio = F.least(F.lit(1.0), error_ratio(error, threshold))
    return _two_places(F.lit(0.5) + F.lit(0.49) * ratio)


def ml_fault(flag: Column, delta_1: Column) -> Column:
    """Fault of a stand-alone model verdict: a jump is a spike, anything else drift."""
    return F.when(flag & (F.abs(delta_1) > 5.0), "spike").when(flag, "drift")
