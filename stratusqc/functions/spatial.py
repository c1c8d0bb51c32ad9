"""Column expressions of the neighbour comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratusqc.constants import MIN_NEIGHBORS, SPATIAL_MIN_DELTA, SPATIAL_MIN_STD, SPATIAL_Z
from stratusqc.functions.rules import finite


def spatial_delta(value: Column, mean: Column) -> Column:
    return F.abs(value - mean)


def spatial_z(value: Column, mean: Column, std: Column, min_std: float = SPATIAL_MIN_STD) -> Column:
    """Distance from the neighbours' mean, in their spread; the spread has a floor."""
    return spatial_delta(value, mean) / F.greatest(std, F.lit(min_std))


def spatial_reason(
    value: Column,
    count: Column,
    mean: Column,
    std: Column,
    min_neighbors: int = MIN_NEIGHBORS,
    z_threshold: float = SPATIAL_Z,
    min_delta: float = SPATIAL_MIN_DELTA,
) -> Column:
    """Reason code of one value against its neighbours at the same instant."""
    apart = (spatial_z(value, mean, std) >= z_threshold) & (spatial_delta(value, mean) >= min_delta)
    return (
        F.when(~finite(value) | (F.coalesce(count, F.lit(0)) < min_neighbors), "SPATIAL_INSUFFICIENT_DATA")
        .when(apart, "SPATIAL_MISMATCH")
        .otherwise("SPATIAL_CONSISTENT")
    )


def spatial_confidence(reason: Column, has_neighbors: Column) -> Column:
    return (
        F.when(~has_neighbors, 0.50).when(reason == "SPATIAL_MISMATCH", 0.95).otherwise(0.90)
    )
