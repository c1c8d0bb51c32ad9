"""Column expressions turning a short series into model inputs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratusqc.constants import SEQUENCE_LENGTH


def last_of(series: Column, n: int) -> Column:
    """The newest ``n`` entries, or all of them if there are fewer."""
    return F.slice(series, -F.least(F.size(series), F.lit(n)), F.least(F.size(series), F.lit(n)))


def array_mean(series: Column) -> Column:
    total = F.aggregate(series, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(series) > 0, total / F.size(series))


def array_std(series: Column, mean: Column, ddof: int) -> Column:
    """Spread around ``mean``; 0 where it is undefined."""
    squares = F.aggregate(series, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(F.size(series) > ddof, F.sqrt(squares / (F.size(series) - ddof))).otherwise(F.lit(0.0))


def hour_angle(ts: Column) -> Column:
    hours = F.hour(ts) + F.minute(ts) / F.lit(60.0)
    return F.lit(2 * math.pi) * hours / F.lit(24.0)


def padded_sequence(series: Column, length: int = SEQUENCE_LENGTH) -> Column:
    """The newest ``length`` entries; a shorter series is filled up on the left with its oldest."""
    missing = F.greatest(F.lit(length) - F.size(series), F.lit(0))
    return F.concat(F.array_repeat(F.get(series, F.lit(0)), missing), last_of(series, length))


def feature_columns(
    series: Column, value: Column, ts: Column, mean: Column, recent: Column, ddof: int
) -> dict[str, Column]:
    size = F.size(series)
    return {
        "delta_1": F.when(size > 1, value - F.get(series, size - 2)).otherwise(F.lit(0.0)),
        "rolling_mean_diff": value - mean,
        "rolling_std": array_std(recent, mean, ddof),
        "hour_sin": F.sin(hour_angle(ts)),
        "hour_cos": F.cos(hour_angle(ts)),
    }


