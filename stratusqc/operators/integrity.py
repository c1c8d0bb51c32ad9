"""Integrity checks a table store would enforce, as queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratusqc.operators.history import WEEK_SECONDS, earlier, time_span, with_history


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of copies."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose foreign key points nowhere; NULL keys do not count."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.filter(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def outside_domain(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


def without_stations(
    removed: DataFrame, readings: DataFrame, qc: DataFrame, alerts: DataFrame, feedback: DataFrame
) -> dict[str, DataFrame]:
    """What is left after stations are deleted with everything that hangs on them."""
    gone = removed.select("station_id")
    left = {
        name: df.join(gone, "station_id", "left_anti")
        for name, df in (("readings", readings), ("qc", qc), ("alerts", alerts))
    }
    lost = qc.join(gone, "station_id", "left_semi").select(F.col("qc_id").alias("qc_result_id"))
    left["feedback"] = feedback.join(lost, "qc_result_id", "left_anti")
    return left


def dropout_gaps(readings: DataFrame, factor: float = 2.0, interval_seconds: int = 86400) -> DataFrame:
    """Silences longer than ``factor`` reporting intervals: station, last seen, seen again."""
    df = with_history(
        readings.select("station_id", "ts"), ["station_id"], ["ts"], ["ts"], 1, span=time_span("ts", WEEK_SECONDS)
    )
    return (
        df.select("station_id", earlier("history", "ts").alias("gap_start"), F.col("ts").alias("gap_end"))
        .filter(F.col("gap_start").isNotNull())
        .withColumn("gap_seconds", F.unix_seconds("gap_end") - F.unix_seconds("gap_start"))
        .filter(F.col("gap_seconds") > factor * interval_seconds)
    )
