"""Projections and reshapes of readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratusqc.constants import VARIABLES
from stratusqc.functions.geo import tile_x, tile_y
from stratusqc.functions.rules import spec_limits


def wide_to_long(readings: DataFrame, variables: Sequence[str] = VARIABLES) -> DataFrame:
    """One row per (reading, variable); missing values are kept as NULL."""
    ids = [c for c in readings.columns if c not in variables]
    return readings.unpivot(ids, list(variables), "variable", "value")


def readings_with_specs(long: DataFrame, stations: DataFrame) -> DataFrame:
    """Attach the limits that apply to each (station, variable)."""
    limits = spec_limits(F.col("sensor_specs"), F.col("variable"))
    return long.join(stations.select("station_id", "sensor_specs"), "station_id").select(
        *long.columns,
        limits["min"].alias("spec_min"),
        limits["max"].alias("spec_max"),
        limits["step_max"].alias("step_max"),
        limits["persistence_max"].alias("persistence_max"),
    )


def bounds_overlay(readings: DataFrame, stations: DataFrame, variable: str) -> DataFrame:
    """One variable over time with the bounds that apply at its station."""
    limits = spec_limits(F.col("sensor_specs"), F.lit(variable))
    return readings.join(stations.select("station_id", "sensor_specs"), "station_id").select(
        "station_id",
        "ts",
        F.lit(variable).alias("variable"),
        F.col(variable).alias("value"),
        limits["min"].alias("spec_min"),
        limits["max"].alias("spec_max"),
    )


def qc_overlay(readings: DataFrame, qc: DataFrame) -> DataFrame:
    """Attach ``qc_verdicts``: variable -> (verdict, reason, fault, confidence), the newest per variable.

    Repeated judgements are reduced first, so at most one entry per variable is collected.
    """
    judged = F.max_by(F.struct("verdict", "reason_code", "fault_type", "confidence"), "qc_id").alias("judged")
    newest = qc.groupBy("reading_id", "variable").agg(judged)
    entries = F.collect_list(F.struct("variable", "judged"))
    maps = newest.groupBy("reading_id").agg(F.map_from_entries(entries).alias("qc_verdicts"))
    return readings.join(maps, "reading_id", "left")


def flagged_points(qc: DataFrame) -> DataFrame:
    return qc.filter(F.col("verdict").isin("anomalous", "suspect"))


def observations_view(readings: DataFrame) -> DataFrame:
    return readings.select(
        F.col("reading_id").alias("id"),
        "station_id",
        F.col("ts").alias("observed_at"),
        "temperature",
        "pressure",
        "humidity",
        F.col("ingest_source").alias("source"),
    )


def anomalies_view(qc: DataFrame) -> DataFrame:
    """Verdict rows under their published names; severity follows confidence alone."""
    severity = (
        F.when(F.col("confidence") >= 0.85, "critical").when(F.col("confidence") >= 0.70, "high").otherwise("medium")
    )
    return qc.select(
        F.col("qc_id").alias("id"),
        "station_id",
        F.col("reading_id").alias("observation_id"),
        F.col("fault_type").alias("anomaly_type"),
        severity.alias("severity"),
        "confidence",
        F.col("confidence").alias("score"),
        F.col("verdict").alias("status"),
        F.col("created_at").alias("detected_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )


def maintenance_tasks_view(tasks: DataFrame) -> DataFrame:
    return tasks.select(
        F.col("task_id").alias("id"), "station_code", "title", "priority", "status", "due_date", "created_at"
    )


def tile_assign(df: DataFrame, zoom: int) -> DataFrame:
    """Map tile of each row's latitude and longitude."""
    return df.withColumns({"tile_x": tile_x(F.col("longitude"), zoom), "tile_y": tile_y(F.col("latitude"), zoom)})


def tile_range(min_lat: float, min_lon: float, max_lat: float, max_lon: float, zoom: int) -> dict[str, Column]:
    """First and last tile of a box, as constant columns."""
    west, east = tile_x(F.lit(min_lon), zoom), tile_x(F.lit(max_lon), zoom)
    south, north = tile_y(F.lit(min_lat), zoom), tile_y(F.lit(max_lat), zoom)
    return {
        "x_first": F.least(west, east),
        "x_last": F.greatest(west, east),
        "y_first": F.least(south, north),
        "y_last": F.greatest(south, north),
    }


def bbox_filter(df: DataFrame, min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> DataFrame:
    return df.filter(F.col("latitude").between(min_lat, max_lat) & F.col("longitude").between(min_lon, max_lon))
