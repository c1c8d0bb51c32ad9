"""From typed rows to accepted readings: station lookup, de-duplication, rejects and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratusqc.constants import VARIABLES
from stratusqc.functions.cleaning import clamp_percent, reject_reason

READING_KEY = ["station_id", "ts"]


def clamp_humidity(readings: DataFrame) -> DataFrame:
    return readings.withColumn("humidity", clamp_percent(F.col("humidity")))


def validate_readings(readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strict path: accepted rows, and refused rows with ``reason``."""
    marked = readings.withColumn(
        "reason", reject_reason(F.col("humidity"), F.col("wind_direction"), F.col("ts"))
    )
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def _lookup(readings: DataFrame, stations: DataFrame, identifier: Column) -> DataFrame:
    """Match by code, then by id. One lookup table of both names, codes taking precedence."""
    codes = stations.select(F.col("station_code").alias("_name"), "station_id", F.lit(0).alias("_p"))
    ids = stations.select(F.col("station_id").cast("string").alias("_name"), "station_id", F.lit(1).alias("_p"))
    names = codes.unionByName(ids).groupBy("_name").agg(F.min_by("station_id", "_p").alias("station_id"))
    return readings.withColumn("_name", identifier).join(names, "_name", "left").drop("_name")


def resolve_station(readings: DataFrame, stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attach ``station_id`` for a code or id; rows naming no known station are returned apart."""
    found = _lookup(readings, stations, F.trim("station_code"))
    known = F.col("station_id").isNotNull()
    return found.filter(known), found.filter(~known).drop("station_id")


def resolve_with_default(
    readings: DataFrame, stations: DataFrame, default_code: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """File path: codes in any case; unnamed or unknown stations fall back to ``default_code``.

    Without a default they are rejected: assigning them to some station would corrupt its series.
    """
    upper = stations.withColumn("station_code", F.upper("station_code"))
    found = _lookup(readings, upper, F.upper(F.trim("station_code")))
    if default_code is None:
        return found.filter("station_id is not null"), found.filter("station_id is null").drop("station_id")
    default = upper.filter(F.col("station_code") == default_code.upper()).select("station_id").limit(1)
    filled = found.withColumn("station_id", F.coalesce("station_id", default.scalar()))
    return filled.filter("station_id is not null"), filled.filter("station_id is null").drop("station_id")


def new_only(batch: DataFrame, history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored yet."""
    return batch.join(history.select(*keys), list(keys), "left_anti")


def dedup_readings(
    batch: DataFrame, history: DataFrame | None, order: Sequence[str], keys: Sequence[str] = READING_KEY
) -> DataFrame:
    """First row per key, and only for keys not stored yet.

    ``min_by`` combines map-side, so many copies of one key never meet in one task.
    """
    rest = [c for c in batch.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    unique = batch.groupBy(*keys).agg(first.alias("_r")).select(*keys, "_r.*").select(*batch.columns)
    return new_only(unique, history, keys) if history is not None else unique


def members_only(df: DataFrame, ids: DataFrame, key: str = "station_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def ingest_summary(received: DataFrame, accepted: DataFrame, rolled_up: DataFrame) -> DataFrame:
    """One row: rows received and ingested, duplicates, anomalous readings, stations affected.

    The affected stations are counted here and listed by :func:`stations_affected`; a fleet-wide
    list does not belong into a single value.
    """
    a = received.agg(F.count(F.lit(1)).alias("received"))
    b = accepted.agg(F.count(F.lit(1)).alias("ingested"), F.count_distinct("station_id").alias("stations_affected"))
    c = rolled_up.agg(F.count_if(F.col("verdict") == "anomalous").alias("anomalies"))
    return a.select(
        "received",
        b.select("ingested").scalar().alias("ingested"),
        (F.col("received") - b.select("ingested").scalar()).alias("duplicates"),
        c.scalar().alias("anomalies"),
        b.select("stations_affected").scalar().alias("stations_affected"),
    )


def stations_affected(accepted: DataFrame) -> DataFrame:
    return accepted.select("station_id").distinct()


def ingest_preview(
    batch: DataFrame, accepted: DataFrame, rolled_up: DataFrame, row_number: str, n: int = 15
) -> DataFrame:
    """First rows of a file with their verdict, or ``duplicate_skipped``.

    The few rows are picked first; verdicts are then looked up for these only.
    """
    head = batch.orderBy(row_number).limit(n)
    kept = accepted.select(row_number, "reading_id").withColumn("_kept", F.lit(True))
    return (
        head.drop("reading_id")
        .join(kept, row_number, "left")
        .join(rolled_up, "reading_id", "left")
        .select(
            row_number,
            "station_id",
            "ts",
            F.when(F.col("_kept").isNull(), "duplicate_skipped")
            .otherwise(F.coalesce("verdict", F.lit("valid")))
            .alias("qc_verdict"),
            F.when(F.col("_kept").isNull(), "Already Ingested").otherwise(F.col("fault_type")).alias("fault_type"),
        )
    )


def upload_log(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Rows taken and skipped per ingested file of a file-based frame.

    Of rows with one ``key`` the first in ``order`` is taken, whichever file it is in; the others count as failed.
    """
    per_file = (
        df.select("*", F.col("_metadata.file_name").alias("filename"), F.col("_metadata.file_size").alias("file_size"))
        .groupBy("filename", *key)
        .agg(F.max("file_size").alias("file_size"), F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    )
    taken = per_file.groupBy(*key).agg(F.min_by("filename", F.struct("_first", "filename")).alias("_by"))
    won = (F.col("_by") == F.col("filename")).cast("bigint")
    return (
        per_file.join(taken, list(key))
        .groupBy("filename")
        .agg(
            F.max("file_size").alias("file_size"),
            F.sum(won).alias("records_processed"),
            F.sum(F.col("_n") - won).alias("records_failed"),
        )
        .withColumn("file_type", F.element_at(F.split("filename", r"\."), -1))
        .withColumn("status", F.lit("completed"))
    )


def missing_profile(readings: DataFrame, columns: Sequence[str] = VARIABLES) -> DataFrame:
    """One row per column: missing values, rows and distinct stations."""
    counts = readings.agg(
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns],
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("station_id").alias("stations"),
    )
    return counts.unpivot(["rows", "stations"], list(columns), "column_name", "missing")


def upsert_stations(current: DataFrame, *incoming: DataFrame) -> DataFrame:
    """Merge station lists by code. Earlier lists win; ``action`` is insert, update or keep."""
    fields = [c for c in current.columns if c != "station_code"]
    ranked = None
    for i, part in enumerate(incoming):
        part = part.select("station_code", *fields).withColumn("_p", F.lit(i))
        ranked = part if ranked is None else ranked.unionByName(part)
    first = Window.partitionBy("station_code").orderBy("_p", *[F.col(f) for f in fields])
    chosen = ranked.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r", "_p")
    new, old = chosen.alias("n"), current.alias("o")
    action = (
        F.when(F.col("o.station_code").isNull(), "insert").when(F.col("n.station_code").isNull(), "keep").otherwise("update")
    )
    take_new = F.col("n.station_code").isNotNull()
    return old.join(new, F.col("o.station_code") == F.col("n.station_code"), "full").select(
        F.coalesce("n.station_code", "o.station_code").alias("station_code"),
        *[F.when(take_new, F.col(f"n.{f}")).otherwise(F.col(f"o.{f}")).alias(f) for f in fields],
        action.alias("action"),
    )


def codes_missing(current: DataFrame, defaults: DataFrame) -> DataFrame:
    return defaults.join(current.select("station_code"), "station_code", "left_anti")
