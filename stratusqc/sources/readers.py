"""Reading station files, and bringing provider layouts into the reading schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratusqc.constants import COLUMN_ALIASES, DAILY_FIELDS, PROVIDER_COLUMNS, SERIES_DECIMALS, VARIABLES
from stratusqc.functions.cleaning import first_meaningful, lenient_double, lenient_timestamp
from stratusqc.sources.json_arrays import read_json_objects


def csv_headers(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """Files by their header line.

    Only the first line of each file is kept, by a minimum per task; the driver gets one row per file, as it
    does when Spark lists them.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    first = lines.filter("file_block_start = 0").withColumn("at", F.monotonically_increasing_id())
    first = first.groupBy("file_path").agg(F.min_by("value", "at").alias("header"))
    files: dict[str, list[str]] = {}
    for row in first.groupBy("header").agg(F.collect_list("file_path").alias("files")).collect():
        files[row["header"].lstrip("\ufeff").rstrip("\r")] = sorted(row["files"])
    return files


def read_readings_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV files with a header, every field as text, read by each file's own header.

    Files may order their columns differently or lack some; those are NULL. Order of rows is left to the consumer.
    """
    frames = []
    for files in csv_headers(spark, path).values():
        df = spark.read.option("header", True).option("enforceSchema", False).csv(files)
        names = {c.strip().lower() for c in df.columns}
        for field in ("station_code", "timestamp"):
            if not names.intersection(COLUMN_ALIASES[field]):
                raise ValueError(f"CSV has no column for {field}: {sorted(names)}")
        frames.append(df)
    if not frames:
        raise ValueError(f"no CSV file with a header in {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_readings_json(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """JSON files as a ``fields`` map per reading.

    A file is an array of objects or an object with a ``readings`` array, read by as many tasks as it has splits; one
    that isn't JSON is an error. With ``lines=True`` every line is one object, and lines that are none are left out.
    """
    if lines:
        text = spark.read.text(path)
        return text.select(F.from_json("value", "map<string,string>").alias("fields")).filter("fields is not null")
    objects = read_json_objects(spark, path)
    return objects.select(F.from_json("text", "map<string,string>", {"mode": "FAILFAST"}).alias("fields"))


def _harmonized(field_of) -> list[Column]:
    """Text columns of the canonical schema; ``field_of`` maps an accepted name to a column or None."""
    out = []
    for field, aliases in COLUMN_ALIASES.items():
        found = [c for c in (field_of(a) for a in aliases) if c is not None]
        out.append((first_meaningful(*found) if found else F.lit(None).cast("string")).alias(field))
    return out


def harmonize_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Headers trimmed and lower-cased; per field the first meaningful accepted column."""
    by_name = {c.strip().lower(): F.col(f"`{c}`").cast("string") for c in df.columns if c not in keep}
    return df.select(*keep, *_harmonized(by_name.get))


def harmonize_map(df: DataFrame, column: str = "fields", keep: tuple[str, ...] = ()) -> DataFrame:
    """As :func:`harmonize_columns` for rows that carry their fields in a map."""
    lowered = df.withColumn(column, F.transform_keys(column, lambda k, _: F.lower(F.trim(k))))
    return lowered.select(*keep, *_harmonized(lambda a: F.try_element_at(F.col(column), F.lit(a))))


def typed_readings(harmonized: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Text fields to timestamps and numbers; what cannot be parsed becomes NULL."""
    return harmonized.select(
        *keep,
        "station_code",
        lenient_timestamp(F.col("timestamp")).alias("ts"),
        *[lenient_double(F.col(v)).alias(v) for v in VARIABLES],
    )


def normalize_hourly_feed(df: DataFrame, station_code: Column, source_timezone: str = "UTC") -> DataFrame:
    """Provider columns to the reading schema: wind from km/h to m/s, time to UTC, absent columns NULL."""

    def column(v: str) -> Column:
        source = PROVIDER_COLUMNS[v]
        if source not in df.columns:
            return F.lit(None).cast("double").alias(v)
        value = F.col(source).cast("double")
        return (value / 3.6 if v == "wind_speed" else value).alias(v)

    return df.select(
        station_code.alias("station_code"),
        F.to_utc_timestamp("time", source_timezone).alias("ts"),
        *[column(v) for v in VARIABLES],
        F.lit("historical").alias("ingest_source"),
    )


def _zipped(df: DataFrame, keep: list[str], time: str, fields: list[str]) -> DataFrame:
    """Parallel arrays plus (start, end, step seconds) to one row per step; the end is excluded."""
    steps = F.floor((F.unix_seconds("end") - F.unix_seconds("start")) / F.col("step")).cast("int")
    instants = F.transform(
        F.sequence(F.lit(0), steps - 1), lambda i: F.timestamp_seconds(F.unix_seconds("start") + i * F.col("step"))
    )
    zipped = F.arrays_zip(instants.alias(time), *[F.col(f) for f in fields])
    return df.filter(steps > 0).select(*keep, F.inline(zipped)).toDF(*keep, time, *fields)


def zip_series_to_rows(df: DataFrame) -> DataFrame:
    """Hourly archive arrays to readings, rounded per variable."""
    rows = _zipped(df, ["station_id"], "ts", list(VARIABLES))
    return rows.select(
        "station_id", "ts", *[F.bround(F.col(v).cast("double"), SERIES_DECIMALS[v]).alias(v) for v in VARIABLES]
    )


def daily_series_to_rows(df: DataFrame) -> DataFrame:
    """Daily archive arrays to one row per day."""
    rows = _zipped(df, ["station_id"], "ts", list(DAILY_FIELDS))
    return rows.select("station_id", F.to_date("ts").alias("date"), *DAILY_FIELDS)


def union_frames(*frames: DataFrame) -> DataFrame:
    """Stack frames by column name; columns a frame lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
