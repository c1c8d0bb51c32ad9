"""Structured Streaming versions of ingest, rules, neighbour comparison and alerting."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from stratusqc.constants import HISTORY_DEPTH, VARIABLES
from stratusqc.functions.cleaning import reject_reason
from stratusqc.functions.rules import could_be_flat, finite, rule_outcome
from stratusqc.operators.qc import apply_rules
from stratusqc.operators.spatial import spatial_check
from stratusqc.session import scratch_dir
from stratusqc.sources.ingest import clamp_humidity
from stratusqc.sources.readers import harmonize_columns, typed_readings
from stratusqc.streaming.state import RecentReadings, Silence, SlidingWindows, StandingAlert

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
COUNT_ROWS = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(minutes: float) -> int:
    return int(minutes * 60_000_000)


def file_stream(
    spark: SparkSession, path: str, schema, pattern: str = "*", fmt: str = "parquet", max_files: int = 100
) -> DataFrame:
    """Files of one folder as a stream; ``max_files`` bounds a micro-batch.

    A CSV file whose header differs from ``schema`` stops the stream: a stream has one schema, and mapping
    columns by position would swap their values without a word.
    """
    return (
        spark.readStream.format(fmt)
        .schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", max_files)
        .option("header", True)
        .option("enforceSchema", False)
        .load(path)
    )


def stream_ingest(raw: DataFrame, stations: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Raw text rows to readings: harmonised, typed, clamped, station attached.

    ``reject_reason`` is NULL for accepted rows, so one stream feeds both tables.
    """
    typed = clamp_humidity(typed_readings(harmonize_columns(raw, tuple(keep)), tuple(keep)))
    codes = stations.select(F.upper("station_code").alias("_code"), "station_id")
    return (
        typed.withColumn("_code", F.upper(F.trim("station_code")))
        .join(codes, "_code", "left")
        .drop("_code")
        .withColumn(
            "reject_reason",
            F.coalesce(
                reject_reason(F.col("humidity"), F.col("wind_direction"), F.col("ts")),
                F.when(F.col("station_id").isNull(), "unknown_station"),
            ),
        )
    )


def stream_dedup(readings: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One reading per (station, instant); keys are forgotten once the watermark has passed them."""
    return readings.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["station_id", "ts"])


def stream_history(
    readings: DataFrame, variables: Sequence[str] = VARIABLES, depth: int = HISTORY_DEPTH, delay_minutes: float = 60
) -> DataFrame:
    """Readings with ``late`` and, per variable, ``<variable>_past``: the values before it."""
    columns = list(variables)
    station = readings.schema["station_id"].dataType.simpleString()
    fields = ", ".join(f"{c} double, {c}_past array<double>" for c in columns)
    return (
        readings.select("reading_id", "station_id", F.unix_micros("ts").alias("at"), *columns)
        .groupBy("station_id")
        .transformWithStateInPandas(
            statefulProcessor=RecentReadings(columns, depth, _micros(delay_minutes)),
            outputStructType=f"reading_id bigint, station_id {station}, at bigint, late boolean, {fields}",
            outputMode="Append",
            timeMode="None",
        )
    )


def stream_rules(
    readings: DataFrame,
    stations: DataFrame,
    variables: Sequence[str] = VARIABLES,
    depth: int = HISTORY_DEPTH,
    delay_minutes: float = 60,
) -> DataFrame:
    """Rule verdicts of a stream, by the same column expressions as in batch.

    Late readings come out with ``late`` set and no verdict, for the reject table.
    """
    seen = stream_history(readings, variables, depth, delay_minutes)
    structs = []
    for v in variables:
        past, value = F.col(f"{v}_past"), F.col(v)
        previous = F.get(past, F.size(past) - 1)
        recent = F.concat(past, F.array(value))
        structs.append(
            F.struct(
                F.lit(v).alias("variable"),
                value.alias("value"),
                previous.alias("previous"),
                F.when(could_be_flat(value, previous), recent).alias("recent"),
            )
        )
    long = (
        seen.join(stations.select("station_id", "sensor_specs"), "station_id")
        .select("reading_id", "station_id", F.timestamp_micros("at").alias("ts"), "late", "sensor_specs",
                F.inline(F.array(*structs)))
    )
    ruled = apply_rules(long)
    outcome = rule_outcome(F.col("violation"), F.col("step_fail"), F.col("flat_fail"))
    return ruled.withColumn("_o", F.when(~F.col("late"), outcome)).select(
        "reading_id", "station_id", "ts", "late", "variable", "value", "_o.*"
    )


def stream_spatial(long: DataFrame, edges: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each value against its neighbours at the same instant, once the watermark closes the instant.

    A value is sent to its own station and to those it is a neighbour of; one stateful
    aggregation then holds both sides, so no stream is joined with another.
    """
    present = long.filter(finite(F.col("value"))).withWatermark("ts", delay)
    own = edges.select("station_id").distinct().select(
        F.col("station_id").alias("_from"), F.col("station_id").alias("_to")
    )
    routes = own.unionByName(edges.select(F.col("neighbor_id").alias("_from"), F.col("station_id").alias("_to")))
    sent = present.join(routes, present["station_id"] == routes["_from"])
    mine, other = F.col("_from") == F.col("_to"), F.col("_from") != F.col("_to")
    value = F.col("value")
    stats = sent.groupBy("ts", F.col("_to").alias("station_id"), "variable").agg(
        F.max(F.when(mine, value)).alias("value"),
        F.count(F.when(other, value)).alias("n"),
        F.avg(F.when(other, value)).alias("mean"),
        F.stddev_pop(F.when(other, value)).alias("std"),
    )
    return spatial_check(stats.filter(F.col("value").isNotNull()))


def stream_debounce(candidates: DataFrame, cooldown_minutes: float = 60, delay: str = "1 hour") -> DataFrame:
    """Candidates with the alert they raise (``opened``) or fold into, once the watermark has passed them."""
    station = candidates.schema["station_id"].dataType.simpleString()
    return (
        candidates.withWatermark("created_at", delay)
        .withColumn("at", F.unix_micros("created_at"))
        .groupBy("station_id", "variable")
        .transformWithStateInPandas(
            statefulProcessor=StandingAlert(_micros(cooldown_minutes)),
            outputStructType=(
                f"station_id {station}, variable string, alert_id bigint, alert_at bigint, qc_id bigint, "
                "at bigint, severity string, opened boolean"
            ),
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def stream_alerts(assigned: DataFrame) -> DataFrame:
    """The alerts to announce: one row when an alert opens."""
    return assigned.filter("opened").select(
        "alert_id", "station_id", "variable", "severity", F.timestamp_micros("alert_at").alias("created_at")
    )


def _moved(alerts: DataFrame, moves: DataFrame, on: str, at: str, horizon: str, delay: str) -> DataFrame:
    """Every alert with the moves on it within ``horizon`` of its creation, also without any; ``at`` in microseconds.

    Both sides have a watermark, so an alert is held until no move on it can come any more and is then let go.
    """
    held = alerts.withWatermark("created_at", delay)
    later = moves.withColumnRenamed(on, "_on").withColumnRenamed(at, "_at").withWatermark("_at", delay)
    in_time = (F.col("_at") >= F.col("created_at")) & (F.col("_at") <= F.col("created_at") + F.expr(f"interval {horizon}"))
    return held.join(later, (F.col(on) == F.col("_on")) & in_time, "left").withColumn(at, F.unix_micros("_at")).drop("_on", "_at")


def stream_status(alerts: DataFrame, events: DataFrame, horizon: str = "30 days", delay: str = "1 hour") -> DataFrame:
    """Alerts after the status changes of ``horizon``: the newest wins, resolving stamps resolved_at.

    As :func:`stratusqc.operators.alerts.apply_status`; ``events``: alert_id, new_status, event_ts. A change before its
    alert or after the horizon does not count.
    """
    keep = [c for c in alerts.columns if c not in ("status", "resolved_at")]
    moved = _moved(alerts, events, "alert_id", "event_ts", horizon, delay)
    after = moved.groupBy(*keep, "status", "resolved_at").agg(
        F.max_by("new_status", "event_ts").alias("_status"),
        F.max(F.when(F.col("new_status") == "resolved", F.col("event_ts"))).alias("_resolved"),
    )
    return after.select(
        *keep, F.coalesce("_status", "status").alias("status"),
        F.coalesce(F.timestamp_micros("_resolved"), "resolved_at").alias("resolved_at"),
    )


def stream_feedback(alerts: DataFrame, feedback: DataFrame, horizon: str = "30 days", delay: str = "1 hour") -> DataFrame:
    """Alerts after the feedback of ``horizon``: confirmed faults acknowledge open ones, false alarms resolve any.

    As :func:`stratusqc.operators.alerts.apply_feedback`; ``feedback``: qc_result_id, label, given_at.
    """
    keep = [c for c in alerts.columns if c not in ("status", "resolved_at")]
    moved = _moved(alerts, feedback, "qc_result_id", "given_at", horizon, delay)
    after = moved.groupBy(*keep, "status", "resolved_at").agg(
        F.max(F.when(F.col("label") == "false_alarm", F.col("given_at"))).alias("_cleared"),
        F.count_if(F.col("label") == "confirmed_fault").alias("_confirmed"),
    )
    status = (
        F.when(F.col("_cleared").isNotNull(), "resolved")
        .when((F.col("status") == "open") & (F.col("_confirmed") > 0), "acknowledged")
        .otherwise(F.col("status"))
    )
    return after.select(
        *keep, status.alias("status"), F.coalesce(F.timestamp_micros("_cleared"), "resolved_at").alias("resolved_at")
    )


def stream_open_alerts(
    candidates: DataFrame, alerts: DataFrame, cooldown_minutes: int = 60, delay: str = "1 hour"
) -> DataFrame:
    """Candidates with the earliest open alert of their station and variable raised within the cooldown before.

    As :func:`stratusqc.operators.alerts.open_alert_within_cooldown`. A candidate meets the open alerts of one key
    within one cooldown: one or two where alerts come from the fold, which keeps them a cooldown apart.
    """
    key = ["station_id", "variable"]
    opened = alerts.filter(F.col("status") == "open").select(
        F.col("station_id").alias("_station"), F.col("variable").alias("_variable"), "alert_id", F.col("created_at").alias("_opened")
    )
    asking = candidates.select(*key, "qc_id", "created_at").withWatermark("created_at", delay)
    back = F.col("created_at") - F.expr(f"interval {cooldown_minutes} minutes")
    near = (F.col("_opened") >= back) & (F.col("_opened") <= F.col("created_at"))
    same = (F.col("station_id") == F.col("_station")) & (F.col("variable") == F.col("_variable"))
    met = asking.join(opened.withWatermark("_opened", delay), same & near).withColumn("_at", F.unix_micros("_opened")).drop("_opened")
    return met.groupBy("qc_id", "created_at").agg(F.min_by("alert_id", F.struct("_at", "alert_id")).alias("alert_id"))


def _interval_micros(spark: SparkSession, interval: str) -> int:
    return spark.sql(f"SELECT unix_micros(timestamp_micros(0) + interval {interval}) AS n").first()["n"]


def _floor_div(column: str, by: int):
    return F.expr(f"({column} - pmod({column}, {by})) div {by}")


def stream_window_stats(
    long: DataFrame, length: str = "10 hours", slide: str = "1 hour", delay: str = "1 hour", buckets: int = 256
) -> DataFrame:
    """Sliding minimum, maximum and mean of double values per station and variable.

    A value lies in ``length / slide`` windows. Spark's own windows keep and shuffle it once for each of them; here it is
    kept once, in the pane between two moves of the window, and spread over windows as they come out. Series are dealt
    into ``buckets`` slice by slice of time, so no station fills a task with all of its rows.
    """
    columns = ["start", "end", "station_id", "variable", "n", "min", "max", "mean"]
    marked = long.withWatermark("ts", delay)
    if not long.isStreaming:
        stats = [F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean")]
        found = marked.groupBy(F.window("ts", length, slide), "station_id", "variable").agg(*stats)
        return found.select("window.start", "window.end", *columns[2:])
    spark, kinds = long.sparkSession, long.schema
    whole, step = _interval_micros(spark, length), _interval_micros(spark, slide)
    if not 0 < step <= whole:
        raise ValueError(f"windows of {length} can't move by {slide}")
    pane = math.gcd(whole, step)
    per_slice = 3 * -(-whole // step)
    rows = (
        # The times themselves are left out: Spark would drop late rows whose windows are open yet.
        marked.filter(F.col("ts").isNotNull())
        .select("station_id", "variable", "value", F.unix_micros("ts").alias("_at"))
        .withColumn("pane", _floor_div("_at", pane))
        .withColumn("_last", _floor_div("pane", step // pane))
        .withColumn("_first", F.col("pane") - whole // pane + step // pane)
        .withColumn("_first", _floor_div("_first", step // pane))
        .withColumn("slice", F.explode(F.sequence(_floor_div("_first", per_slice), _floor_div("_last", per_slice))))
        .select(
            F.pmod(F.xxhash64("station_id", "variable", "slice"), F.lit(buckets)).alias("bucket"),
            "slice", "pane", F.col("station_id").cast("string").alias("station"), F.col("variable").cast("string").alias("variable"),
            F.col("value").isNotNull().cast("long").alias("n"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"),
        )
    )
    closed = rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=SlidingWindows(whole, step, pane, per_slice),
        outputStructType="station string, variable string, first bigint, times bigint, n bigint, low double, high double, total double",
        outputMode="Append",
        timeMode="EventTime",
        initialState=spark.range(buckets).withColumnRenamed("id", "bucket").groupBy("bucket"),
    )
    # NaN comes back from pandas as NULL; without values there is none.
    told = {c: F.when(F.col("n") > 0, F.coalesce(c, F.lit(float("nan")))) for c in ("low", "high", "total")}
    first = F.col("first")
    return (
        closed.withColumns(told)
        .withColumn("_start", F.explode(F.transform(F.sequence(first, first + F.col("times") - 1), lambda k: k * step)))
        .select(
            F.timestamp_micros("_start").alias("start"),
            F.timestamp_micros(F.col("_start") + whole).alias("end"),
            F.col("station").cast(kinds["station_id"].dataType).alias("station_id"),
            F.col("variable").cast(kinds["variable"].dataType).alias("variable"),
            "n",
            F.col("low").cast(kinds["value"].dataType).alias("min"),
            F.col("high").cast(kinds["value"].dataType).alias("max"),
            F.try_divide("total", "n").alias("mean"),
        )
    )


def stream_dropout(readings: DataFrame, limit_minutes: float, delay: str = "1 hour") -> DataFrame:
    """Stations that fell silent for longer than the limit, measured in event time."""
    station = readings.schema["station_id"].dataType.simpleString()
    return (
        readings.withWatermark("ts", delay)
        .withColumn("at", F.unix_micros("ts"))
        .groupBy("station_id")
        .transformWithStateInPandas(
            statefulProcessor=Silence(_micros(limit_minutes)),
            outputStructType=f"station_id {station}, last_at bigint",
            outputMode="Append",
            timeMode="EventTime",
        )
    )


@dataclass(frozen=True)
class Drain:
    """A second source that moves the watermark past all rows once the first is used up."""

    folder: str
    schema: StructType
    time_column: str
    until: str
    filled: Mapping[str, object] = field(default_factory=dict)

    def write(self, spark: SparkSession) -> None:
        row = spark.range(1).select(
            *[
                F.lit(self.until if f.name == self.time_column else self.filled.get(f.name)).cast(f.dataType).alias(f.name)
                for f in self.schema.fields
            ]
        )
        row.write.mode("append").parquet(self.folder)


def with_drain(
    stream: DataFrame, time_column: str, label: str, until: str = "2200-01-01", filled: Mapping[str, object] | None = None
) -> tuple[DataFrame, Drain]:
    """The stream with a source for the row that ends it: all columns NULL but its time and those ``filled``.

    For runs over what is available: without it, rows within the delay of the last one would never come out.
    The row must reach the watermark: columns that are filtered or joined on need a value, as Spark filters first.
    Aggregations never emit it, since its own instant and windows end after the watermark it sets.
    """
    spark = stream.sparkSession
    drain = Drain(scratch_dir(spark, f"{label}-drain"), stream.schema, time_column, until, filled or {})
    spark.createDataFrame([], stream.schema).write.parquet(drain.folder)
    return stream.unionByName(file_stream(spark, drain.folder, stream.schema)), drain


def _drained(spark: SparkSession, path: str) -> bool:
    try:
        return len(spark.read.parquet(f"{path}/drained").schema) > 0
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def run_to_table(
    stream: DataFrame, label: str, path: str | None = None, drain: Drain | Sequence[Drain] | None = None
) -> DataFrame:
    """Process everything available into Parquet and return the table.

    With ``drain`` (one for each stream with a watermark) the run is taken up once more with the rows that end it. Their
    times leave no room for later rows, so a path that has been drained is not run again: that is an error.
    Output and checkpoint lie in the shared folder, so a lost executor costs a retry, not state.
    """
    spark = stream.sparkSession
    path = path or scratch_dir(spark, label)
    if _drained(spark, path):
        raise ValueError(f"{path} has been drained; every row after that would be late")
    if spark.conf.get(STATE_STORE, None) != ROCKSDB:
        spark.conf.set(STATE_STORE, ROCKSDB)
    # Counting the rows of a store, for a metric, costs a look-up before each write.
    spark.conf.set(COUNT_ROWS, "false")
    writer = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
    )
    writer.start().awaitTermination()
    if drain is not None:
        # The mark comes first: a run that breaks off in between may have moved the watermark already.
        spark.range(1).write.mode("append").parquet(f"{path}/drained")
        for one in [drain] if isinstance(drain, Drain) else drain:
            one.write(spark)
        writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
