"""Domain tables as views over the generated benchmark tables.

There are no weather tables to run on, so users become stations and the event
types become sensors. Every definition is a plain projection or one aggregation
of the given table and has a SQL twin in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratusqc.constants import VARIABLES
from stratusqc.functions.alerts import severity
from stratusqc.operators.reshape import wide_to_long
from stratusqc.schemas import SPEC

SENSORS = ("view", "click", "purchase", "signup", "error")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a zoned timestamp, as watermarks and Unix arithmetic need."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _daily_mean(sensor: str) -> Column:
    """Mean in hundredths, summed as integers: the same bits whatever the order of rows."""
    hit = F.col("event_type") == sensor
    cents = F.sum(F.when(hit, F.round(F.col("value") * 100).cast("bigint")))
    return F.try_divide(cents.cast("double"), F.lit(100.0) * F.count(F.when(hit, 1)))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide reading per station and day; sensors without events that day are NULL."""
    daily = (
        events(spark, sf_dir)
        .groupBy(F.col("user_id").alias("station_id"), F.date_trunc("day", "ts").alias("ts"))
        .agg(*[_daily_mean(s).alias(s) for s in SENSORS])
    )
    return daily.select(
        (F.col("station_id") * 100000 + F.datediff("ts", F.lit("1970-01-01").cast("date"))).alias("reading_id"),
        "station_id",
        "ts",
        F.col("view").alias("temperature"),
        F.when(F.col("click").isNotNull(), F.least(F.col("click"), F.lit(100.0))).alias("humidity"),
        F.col("purchase").alias("pressure"),
        F.col("signup").alias("wind_speed"),
        ((F.col("error") * 7) % 360).alias("wind_direction"),
        (F.floor(F.col("view") / 120) * 10.0).cast("double").alias("rainfall"),
        (F.floor(F.col("click") / 60) * 50.0).cast("double").alias("solar_radiation"),
        F.lit("live").alias("ingest_source"),
    )


def readings_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_to_long(readings(spark, sf_dir)).drop("ingest_source")


def _specs() -> Column:
    """Own limits per station; some stations leave out fields, some a whole variable."""

    def spec(low, high, step, count):
        return F.struct(
            F.lit(low).cast("double"),
            F.lit(high).cast("double"),
            F.lit(step).cast("double"),
            F.lit(count).cast("int"),
            F.lit("u"),
        ).cast(SPEC)

    usual = spec(0, 200, 120, 3)
    temperature = F.when(F.col("station_id") % 5 == 0, spec(None, 150, None, None)).otherwise(usual)
    pairs = [F.lit("temperature"), temperature, F.lit("wind_direction"), spec(0, 360, 150, 3)]
    for v in ("humidity", "pressure", "wind_speed", "solar_radiation"):
        pairs += [F.lit(v), usual]
    without_rain = F.create_map(*pairs)
    with_rain = F.map_concat(without_rain, F.create_map(F.lit("rainfall"), usual))
    return F.when(F.col("station_id") % 7 == 0, without_rain).otherwise(with_rain)


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    sid = F.col("station_id")
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("station_id")).distinct()
    return ids.select(
        sid,
        F.concat(F.lit("ST"), sid).alias("station_code"),
        F.concat(F.lit("Station "), sid).alias("name"),
        (F.lit(20.0) + F.lit(0.25) * (sid % 40)).alias("latitude"),
        (F.lit(70.0) + F.lit(0.25) * F.floor(sid / 40)).alias("longitude"),
        ((sid * 13) % 900).cast("double").alias("elevation_m"),
        F.concat(F.lit("State "), sid % 7).alias("state"),
        F.concat(F.lit("District "), sid % 23).alias("district"),
        F.date_add(F.lit("2019-01-01").cast("date"), (sid % 1500).cast("int")).alias("install_date"),
        _specs().alias("sensor_specs"),
        F.when(sid % 29 == 0, "decommissioned").otherwise("active").alias("status"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-level verdict rows, for the operators that start from stored results."""
    value, eid = F.col("value"), F.col("event_id")
    flagged = value >= 60
    reasons = ("RULE_RANGE", "RULE_FLATLINE", "RULE_STEP", "ML_AND_SPATIAL_CONFIRMED", "SPATIAL_MISMATCH",
               "ML_ISOFOREST", "ML_LSTM_AE")
    faults = ("spike", "flatline", "spike", "drift", "spatial_inconsistency", "drift", "dropout")
    pick = lambda names: F.get(F.array(*[F.lit(n) for n in names]), (eid % len(names)).cast("int"))
    return events(spark, sf_dir).select(
        eid.alias("qc_id"),
        eid.alias("reading_id"),
        F.col("user_id").alias("station_id"),
        F.get(F.array(*[F.lit(v) for v in VARIABLES]), (F.floor(eid / 7) % 7).cast("int")).alias("variable"),
        F.when(value >= 90, "anomalous").when(flagged, "suspect").otherwise("valid").alias("verdict"),
        F.when(flagged, pick(reasons)).otherwise("VALID_READING").alias("reason_code"),
        F.when(flagged, pick(faults)).alias("fault_type"),
        ((50 + eid % 50) / F.lit(100.0)).alias("confidence"),
        "value",
        F.col("ts").alias("created_at"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert per flagged verdict; status and resolution follow the id."""
    qc = verdicts(spark, sf_dir).filter(F.col("verdict") != "valid")
    status = F.when(F.col("qc_id") % 3 == 0, "open").when(F.col("qc_id") % 3 == 1, "acknowledged").otherwise("resolved")
    return qc.select(
        F.col("qc_id").alias("alert_id"),
        "station_id",
        F.col("qc_id").alias("qc_result_id"),
        severity(F.col("verdict"), F.col("confidence"), F.col("reason_code")).alias("severity"),
        status.alias("status"),
        F.concat(F.lit("Alert on "), F.col("variable")).alias("message"),
        "created_at",
        F.when(F.col("qc_id") % 3 == 2, F.col("created_at") + F.expr("interval 2 hours")).alias("resolved_at"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as operator feedback: two entries per verdict where both documents are labelled."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        doc.alias("feedback_id"),
        (doc - doc % 2).alias("qc_result_id"),
        (doc % 2000).alias("user_id"),
        F.when(F.col("toxic") == 1, "confirmed_fault")
        .when(F.col("quality") == 1, "false_alarm")
        .otherwise("unsure")
        .alias("label"),
        F.timestamp_seconds(F.lit(1706745600) + doc * 60).alias("created_at"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.concat(F.col("c_name"), F.lit("@example.org")).alias("email")
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.array(*[F.lit(r) for r in ("admin", "data_quality_officer", "field_technician", "forecaster")])
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "in_progress")
    rank = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("task_id"),
        F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title"),
        F.get(roles, (F.col("o_custkey") % 4).cast("int")).alias("assigned_role"),
        F.when(rank == "1", "critical").when(rank == "2", "high").when(rank == "3", "medium").otherwise("low").alias("priority"),
        status.otherwise("completed").alias("status"),
        F.concat(F.lit("ST"), F.col("o_custkey") % 150).alias("station_code"),
        F.date_format(F.col("o_orderdate") + F.expr("interval 7 days"), "yyyy-MM-dd").alias("due_date"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("event_id").alias("audit_id"),
        F.concat(F.lit("user"), F.col("user_id"), F.lit("@example.org")).alias("user_email"),
        F.upper("event_type").alias("action"),
        F.get_json_object("props", "$.k").alias("resource"),
        F.col("ts").alias("created_at"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as model versions; activation order is not the order of training."""
    pk = F.col("p_partkey")
    variable = F.get(F.array(*[F.lit(v) for v in VARIABLES]), (pk % 7).cast("int"))
    return table(spark, sf_dir, "part").select(
        pk.alias("model_id"),
        F.when(F.col("p_size") % 2 == 0, "isolation_forest").otherwise("reconstruction").alias("model_type"),
        variable.alias("variable"),
        F.concat(F.lit("v1."), F.floor(pk / 7) + 1, F.lit(".0")).alias("version"),
        F.timestamp_seconds(F.lit(1704067200) + pk * 60).alias("trained_at"),
        F.when(F.col("p_size") > 10, F.timestamp_seconds(F.lit(1704067200) + pk * 60 + F.col("p_size") * 3600)).alias(
            "activated_at"
        ),
    )
