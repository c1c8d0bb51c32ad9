"""Fleet status and failure risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratusqc.functions.risk import failure_probability, risk_level, top_driver, top_factors
from stratusqc.operators.listings import active_alerts_per_station, latest_per_key, newest_per_key, ranked_by_value

HEALTH = ("healthy", "suspect", "anomalous", "offline")


def health_class(status: Column, has_reading: Column, active_alerts: Column, verdict: Column) -> Column:
    return (
        F.when((status != "active") | ~has_reading, "offline")
        .when((active_alerts > 0) | (verdict == "anomalous"), "anomalous")
        .when(verdict == "suspect", "suspect")
        .otherwise("healthy")
    )


def station_health(stations: DataFrame, readings: DataFrame, qc: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row per station: health, latest reading and verdict, active alerts.

    Three combinable aggregations joined to the station table; nothing is sorted or self-joined.
    """
    latest = readings.groupBy("station_id").agg(
        F.max("ts").alias("latest_ts"), F.max_by("reading_id", "ts").alias("latest_reading_id")
    )
    verdict = qc.groupBy("station_id").agg(F.max_by(F.struct("verdict", "fault_type"), "qc_id").alias("_q"))
    joined = (
        stations.join(latest, "station_id", "left")
        .join(verdict, "station_id", "left")
        .join(active_alerts_per_station(alerts), "station_id", "left")
        .withColumns(
            {
                "active_alerts": F.coalesce("active_alerts", F.lit(0).cast("bigint")),
                "latest_verdict": F.col("_q.verdict"),
                "latest_fault_type": F.col("_q.fault_type"),
            }
        )
        .drop("_q")
    )
    return joined.withColumn(
        "health_status",
        health_class(
            F.col("status"), F.col("latest_ts").isNotNull(), F.col("active_alerts"), F.col("latest_verdict")
        ),
    )


def fleet_health_counts(health: DataFrame, *keys: str) -> DataFrame:
    counts = [F.count_if(F.col("health_status") == h).alias(f"{h}_count") for h in HEALTH]
    return health.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *counts)


def apply_live_alerts(health: DataFrame, new_alerts: DataFrame) -> DataFrame:
    """Stations with new alert events become anomalous, their counters grow by the number of events.

    The newest event's fault type replaces the shown one when it names any. Offline stations are
    patched too, as a live display does.
    """
    patch = new_alerts.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("_new"), F.max_by("fault_type", F.when(F.col("fault_type").isNotNull(), F.struct("created_at", "alert_id"))).alias("_fault")
    )
    hit = F.col("_new").isNotNull()
    return (
        health.join(patch, "station_id", "left")
        .withColumns(
            {
                "health_status": F.when(hit, "anomalous").otherwise(F.col("health_status")),
                "active_alerts": F.col("active_alerts") + F.coalesce("_new", F.lit(0)),
                "latest_fault_type": F.coalesce("_fault", "latest_fault_type"),
            }
        )
        .drop("_new", "_fault")
    )


def station_detail(
    stations: DataFrame, readings: DataFrame, qc: DataFrame, alerts: DataFrame, n: int = 50
) -> DataFrame:
    """Everything shown for a station, one row per item: its summary, its newest ``n`` readings
    and all of its active alerts, newest first (``section``, ``item``, ``at``, ``label``).

    Rows instead of arrays: a station may have any number of active alerts.
    """
    health = station_health(stations, readings, qc, alerts)
    summary = health.select(
        "station_id", F.lit("summary").alias("section"), F.col("station_id").cast("string").alias("item"),
        F.col("latest_ts").alias("at"), F.col("health_status").alias("label"),
    )
    recent = newest_per_key(readings, ["station_id"], ["ts"], n).select(
        "station_id", F.lit("reading").alias("section"), F.col("reading_id").cast("string").alias("item"),
        F.col("ts").alias("at"), F.lit(None).cast("string").alias("label"),
    )
    active = alerts.filter(F.col("status") != "resolved").select(
        "station_id", F.lit("alert").alias("section"), F.col("alert_id").cast("string").alias("item"),
        F.col("created_at").alias("at"), F.col("severity").alias("label"),
    )
    known = stations.select("station_id")
    return summary.unionByName(recent.join(known, "station_id", "left_semi")).unionByName(
        active.join(known, "station_id", "left_semi")
    )


def health_features(
    stations: DataFrame, readings: DataFrame, qc: DataFrame, alerts: DataFrame, as_of: str, lookback_days: int = 30
) -> DataFrame:
    """Counts behind the risk model; one aggregation per source, each combinable before its shuffle."""
    now = F.lit(as_of).cast("timestamp")
    start = now - F.make_interval(days=F.lit(lookback_days))
    heard = readings.filter(F.col("ts") >= start).groupBy("station_id").agg(F.count(F.lit(1)).alias("total_readings"))
    is_, fault = F.col("verdict"), F.col("fault_type")
    judged = (
        qc.filter(F.col("created_at") >= start)
        .groupBy("station_id")
        .agg(
            F.count_if(is_ == "anomalous").alias("anomalous_count"),
            F.count_if(is_ == "suspect").alias("suspect_count"),
            *[F.count_if(fault == f).alias(f"{f}_count") for f in ("drift", "flatline", "dropout")],
        )
    )
    raised = (
        alerts.filter(F.col("status") == "open")
        .groupBy("station_id")
        .agg(
            F.count(F.lit(1)).alias("open_alerts"),
            F.count_if(F.col("severity") == "critical").alias("critical_alerts"),
        )
    )
    counted = ["total_readings", "anomalous_count", "suspect_count", "drift_count", "flatline_count",
               "dropout_count", "open_alerts", "critical_alerts"]
    joined = stations
    for part in (heard, judged, raised):
        joined = joined.join(part, "station_id", "left")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in counted})
    base = F.greatest(F.col("total_readings"), F.lit(1))
    age = F.greatest(F.lit(1), F.datediff(F.to_date(now), "install_date"))
    return joined.withColumns(
        {
            "anom_rate": F.least(F.lit(1.0), F.col("anomalous_count") / base),
            "suspect_rate": F.least(F.lit(1.0), F.col("suspect_count") / base),
            "age_days": F.when(F.col("install_date").isNull(), 365).otherwise(age),
        }
    )


def failure_risk(features: DataFrame) -> DataFrame:
    p = F.col("failure_probability")
    return (
        features.withColumn("failure_probability", failure_probability())
        .withColumn("risk_level", risk_level(p))
        .withColumn("_d", top_driver(p))
        .withColumns({c: F.col(f"_d.{c}") for c in ("top_driver", "recommended_action")})
        .drop("_d")
    )


def fleet_predictions(
    stations: DataFrame, readings: DataFrame, qc: DataFrame, alerts: DataFrame, as_of: str, lookback_days: int = 30
) -> DataFrame:
    """Risk of every station with its rank in the fleet. Probabilities have four decimals, hence few values."""
    scored = failure_risk(health_features(stations, readings, qc, alerts, as_of, lookback_days))
    return ranked_by_value(scored, "failure_probability", "risk_rank").withColumn(
        "predicted_at", F.lit(as_of).cast("timestamp")
    )


def with_top_factors(predictions: DataFrame) -> DataFrame:
    """Predictions with ``top_factors``, the breakdown behind each; serialise with ``to_json`` at the sink only."""
    named = (F.col(c) for c in ("risk_level", "top_driver", "recommended_action"))
    return predictions.withColumn("top_factors", top_factors(*named))


def latest_prediction(predictions: DataFrame) -> DataFrame:
    return latest_per_key(predictions, ["station_id"], ["predicted_at"])


def fleet_summary(predictions: DataFrame) -> DataFrame:
    """Counts per level and the mean probability, over the latest prediction of each station."""
    latest = latest_prediction(predictions)
    levels = [
        F.count_if(F.col("risk_level") == level).alias(f"{level}_risk_count")
        for level in ("critical", "elevated", "moderate", "nominal")
    ]
    return latest.agg(
        F.count(F.lit(1)).alias("total_stations"),
        *levels,
        F.bround(F.coalesce(F.avg("failure_probability"), F.lit(0.0)), 4).alias("mean_failure_probability"),
    )


def top_risk(predictions: DataFrame, level: str | None = None, n: int | None = None) -> DataFrame:
    """Stations by falling risk; a limit becomes a top-n per task, not a full sort."""
    df = predictions if level is None else predictions.filter(F.lower("risk_level") == level.lower())
    ranked = df.orderBy(F.col("failure_probability").desc(), "station_id")
    return ranked.limit(n) if n is not None else ranked
