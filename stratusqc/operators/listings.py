"""Lists, pages, latest-row lookups and enrichment joins over the operational tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filtered(df: DataFrame, **equals) -> DataFrame:
    """Keep rows equal to every given value; None and ``"all"`` mean no filter."""
    for column, value in equals.items():
        if value is not None and value != "all":
            df = df.filter(F.col(column) == value)
    return df


def page(df: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """One page with ``total``, the size of the whole list.

    The total is an aggregate of its own, combined before any shuffle; a window
    over everything would bring all rows into one task.
    """
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total.scalar())


def station_filter(stations: DataFrame, state: str | None = None, status: str | None = None) -> DataFrame:
    return filtered(stations, state=state, status=status).orderBy("state", "station_code")


def text_search(df: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Case-insensitive substring in any of the columns."""
    wanted = F.lit(query.strip().lower())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(wanted), F.lit(False))
    return df.filter(hit)


def distinct_states(stations: DataFrame) -> DataFrame:
    return stations.select("state").distinct().orderBy("state")


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The newest ``n`` rows of every key. Ranking stops at ``n`` before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def telemetry_range(readings: DataFrame, station=None, start=None, end=None, limit: int = 100) -> DataFrame:
    """Newest ``limit`` readings per station within a closed time range, ascending."""
    df = readings if station is None else readings.filter(F.col("station_id") == station)
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    return newest_per_key(df, ["station_id"], ["ts"], limit).orderBy("station_id", "ts")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the largest ``order`` per key, by one combinable aggregation."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("_r")).select(*keys, "_r.*").select(*df.columns)


def latest_feedback(feedback: DataFrame) -> DataFrame:
    return latest_per_key(feedback, ["qc_result_id"], ["created_at", "feedback_id"])


def alert_enriched(alerts: DataFrame, stations: DataFrame, qc: DataFrame, feedback: DataFrame) -> DataFrame:
    """Alerts with station names, the judged variable and the newest feedback label, if any."""
    return (
        alerts.join(stations.select("station_id", "station_code", F.col("name").alias("station_name")), "station_id")
        .join(qc.select(F.col("qc_id").alias("qc_result_id"), "variable"), "qc_result_id")
        .join(
            latest_feedback(feedback).select("qc_result_id", F.col("label").alias("feedback_label")),
            "qc_result_id",
            "left",
        )
    )


def alert_list(
    enriched: DataFrame, status=None, severity=None, station=None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """One page of alerts, newest first. ``station`` is an id or a code."""
    df = filtered(enriched, status=status, severity=severity)
    if station is not None:
        df = df.filter((F.col("station_id").cast("string") == str(station)) | (F.col("station_code") == str(station)))
    return page(df, [F.col("created_at").desc(), F.col("alert_id").desc()], offset, limit)


def feedback_enriched(
    feedback: DataFrame, qc: DataFrame, stations: DataFrame, users: DataFrame, alerts: DataFrame
) -> DataFrame:
    """Feedback with its verdict's variable, station, author and, where one exists, the alert."""
    alert_ids = alerts.groupBy("qc_result_id").agg(F.max("alert_id").alias("alert_id"))
    return (
        feedback.join(qc.select(F.col("qc_id").alias("qc_result_id"), "station_id", "variable"), "qc_result_id")
        .join(stations.select("station_id", "station_code"), "station_id")
        .join(users.select("user_id", "email"), "user_id", "left")
        .join(alert_ids, "qc_result_id", "left")
    )


def feedback_list(enriched: DataFrame, label=None, limit: int = 50, offset: int = 0) -> DataFrame:
    df = filtered(enriched, label=label)
    return page(df, [F.col("created_at").desc(), F.col("feedback_id").desc()], offset, limit)


def task_list(tasks: DataFrame, role=None, status=None, priority=None, station=None) -> DataFrame:
    return filtered(tasks, assigned_role=role, status=status, priority=priority, station_code=station).orderBy(
        F.col("created_at").desc(), F.col("task_id").desc()
    )


def task_status_counts(tasks: DataFrame) -> DataFrame:
    return tasks.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "in_progress", "completed")],
    )


def audit_recent(logs: DataFrame, action: str | None = None, limit: int = 50) -> DataFrame:
    return filtered(logs, action=action).orderBy(F.col("created_at").desc(), F.col("audit_id").desc()).limit(limit)


def active_alerts_per_station(alerts: DataFrame) -> DataFrame:
    return (
        alerts.filter(F.col("status") != "resolved").groupBy("station_id").agg(F.count(F.lit(1)).alias("active_alerts"))
    )


def alert_tiles(alerts: DataFrame, feedback: DataFrame) -> DataFrame:
    """Headline counts of the alert feed."""
    noted = feedback.select("qc_result_id").distinct().withColumn("_noted", F.lit(True))
    return alerts.join(noted, "qc_result_id", "left").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "open").alias("open"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count("_noted").alias("with_feedback"),
    )


def live_buffer(points: DataFrame, keys: Sequence[str], order: str, version: str, n: int) -> DataFrame:
    """Newest ``n`` points per key after repeats of the same instant were replaced by the last one."""
    unique = latest_per_key(points, [*keys, order], [version])
    return newest_per_key(unique, keys, [order], n)


def live_stats(long: DataFrame, buffer: int = 50, last: int = 10) -> DataFrame:
    """Per station and variable: min, max, mean of the last present values, newest step."""
    w = Window.partitionBy("station_id", "variable").orderBy(F.col("ts").desc())
    ranked = long.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= buffer)
    present = Window.partitionBy("station_id", "variable").orderBy("_r")
    ranked = ranked.withColumn("_p", F.sum(F.when(F.col("value").isNotNull(), 1).otherwise(0)).over(present))
    value, r = F.col("value"), F.col("_r")
    return ranked.groupBy("station_id", "variable").agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg(F.when(F.col("_p") <= last, value)).alias("mean_last"),
        (F.max(F.when(r == 1, value)) - F.max(F.when(r == 2, value))).alias("delta"),
    )


def ranked_by_value(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """Rank by a column with few distinct values, largest first, equal values sharing a rank.

    Positions come from counts per distinct value, so no task sees the whole table.
    """
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy(F.col(column).desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select(column, (F.coalesce(F.sum("_n").over(ahead), F.lit(0)) + 1).alias(name))
    return df.join(ranks, column)
