"""Column expressions of the 30-day failure-risk model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratusqc.constants import (
    NOMINAL_ACTION,
    NOMINAL_DRIVER,
    RISK_ACTIONS,
    RISK_DRIVERS,
    RISK_INTERCEPT,
    RISK_WEIGHTS,
    SILENT_ACTION,
    SILENT_DRIVER,
)


def _capped(activation: Column) -> Column:
    return F.least(F.lit(1.0), activation)


def contributions() -> dict[str, Column]:
    """Weighted activation of each cause, from the health feature columns."""
    parts = {
        "drift": F.col("drift_count") / F.lit(4.0),
        "flatline": F.col("flatline_count") / F.lit(4.0),
        "anomaly": F.col("anom_rate") * 6.0 + F.col("suspect_rate") * 2.0,
        "alerts": (F.col("open_alerts") + F.col("critical_alerts") * 2.0) / F.lit(4.0),
        "dropout": F.col("dropout_count") / F.lit(3.0),
        "age": F.col("age_days") / F.lit(1825.0),
    }
    return {name: F.lit(RISK_WEIGHTS[name]) * _capped(part) for name, part in parts.items()}


def silent() -> Column:
    return F.col("total_readings") == 0


def failure_probability() -> Column:
    z = F.lit(RISK_INTERCEPT)
    for part in contributions().values():
        z = z + part
    p = F.bround(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 4)
    return F.when(silent(), F.lit(0.55)).otherwise(F.greatest(F.lit(0.02), F.least(F.lit(0.98), p)))


def risk_level(p: Column) -> Column:
    return F.when(p >= 0.70, "critical").when(p >= 0.40, "elevated").when(p >= 0.20, "moderate").otherwise("nominal")


def top_driver(p: Column) -> Column:
    """Largest contribution with its field action; earlier causes win ties."""
    rounded = {name: F.bround(part, 3) for name, part in contributions().items()}
    largest = F.greatest(*rounded.values())

    def outcome(driver: str, action: str) -> Column:
        return F.struct(F.lit(driver).alias("top_driver"), F.lit(action).alias("recommended_action"))

    chosen = F.when(silent(), outcome(SILENT_DRIVER, SILENT_ACTION)).when(
        (p <= 0.15) | (largest <= 0.05), outcome(NOMINAL_DRIVER, NOMINAL_ACTION)
    )
    for name, part in rounded.items():
        chosen = chosen.when(part == largest, outcome(RISK_DRIVERS[name], RISK_ACTIONS[name]))
    return chosen


def top_factors(level: Column, driver: Column, action: Column) -> Column:
    """Why a station is at risk, as nested fields: level, driver, action, each cause's share and the counts behind it."""
    metrics = ("total_readings", "anomalous_count", "suspect_count", "drift_count", "flatline_count", "dropout_count",
               "open_alerts", "critical_alerts", "age_days")
    return F.struct(
        level.alias("risk_level"),
        driver.alias("top_driver"),
        action.alias("recommended_action"),
        F.struct(*[F.bround(part, 3).alias(name) for name, part in contributions().items()]).alias("factor_breakdown"),
        F.struct(*metrics).alias("metrics_summary"),
    )
