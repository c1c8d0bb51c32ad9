"""Column expressions for alert severity and wording."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratusqc.constants import ALERT_PREFIX, ALERT_TEXT_OTHERWISE, ALERT_TEXTS


def severity(verdict: Column, confidence: Column, reason: Column) -> Column:
    """How urgent a verdict is; NULL for valid values."""
    grave = reason.isin("RULE_FLATLINE", "RULE_STEP", "ML_AND_SPATIAL_CONFIRMED", "SPATIAL_MISMATCH")
    return (
        F.when(verdict == "valid", F.lit(None).cast("string"))
        .when(verdict == "suspect", "low")
        .when(reason == "RULE_RANGE", "critical")
        .when((reason == "SPATIAL_MISMATCH") & (confidence >= 0.95), "critical")
        .when(grave, "high")
        .when((reason == "ML_ISOFOREST") & (confidence < 0.70), "low")
        .otherwise("medium")
    )


def capitalized(text: Column) -> Column:
    """First letter upper case, all others lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 20)))


def number_text(value: Column, digits: int = 3) -> Column:
    """Shortest text of a rounded number, always with a decimal point, or None."""
    return F.coalesce(F.bround(F.round(value, 6), digits).cast("string"), F.lit("None"))


def alert_message(
    severity_: Column,
    station_name: Column,
    station_code: Column,
    variable: Column,
    reason: Column,
    confidence: Column,
    value: Column,
    flat_count: Column,
    flat_value: Column,
    delta: Column,
    spatial_delta: Column,
    z_score: Column,
    ml_score: Column,
) -> Column:
    """Readable notification, filled into the fixed wording of its reason."""
    fields = {
        "severity": F.upper(severity_),
        "station_name": station_name,
        "station_code": station_code,
        "variable": capitalized(variable),
        "reason": reason,
        "confidence": F.bround(confidence * 100, 0).cast("int").cast("string"),
        "value": number_text(value),
        "flat_count": F.coalesce(flat_count, F.lit(6)).cast("string"),
        "flat_value": number_text(flat_value),
        "delta": number_text(delta),
        "spatial_delta": number_text(spatial_delta),
        "z_score": number_text(z_score),
        "ml_score": number_text(ml_score, 4),
    }
    text = filled(ALERT_TEXT_OTHERWISE, fields)
    for code, wording in ALERT_TEXTS.items():
        text = F.when(reason == code, filled(wording, fields)).otherwise(text)
    return F.concat(filled(ALERT_PREFIX, fields), text)


def filled(wording: str, fields: dict[str, Column]) -> Column:
    """Text with columns in place of the names in braces."""
    parts = re.split(r"\{(\w+)\}", wording)
    return F.concat(*[fields[p] if k % 2 else F.lit(p) for k, p in enumerate(parts)])
