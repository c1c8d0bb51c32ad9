"""Column expressions for raw text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratusqc.constants import NULL_TOKENS, TIME_FORMATS

# Fixed patterns: what counts as a number, and as an ISO date or date-time.
NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"


def meaningful(text: Column) -> Column:
    """NULL for the tokens that stand for a missing value."""
    return F.when(~text.isin(*NULL_TOKENS), text)


def first_meaningful(*texts: Column) -> Column:
    return F.coalesce(*[meaningful(t) for t in texts])


def lenient_double(text: Column) -> Column:
    """Number, or NULL where the text is not one."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def lenient_timestamp(text: Column) -> Column:
    """ISO first (``Z`` or offset honoured), then the fixed formats; naive times are session time, UTC."""
    t = F.trim(text)
    iso = F.when(t.rlike(ISO_TIME), t.try_cast("timestamp"))
    return F.coalesce(iso, *[F.try_to_timestamp(t, F.lit(f)) for f in TIME_FORMATS])


def clamp_percent(value: Column) -> Column:
    """Keep within [0, 100]; NULL stays NULL (least and greatest would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)))


def reject_reason(humidity: Column, wind_direction: Column, ts: Column) -> Column:
    """Why the strict path refuses a reading; NULL when it does not."""
    return (
        F.when(ts.isNull(), "timestamp_invalid")
        .when((humidity < 0) | (humidity > 100), "humidity_out_of_bounds")
        .when((wind_direction < 0) | (wind_direction > 360), "wind_direction_out_of_bounds")
    )
