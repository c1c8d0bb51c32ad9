"""Labelled faults put into clean readings, to measure detectors with.

Positions count a station's readings in time order from 0. Only the first ``start + duration``
readings of a station are ever ranked, so long or busy stations cost no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratusqc.operators.history import position

LABELS = ("is_anomalous", "fault_type", "fault_variable")

# The benchmark's fault per kind of station: variable, start, duration, size.
BENCHMARK = {
    "flatline": ("temperature", 10, 8, 0.0),
    "spike": ("temperature", 16, 1, 18.0),
    "drop": ("humidity", 20, 1, -40.0),
    "drift": ("temperature", 12, 24, 10.0),
    "dropout": ("temperature", 18, 6, 0.0),
}
BENCHMARK_FAULT = {"flatline": "flatline", "spike": "spike", "drop": "spike", "drift": "drift", "dropout": "dropout"}


def labelled(readings: DataFrame) -> DataFrame:
    """Add label columns of clean readings, unless they are there already."""
    if "is_anomalous" in readings.columns:
        return readings
    return readings.withColumns(
        {
            "is_anomalous": F.lit(False),
            "fault_type": F.lit("valid"),
            "fault_variable": F.lit(None).cast("string"),
        }
    )


def row_position(readings: DataFrame, last: int | None = None) -> DataFrame:
    """Readings with ``pos``, their place in the time order of their station; up to position ``last``.

    The limit is put on the row number itself: Spark then cuts each station before the shuffle. Without a limit a
    station's rows are numbered in parts of equal size.
    """
    if last is None:
        return position(readings, ["station_id"], ["ts"])
    w = Window.partitionBy("station_id").orderBy("ts")
    ranked = readings.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= last + 1)
    return ranked.withColumn("pos", F.col("pos") - 1)


def _hit_rows(readings: DataFrame, variable: str, station, start: int, duration: int) -> DataFrame:
    """Keys of the affected readings with step, length and first value of the fault."""
    rows = readings if station is None else readings.filter(F.col("station_id") == station)
    head = row_position(rows.select("station_id", "ts", variable), start + duration - 1)
    hit = head.filter(F.col("pos") >= start)
    per_station = Window.partitionBy("station_id")
    return hit.select(
        "station_id",
        "ts",
        (F.col("pos") - start).alias("_step"),
        F.count(F.lit(1)).over(per_station).alias("_n"),
        F.min_by(F.col(variable), F.col("pos")).over(per_station).alias("_first"),
    )


def _inject(readings, variable, station, start, duration, fault: str, changed) -> DataFrame:
    """Replace ``variable`` on the affected readings by ``changed`` and label them."""
    base = labelled(readings)
    hits = _hit_rows(readings, variable, station, start, duration)
    hit = F.col("_step").isNotNull()
    return (
        base.join(hits, ["station_id", "ts"], "left")
        .withColumns(
            {
                variable: F.when(hit, changed).otherwise(F.col(variable)),
                "is_anomalous": F.when(hit, True).otherwise(F.col("is_anomalous")),
                "fault_type": F.when(hit, fault).otherwise(F.col("fault_type")),
                "fault_variable": F.when(hit, variable).otherwise(F.col("fault_variable")),
            }
        )
        .select(*base.columns)
    )


def ramp(total: Column | float, step: Column, n: Column) -> Column:
    """Even steps from 0 to ``total``; a single step stays at 0."""
    size = total if isinstance(total, Column) else F.lit(float(total))
    return F.when(n > 1, size * step / (n - 1)).otherwise(F.lit(0.0))


def inject_flatline(
    readings: DataFrame, variable: str = "temperature", station=None, start: int = 12, duration: int = 8,
    value: float | None = None,
) -> DataFrame:
    """Freeze at the first affected value, or at a given one."""
    frozen = F.col("_first") if value is None else F.lit(float(value))
    return _inject(readings, variable, station, start, duration, "flatline", frozen)


def inject_spike(
    readings: DataFrame, variable: str = "temperature", station=None, start: int = 15, magnitude: float = 16.0,
    duration: int = 1,
) -> DataFrame:
    """Add a jump, downwards if negative."""
    return _inject(readings, variable, station, start, duration, "spike", F.col(variable) + F.lit(magnitude))


def inject_drift(
    readings: DataFrame, variable: str = "temperature", station=None, start: int = 10, duration: int = 24,
    total: float = 9.0,
) -> DataFrame:
    """Add an offset growing evenly to ``total`` over the readings that exist."""
    offset = ramp(total, F.col("_step"), F.col("_n"))
    return _inject(readings, variable, station, start, duration, "drift", F.col(variable) + offset)


def inject_dropout(
    readings: DataFrame, station=None, start: int = 14, duration: int = 6, remove_rows: bool = True,
    variable: str = "temperature",
) -> DataFrame:
    """Silence: the readings vanish, or the variable is missing in them. Never zero."""
    if not remove_rows:
        return _inject(readings, variable, station, start, duration, "dropout", F.lit(None).cast("double"))
    gone = _hit_rows(readings, variable, station, start, duration).select("station_id", "ts")
    return labelled(readings).join(gone, ["station_id", "ts"], "left_anti")


def inject_spatial_inconsistency(
    readings: DataFrame, station, variable: str = "temperature", start: int = 15, magnitude: float = 14.0,
    duration: int = 5,
) -> DataFrame:
    """One station departs for a while, its neighbours do not."""
    return inject_spike(readings, variable, station, start, magnitude, duration)


def inject_regional_event(
    readings: DataFrame, variable: str = "temperature", start: str | None = None, hours: int = 6, delta: float = 8.0
) -> DataFrame:
    """Real weather: all stations shift for some hours. Labelled, but not anomalous."""
    base = labelled(readings)
    if start is None:
        begin = readings.agg(F.min("ts") + F.make_interval(hours=F.lit(12))).scalar()
    else:
        begin = F.lit(start).cast("timestamp")
    during = (F.col("ts") >= begin) & (F.col("ts") < begin + F.make_interval(hours=F.lit(hours)))
    return base.withColumns(
        {
            variable: F.when(during, F.col(variable) + F.lit(delta)).otherwise(F.col(variable)),
            "is_anomalous": F.when(during, False).otherwise(F.col("is_anomalous")),
            "fault_type": F.when(during, "plausible_extreme").otherwise(F.col("fault_type")),
        }
    )


def first_stations_plan(readings: DataFrame) -> DataFrame:
    """One kind of fault for each of the first five stations."""
    kinds = F.array(*[F.lit(k) for k in BENCHMARK])
    five = readings.select("station_id").distinct().orderBy("station_id").limit(len(BENCHMARK))
    order = Window.orderBy("station_id")
    return five.select("station_id", F.get(kinds, F.row_number().over(order) - 1).alias("kind"))


def labelled_benchmark(readings: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """Readings with one labelled fault per planned station (``station_id``, ``kind``), in one pass."""
    plan = first_stations_plan(readings) if plan is None else plan
    base = labelled(readings)
    last = max(start + duration for _, start, duration, _ in BENCHMARK.values()) - 1
    head = row_position(
        readings.select("station_id", "ts", "temperature").join(plan, "station_id"), last
    )

    def by_kind(pick):
        c = None
        for kind, spec in BENCHMARK.items():
            c = F.when(F.col("kind") == kind, F.lit(pick(kind, spec))) if c is None else c.when(
                F.col("kind") == kind, F.lit(pick(kind, spec))
            )
        return c

    start, duration = by_kind(lambda k, s: s[1]), by_kind(lambda k, s: s[2])
    per_station = Window.partitionBy("station_id")
    hits = head.filter((F.col("pos") >= start) & (F.col("pos") < start + duration)).select(
        "station_id",
        "ts",
        "kind",
        (F.col("pos") - start).alias("_step"),
        F.count(F.lit(1)).over(per_station).alias("_n"),
        F.min_by("temperature", "pos").over(per_station).alias("_first"),
    )
    kind, size = F.col("kind"), by_kind(lambda k, s: s[3])
    temperature = (
        F.when(kind == "flatline", F.col("_first"))
        .when(kind == "spike", F.col("temperature") + size)
        .when(kind == "drift", F.col("temperature") + ramp(size, F.col("_step"), F.col("_n")))
        .when(kind == "dropout", F.lit(None).cast("double"))
        .otherwise(F.col("temperature"))
    )
    hit = kind.isNotNull()
    return (
        base.join(hits, ["station_id", "ts"], "left")
        .withColumns(
            {
                "temperature": temperature,
                "humidity": F.when(kind == "drop", F.col("humidity") + size).otherwise(F.col("humidity")),
                "is_anomalous": F.when(hit, True).otherwise(F.col("is_anomalous")),
                "fault_type": F.coalesce(by_kind(lambda k, s: BENCHMARK_FAULT[k]), F.col("fault_type")),
                "fault_variable": F.coalesce(by_kind(lambda k, s: s[0]), F.col("fault_variable")),
            }
        )
        .select(*base.columns)
    )
