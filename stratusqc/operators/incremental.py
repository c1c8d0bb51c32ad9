"""Quality control of what is new: verdicts kept up to date in a store, batch by batch.

A store is a folder with four tables. ``readings`` and ``verdicts`` are partitioned by day. ``recent`` holds, for the last
day of each run, every station's last readings up to that day: all that a later batch has to know about the past.
``runs`` lists the finished runs.

A batch starts behind the newest ``recent`` table that is older than its first day. Batches that arrive in order
therefore read no stored readings at all, only ``recent``, whose size is that of the fleet. A batch with late readings
goes back to an older ``recent`` table and judges all days since again, as the late ones change the history of later
readings and the neighbours of readings at their instant. Only the partitions of those days are overwritten. The result
is always what one run over all readings would give.

A run that is interrupted leaves partitions of its own days only and no entry in ``runs``; run the batch again. One run
at a time may write to a store.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from stratusqc.constants import HISTORY_DEPTH, VARIABLES
from stratusqc.operators.qc import merged_verdicts
from stratusqc.session import write_and_reread

READING = "reading_id long, station_id long, ts timestamp, " + ", ".join(f"{v} double" for v in VARIABLES)
RECENT = f"{READING}, as_of date"
RUNS = "first_day date, last_day date, recent_days array<date>"
_COLUMNS = ["reading_id", "station_id", "ts", *VARIABLES]
BROADCAST_ROWS = 20_000


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``; no rows if it was never written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stored_readings(spark: SparkSession, store: str) -> DataFrame:
    return _stored(spark, f"{store}/readings", f"{READING}, day date")


def stored_verdicts(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/verdicts")


def recent_days(spark: SparkSession, store: str) -> list[date]:
    """Days for which ``recent`` is valid: one entry for each run at most, not rows of readings."""
    runs = _stored(spark, f"{store}/runs", RUNS)
    return sorted(r["d"] for r in runs.select(F.explode("recent_days").alias("d")).distinct().collect())


def _merged_if_long(table: DataFrame) -> DataFrame:
    """``table`` for joins, which are merges if it has more than ``BROADCAST_ROWS`` rows.

    Spark goes by the bytes of a table's files, and the limits of a station take a few there but hundreds in memory: a large
    fleet would be gathered in the driver.
    """
    return table.hint("merge") if table.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS else table


def _overwrite_days(df: DataFrame, path: str, day: str) -> None:
    """Replace the partitions that ``df`` has rows of, and no others; a large day is split at run time."""
    rows = df.hint("rebalance", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    rows.partitionBy(day).parquet(path)


def _one_per_instant(old: DataFrame, new: DataFrame) -> DataFrame:
    """Readings of both; what is stored already wins, then the smallest id."""
    rest = F.struct("_new", *[c for c in _COLUMNS if c not in ("station_id", "ts")])
    both = old.select(*_COLUMNS, F.lit(0).alias("_new")).unionByName(new.select(*_COLUMNS, F.lit(1).alias("_new")))
    first = both.groupBy("station_id", "ts").agg(F.min_by(rest, F.struct("_new", "reading_id")).alias("_r"))
    return first.select("station_id", "ts", "_r.*").select(*_COLUMNS)


def _last_readings(readings: DataFrame, days: list[date], depth: int) -> DataFrame:
    """For each of ``days`` every station's last ``depth`` readings up to that day.

    First the last ones of each station's day, then those of the station: no task holds more than a station's day.
    """
    newest = F.col("ts").desc()
    of_day = Window.partitionBy("station_id", "_day").orderBy(newest)
    of_station = Window.partitionBy("station_id", "as_of").orderBy(newest)
    listed = F.array(*[F.lit(d) for d in days])
    return (
        readings.withColumn("_day", F.to_date("ts"))
        .withColumn("_n", F.row_number().over(of_day))
        .filter(F.col("_n") <= depth)
        .withColumn("as_of", F.explode(F.filter(listed, lambda d: d >= F.col("_day"))))
        .withColumn("_n", F.row_number().over(of_station))
        .filter(F.col("_n") <= depth)
        .select(*_COLUMNS, "as_of")
    )


def judge_batch(
    store: str,
    batch: DataFrame,
    stations: DataFrame,
    edges: DataFrame,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    depth: int = HISTORY_DEPTH,
    span_seconds: int | None = None,
) -> dict[str, date] | None:
    """Take ``batch`` into the store and judge it; returns the days judged, or None for an empty batch.

    ``stations`` and ``edges`` are written tables of the fleet's size that change seldom; a change of theirs reaches the
    days that are judged from then on. Readings without station or time are left out, as ingest rejects them.
    """
    spark = batch.sparkSession
    usable = batch.filter(F.col("station_id").isNotNull() & F.col("ts").isNotNull())
    new = write_and_reread(usable.select(*_COLUMNS), "batch")
    seen = new.agg(F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last")).first()
    if seen["first"] is None:
        return None
    known = recent_days(spark, store)
    base = max((d for d in known if d < seen["first"]), default=None)
    old = stored_readings(spark, store)
    old = old if base is None else old.filter(F.col("day") > F.lit(base))
    readings = write_and_reread(_one_per_instant(old, new), "readings")
    stations, edges = _merged_if_long(stations), _merged_if_long(edges)
    context = _stored(spark, f"{store}/recent", RECENT).filter(F.col("as_of") == F.lit(base)).select(*_COLUMNS)
    whole = readings if base is None else readings.unionByName(write_and_reread(context, "recent"))
    judged = merged_verdicts(whole, stations, edges, scorer, depth, span_seconds).withColumn("day", F.to_date("created_at"))
    if base is not None:
        judged = judged.filter(F.col("day") > F.lit(base))

    last = max([seen["last"], *known])
    days = sorted({d for d in known if d >= seen["first"]} | {last})
    _overwrite_days(judged, f"{store}/verdicts", "day")
    _overwrite_days(_last_readings(whole, days, depth), f"{store}/recent", "as_of")
    _overwrite_days(readings.withColumn("day", F.to_date("ts")), f"{store}/readings", "day")
    done = [(seen["first"], last, [last])]
    spark.createDataFrame(done, RUNS).coalesce(1).write.mode("append").parquet(f"{store}/runs")
    return {"first_day": seen["first"] if base is None else base, "last_day": last}
