"""The gate of a stream: every row goes to exactly one of two tables, accepted or rejected with a reason.

Spark's stateful operators drop rows behind their watermark without a trace. The gate makes the same cut itself, once
and visibly: a row is late if it is older, by more than the delay, than the newest row of the batches before its own.
Jobs behind the gate read the accepted table and never see such a row.

Each batch is written by one job, both outcomes at once, under its own number, and is entered in a ledger when it is
complete. A batch that is run again after a failure overwrites its own number, takes the same watermark from the ledger
and thus gives the same rows; rows of a batch that is not in the ledger are not read. So each row counts exactly once.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

ACCEPTED, LATE, NO_TIME = "accepted", "late", "timestamp_invalid"
LEDGER = "batch long, newest timestamp, watermark timestamp, n_rows long"


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(f"{path}/ledger")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def watermark_of(spark: SparkSession, path: str, batch: int, delay: timedelta) -> datetime | None:
    """What rows of this batch have to reach: the newest time of all batches before it, less the delay."""
    before = _ledger(spark, path).filter(F.col("batch") < batch)
    newest = before.agg((F.max("newest") - F.lit(delay)).alias("w")).first()["w"]
    return newest


def pass_batch(rows: DataFrame, batch: int, path: str, time_column: str, delay: timedelta) -> None:
    """Write one batch through the gate; written again, it replaces itself."""
    spark = rows.sparkSession
    if _ledger(spark, path).filter(F.col("batch") == batch).count():
        return
    watermark = watermark_of(spark, path, batch, delay)
    at = F.col(time_column)
    late = F.lit(False) if watermark is None else at < F.lit(watermark)
    outcome = F.when(at.isNull(), NO_TIME).when(late, LATE).otherwise(ACCEPTED)
    rows.withColumn("outcome", outcome).write.mode("overwrite").partitionBy("outcome").parquet(f"{path}/rows/batch={batch}")
    written = rows_of(spark, path, rows.schema, batch)
    # Times that lie ahead of all others move the watermark as they do in Spark; rows without a time don't.
    seen = written.agg(F.max(time_column).alias("newest"), F.count(F.lit(1)).alias("n")).first()
    entry = [(batch, seen["newest"], watermark, seen["n"])]
    spark.createDataFrame(entry, LEDGER).coalesce(1).write.mode("append").parquet(f"{path}/ledger")


def rows_of(spark: SparkSession, path: str, schema: StructType, batch: int) -> DataFrame:
    """All rows of one batch; none if it had none."""
    try:
        return spark.read.schema(StructType(schema.fields)).parquet(f"{path}/rows/batch={batch}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run_gate(stream: DataFrame, path: str, time_column: str, delay: timedelta) -> None:
    """Take everything available through the gate; run again, it goes on where it stopped."""
    writer = (
        stream.writeStream.foreachBatch(lambda rows, batch: pass_batch(rows, batch, path, time_column, delay))
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
    )
    writer.start().awaitTermination()


def gated(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of all complete batches with ``outcome`` and ``batch``; filters on these two read only their files."""
    ledger = _ledger(spark, path)
    if not ledger.filter("n_rows > 0").count():
        return spark.createDataFrame([], schema).withColumns({"outcome": F.lit(""), "batch": F.lit(0).cast("long")})
    named = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields]
    stored = spark.read.schema(", ".join([*named, "batch long", "outcome string"])).parquet(f"{path}/rows")
    return stored.join(ledger.select("batch").distinct(), "batch", "left_semi").select(*[f"`{f.name}`" for f in schema.fields], "outcome", "batch")
