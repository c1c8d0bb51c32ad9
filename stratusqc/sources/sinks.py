"""Writing results: date-partitioned Parquet, appended or kept up to date by key, and CSV exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from stratusqc.session import write_and_reread


def write_results(df: DataFrame, path: str, time_column: str = "created_at", mode: str = "append") -> None:
    """Append to Parquet partitioned by day, so that later reads prune by date.

    Rows are rebalanced by day: quiet days share a task and yield few files, a day that holds a
    large share of all rows is split over as many tasks as its size asks for.
    """
    dated = df.withColumn("day", F.to_date(time_column))
    dated.hint("rebalance", F.col("day")).write.mode(mode).partitionBy("day").parquet(path)


def upsert_results(df: DataFrame, path: str, keys: Sequence[str] = ("qc_id",), time_column: str = "created_at") -> None:
    """Write so that each key has one row: rows of ``df`` replace stored ones of their key, other rows stay.

    A repeated run changes nothing. Only the days that ``df`` has rows of are read and overwritten, each as a whole; a
    key keeps its day. Of several rows of one key in ``df`` the last by time stays, of equal times any one, but always
    the same one. Nested columns are stored as JSON text. One run at a time may write to a path.
    """
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, StructType)]
    flat = df.withColumns({c: F.to_json(c) for c in nested}).withColumn("day", F.to_date(time_column))
    rest = [c for c in flat.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(time_column, F.xxhash64(*rest)))
    new = write_and_reread(flat.groupBy(*keys).agg(last.alias("_r")).select(*keys, "_r.*"), "upsert")
    days = sorted(r["day"] for r in new.select("day").distinct().collect() if r["day"] is not None)
    try:
        stored = df.sparkSession.read.schema(new.schema).parquet(path).filter(F.col("day").isin(days))
        merged = new.unionByName(stored.join(new.select(*keys), list(keys), "left_anti"))
        new = write_and_reread(merged, "upsert")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    rows = new.hint("rebalance", F.col("day")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    rows.partitionBy("day").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
