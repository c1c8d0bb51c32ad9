"""Bounded per-key history, safe for keys that hold a large share of all rows.

Every windowed check in this package looks back at most ``depth`` rows. A plain
``Window.partitionBy(key)`` would send a hot key to one task, so the window is
cut into spans of time: rows are partitioned by (key, span), and the last rows
of earlier spans are copied forward as context. The result is identical to the
uncut window for any distribution of rows over spans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratusqc.session import write_and_reread

WEEK_SECONDS = 7 * 86400


def time_span(ts: str, seconds: int = WEEK_SECONDS) -> Column:
    """Number of the fixed-length time slice a timestamp falls into."""
    return F.expr(f"unix_seconds(cast({ts} as timestamp)) div {seconds}")


def _context_rows(df: DataFrame, keys, order, columns, depth: int) -> DataFrame:
    """Rows of earlier spans that a later span of the same key still has to see.

    At most ``depth`` rows per (key, span) leave the first step; the second one
    walks over spans, not rows, so it stays small even for a hot key.
    """
    fields = [*order, *[c for c in columns if c not in order]]
    newest_first = Window.partitionBy(*keys, "_span").orderBy(*[F.col(c).desc() for c in order])
    tails = (
        df.select(*keys, "_span", *fields)
        .withColumn("_back", F.row_number().over(newest_first))
        .filter(F.col("_back") <= depth)
        .groupBy(*keys, "_span")
        .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_tail"))
    )
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(-depth, -1)
    seen = F.flatten(F.collect_list("_tail").over(before))
    kept = F.least(F.size("_seen"), F.lit(depth))
    return (
        tails.withColumn("_seen", seen)
        .filter(F.size("_seen") > 0)
        .select(*keys, "_span", F.inline(F.slice("_seen", -kept, kept)))
    )


def with_history(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    depth: int,
    name: str = "history",
    span: Column | None = None,
) -> DataFrame:
    """Append ``array<struct<columns>>``: up to ``depth`` earlier rows, then the row itself.

    ``order`` must be unique within a key. ``span`` is a column computed from the
    order columns (see :func:`time_span`) that never decreases along the order;
    without it the key is one window partition.
    """
    keys, order, columns = list(keys), list(order), list(columns)
    entry = F.collect_list(F.struct(*columns))
    if span is None:
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-depth, 0)
        return df.withColumn(name, entry.over(frame))
    base = df.withColumn("_span", span)
    context = _context_rows(base, keys, order, columns, depth).withColumn("_context", F.lit(True))
    frame = Window.partitionBy(*keys, "_span").orderBy(*order).rowsBetween(-depth, 0)
    return (
        base.withColumn("_context", F.lit(False))
        .unionByName(context, allowMissingColumns=True)
        .withColumn(name, entry.over(frame))
        .filter(~F.col("_context"))
        .drop("_context", "_span")
    )


def range_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "_part", parts: int | None = None) -> DataFrame:
    """``df`` dealt by ranges of (keys, order) into parts of nearly equal size, numbered along the order.

    The ranges are drawn from a sample of the rows, so a key or a day that holds most of them gets most of the parts.
    The result is written once: whoever reads it sees the same numbers.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = df.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in (*keys, *order)])
    return write_and_reread(dealt.withColumn(name, F.spark_partition_id()), "ranges")


def with_balanced_history(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], depth: int, name: str = "history", parts: int | None = None
) -> DataFrame:
    """:func:`with_history` under any skew: cut by equal shares of the rows instead of spans of time."""
    dealt = range_parts(df, keys, order, "_part", parts)
    return with_history(dealt, keys, order, columns, depth, name, span=F.col("_part")).drop("_part")


def position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos", parts: int | None = None) -> DataFrame:
    """Place of each row in the order of its key, from 0, under any skew.

    Rows are numbered within their part; a part starts where the key's parts before it end.
    """
    keys = list(keys)
    dealt = range_parts(df, keys, order, "_part", parts)
    counts = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    same = F.col("_part") == F.col("_of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    numbered = dealt.withColumn("_row", F.row_number().over(within)).join(starts, same)
    return numbered.select(*df.columns, (F.col("_before") + F.col("_row") - 1).alias(name))


def earlier(history: str, field: str, back: int = 1) -> Column:
    """Field of the row ``back`` places before the current one; NULL if there is none."""
    h = F.col(history)
    return F.when(F.size(h) > back, F.get(h, F.size(h) - (back + 1))[field])


def field_values(history: str, field: str) -> Column:
    """One field of the history as an array, oldest first, NULLs kept."""
    return F.transform(F.col(history), lambda x: x[field])
