"""Exact order statistics without sorting everything in one place."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratusqc.session import write_and_reread

#: Parts into which a bracket is cut when it still holds too much.
PARTS = 256


def _brackets(present: DataFrame, group: str, q: float, accuracy: int, most: int) -> DataFrame:
    """Per group a stretch of values around the wanted rank that holds about ``most`` distinct values or fewer.

    The first stretch comes from a sketch with a guaranteed rank error. While some group's holds too many values, their
    sketch cuts it into parts, and the parts that can have the rank are kept. Each round is one pass that returns one
    row per group; a round shrinks a stretch to a hundredth, so a few of them do for any number of rows.
    """
    spark, slack = present.sparkSession, 2.0 / accuracy
    low_q, high_q = max(0.0, q - slack), min(1.0, q + slack)
    rows = present.groupBy(group).agg(
        (F.min("_v") if low_q == 0.0 else F.percentile_approx("_v", low_q, accuracy)).alias("low"),
        (F.max("_v") if high_q == 1.0 else F.percentile_approx("_v", high_q, accuracy)).alias("high"),
        F.count("_v").alias("n"),
    )
    bounds = {r[group]: (r["low"], r["high"], r["n"]) for r in rows.collect()}
    kind = present.schema[group].dataType.simpleString()
    grid = F.array(*[F.lit(k / PARTS) for k in range(PARTS + 1)])
    while True:
        told = spark.createDataFrame([(g, *b) for g, b in bounds.items()], f"`{group}` {kind}, _low double, _high double, n long")
        inside = F.when(F.col("_v").between(F.col("_low"), F.col("_high")), F.col("_v"))
        held = present.join(told, group).groupBy(group).agg(
            F.count_if(F.col("_v") < F.col("_low")).alias("below"),
            F.count(inside).alias("inside"),
            F.approx_count_distinct(inside).alias("distinct"),
            F.percentile_approx(inside, grid, accuracy).alias("cuts"),
        )
        narrowed = False
        for r in held.collect():
            low, high, n = bounds[r[group]]
            if r["distinct"] <= most or low == high:
                continue
            rank = math.floor((n - 1) * q) - r["below"]
            first = max(0, math.floor((rank / r["inside"] - slack) * PARTS))
            last = min(PARTS, math.ceil(((rank + 2) / r["inside"] + slack) * PARTS))
            closer = max(low, r["cuts"][first]), min(high, r["cuts"][last])
            narrowed |= closer != (low, high)
            bounds[r[group]] = (*closer, n)
        if not narrowed:
            return told


def exact_quantile(df: DataFrame, group: str, column: str, q: float, accuracy: int = 10_000, most: int = 20_000) -> DataFrame:
    """Per group the exact ``q`` quantile: ``lower`` (order statistic) and ``quantile`` (interpolated).

    The wanted rank is bracketed round by round until a group's bracket holds about ``most`` distinct values; these are
    counted and ranked exactly. ``group`` must have few distinct values (variables, not stations).
    """
    present = df.select(group, F.col(column).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    present = write_and_reread(present, "quantile")
    bracket = _brackets(present, group, q, accuracy, most)
    position = (F.col("n") - 1) * F.lit(q)
    first = F.floor(position)
    # Values outside the bracket collapse into one entry per side, remembered by the value next to it.
    value = F.col("_v")
    zone = F.when(value < F.col("_low"), 0).when(value > F.col("_high"), 2).otherwise(1)
    counted = (
        present.join(bracket, group)
        .groupBy(group, zone.alias("_zone"), F.when(zone == 1, value).alias("_inside"))
        .agg(F.count(F.lit(1)).alias("_c"), F.first("n").alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    )
    order = Window.partitionBy(group).orderBy("_zone", "_inside")
    placed = counted.withColumn("_end", F.sum("_c").over(order)).withColumn("_start", F.col("_end") - F.col("_c"))
    second = F.least(first + 1, F.col("n") - 1)

    def at(rank):
        # Inside the bracket any row of the entry has the value; next to it only the bordering one.
        held = (F.col("_start") <= rank) & (rank < F.col("_end"))
        return F.max(F.when(held, F.when(F.col("_zone") == 2, F.col("_min")).otherwise(F.col("_max"))))

    picked = placed.groupBy(group, "n").agg(at(first).alias("lower"), at(second).alias("_upper"))
    return picked.select(
        group, "n", "lower", (F.col("lower") + (F.col("_upper") - F.col("lower")) * (position - first)).alias("quantile")
    )


def error_threshold(
    errors: DataFrame, q: float = 0.98, floor_sd: float = 2.0, lift_sd: float = 2.5, group: str = "variable"
) -> DataFrame:
    """Decision threshold of reconstruction errors: their ``q`` quantile, lifted if it is too low."""
    moments = errors.groupBy(group).agg(F.avg("error").alias("mean"), F.stddev_pop("error").alias("std"))
    joined = exact_quantile(errors, group, "error", q).join(moments, group)
    low = F.col("quantile") < F.col("mean") + F.lit(floor_sd) * F.col("std")
    return joined.select(
        group,
        F.when(low, F.col("mean") + F.lit(lift_sd) * F.col("std")).otherwise(F.col("quantile")).alias("threshold"),
        "mean",
        "std",
    )
