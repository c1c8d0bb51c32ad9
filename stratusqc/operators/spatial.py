"""Neighbour search and same-instant comparison."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratusqc.constants import NEIGHBOR_K, NEIGHBOR_MAX_KM, VARIABLES
from stratusqc.functions.geo import cartesian, chord
from stratusqc.functions.rules import finite
from stratusqc.functions.spatial import spatial_confidence, spatial_delta, spatial_reason, spatial_z

GRID_LEVELS = 18


def knn_stations(
    stations: DataFrame,
    k: int = NEIGHBOR_K,
    max_km: float = NEIGHBOR_MAX_KM,
    active_only: bool = False,
    levels: int = GRID_LEVELS,
) -> DataFrame:
    """The ``k`` nearest other stations within ``max_km``: station_id, neighbor_id, km, rank.

    Exact, without comparing all stations of an area. Space is cut into nested
    cubes, the largest ``max_km`` wide, each level half the one before. A station
    searches the 27 cubes around it on the level above the finest one on which
    its own cube still holds more than ``k`` places: the k-th neighbour cannot be
    farther than that cube's diagonal. Since finer cubes hold at most ``k``
    places, the number of compared pairs grows linearly, however dense an area.
    Cubes and places beyond that diagonal are left out before anything is ranked.
    Stations sharing coordinates are searched once, as one place.

    A few bytes of places become hundreds of pairs each, so the search is dealt into
    a fixed number of partitions: by its bytes, all of it would go to one task. For the
    same reason the joins are merges: Spark would take the cubes for a table small
    enough to be gathered in the driver.
    """
    parts = int(stations.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    if active_only:
        stations = stations.filter(F.col("status") == "active")
    at = ["latitude", "longitude"]
    located = finite(F.col("latitude")) & finite(F.col("longitude"))
    points = stations.select("station_id", *at).filter(located)
    # No more than k+1 stations of one place can be neighbours of anybody.
    by_id = Window.partitionBy(*at).orderBy("station_id")
    members = points.withColumn("_m", F.row_number().over(by_id)).filter(F.col("_m") <= k + 1)
    x, y, z = cartesian(F.col("latitude"), F.col("longitude"))
    places = members.filter(F.col("_m") == 1).select(
        *at, F.col("station_id").alias("first_id"), x.alias("x"), y.alias("y"), z.alias("z")
    )
    width = F.lit(float(max_km)) / F.pow(F.lit(2.0), F.col("level"))
    cube = [F.floor(F.col(c) / width).alias("c" + c) for c in "xyz"]
    keys = ["level", "cx", "cy", "cz"]
    cells = places.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).select("*", *cube)
    crowded = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > k)
    finest = (
        cells.select(*at, *keys)
        .join(crowded.drop("_n").hint("merge"), keys, "left_semi")
        .groupBy(*at)
        .agg(F.max("level").alias("own_level"))
    )
    step = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    # The diagonal of the own cube, and a hair for the rounding of distances.
    own_width = F.lit(float(max_km)) / F.pow(F.lit(2.0), F.col("own_level"))
    reach = F.coalesce(F.least(F.lit(math.sqrt(3)) * own_width, F.lit(float(max_km))), F.lit(float(max_km))) + F.lit(1e-5)

    def gap(c):
        """How far the place is from the neighbouring cube along one axis."""
        low, high = F.col("q_" + c) - F.col("c" + c) * width, (F.col("c" + c) + 1) * width - F.col("q_" + c)
        return F.when(F.col("_d" + c) < 0, low).when(F.col("_d" + c) > 0, high).otherwise(0.0)

    seekers = (
        places.join(finest.hint("merge"), at, "left")
        .withColumn("reach", reach)
        .withColumn("level", F.greatest(F.coalesce(F.col("own_level"), F.lit(0)) - 1, F.lit(0)))
        .select(*[F.col(c).alias("q_" + c) for c in (*at, "x", "y", "z")], "reach", "level", *[
            F.floor(F.col(c) / width).alias("c" + c) for c in "xyz"
        ])
        .withColumn("_dx", step)
        .withColumn("_dy", step)
        .withColumn("_dz", step)
        .filter(sum((gap(c) * gap(c) for c in "xyz"), F.lit(0.0)) <= F.col("reach") * F.col("reach"))
        .select(
            "q_latitude", "q_longitude", "q_x", "q_y", "q_z", "reach", "level",
            *[(F.col("c" + c) + F.col("_d" + c)).alias("c" + c) for c in "xyz"],
        )
        .repartition(parts, *keys)
    )
    km = chord((F.col("q_x"), F.col("q_y"), F.col("q_z")), (F.col("x"), F.col("y"), F.col("z")))
    seeker = Window.partitionBy("q_latitude", "q_longitude")
    near_places = (
        seekers.join(cells.hint("merge"), keys)
        .withColumn("km", km)
        .filter((F.col("km") <= max_km) & (F.col("km") <= F.col("reach")))
        .withColumn("_r", F.row_number().over(seeker.orderBy(F.round("km", 6), "first_id")))
        .filter(F.col("_r") <= k + 1)
        .select("q_latitude", "q_longitude", *at, "km")
    )
    candidates = (
        near_places.join(members.select(F.col("station_id").alias("neighbor_id"), *at).hint("merge"), at)
        .withColumn("_r", F.row_number().over(seeker.orderBy(F.round("km", 6), "neighbor_id")))
        .filter(F.col("_r") <= k + 1)
        .select(
            F.col("q_latitude").alias("latitude"), F.col("q_longitude").alias("longitude"), "neighbor_id", "km"
        )
    )
    own = Window.partitionBy("station_id").orderBy(F.round("km", 6), "neighbor_id")
    return (
        points.join(candidates.hint("merge"), at)
        .filter(F.col("station_id") != F.col("neighbor_id"))
        .withColumn("rank", F.row_number().over(own))
        .filter(F.col("rank") <= k)
        .select("station_id", "neighbor_id", "km", "rank")
    )


def neighbor_stats(readings: DataFrame, edges: DataFrame, variables: Sequence[str] = VARIABLES) -> DataFrame:
    """Mean, population spread and count of the neighbours' values at the same instant.

    One row per (station, instant) with ``<variable>_mean/_std/_n``; the wide
    layout shuffles each neighbour reading once instead of once per variable.
    """
    near = readings.select(F.col("station_id").alias("neighbor_id"), "ts", *variables)
    aggs = []
    for v in variables:
        usable = F.when(finite(F.col(v)), F.col(v))
        aggs += [
            F.avg(usable).alias(f"{v}_mean"),
            F.stddev_pop(usable).alias(f"{v}_std"),
            F.count(usable).alias(f"{v}_n"),
        ]
    return (
        edges.select("station_id", "neighbor_id").join(near, "neighbor_id").groupBy("station_id", "ts").agg(*aggs)
    )


def neighbor_stats_long(
    readings: DataFrame, edges: DataFrame, variables: Sequence[str] = VARIABLES
) -> DataFrame:
    """:func:`neighbor_stats` with one row per variable; unpivoted after the aggregation, not before."""
    rows = [
        F.struct(F.lit(v).alias("variable"), *[F.col(f"{v}_{s}").alias(s) for s in ("n", "mean", "std")])
        for v in variables
    ]
    return neighbor_stats(readings, edges, variables).select("station_id", "ts", F.inline(F.array(*rows)))


def neighbor_values(long: DataFrame, edges: DataFrame) -> DataFrame:
    """As :func:`neighbor_stats` for the long layout: one row per (station, instant, variable)."""
    near = long.select(F.col("station_id").alias("neighbor_id"), "ts", "variable", "value")
    usable = F.when(finite(F.col("value")), F.col("value"))
    return (
        edges.select("station_id", "neighbor_id")
        .join(near, "neighbor_id")
        .groupBy("station_id", "ts", "variable")
        .agg(
            F.count(usable).alias("n"),
            F.avg(usable).alias("mean"),
            F.stddev_pop(usable).alias("std"),
        )
    )


def same_instant_peers(long: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """All other stations at the same instant: n, mean, std per row, without a self-join.

    ``among`` holds all values to compare with (ts, variable, value), the rows of ``long`` included.

    Totals per (instant, variable) are aggregated map-side first; a row's own
    value is then taken out of them. Deviations are centred before squaring, so
    large readings do not cancel. What is left of a spread below 1e-7 of the row's
    own departure is rounding noise and counts as none.
    """
    value = F.col("value")
    totals = (long if among is None else among).filter(finite(value)).groupBy("ts", "variable").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("value").alias("_mean"), F.var_pop("value").alias("_var")
    )
    own = F.when(finite(value), value)
    off = F.coalesce(own - F.col("_mean"), F.lit(0.0))
    others = F.coalesce(F.col("_n"), F.lit(0)) - F.when(own.isNotNull(), 1).otherwise(0)
    shift = off / F.col("n")
    spread = (F.col("_var") * F.col("_n") - off * off) / F.col("n") - shift * shift
    noise = F.lit(1e-14) * off * off
    std = F.when((F.col("n") == 1) | (spread <= noise), 0.0).otherwise(F.sqrt(spread))
    return (
        long.join(totals, ["ts", "variable"], "left")
        .withColumn("n", others.cast("bigint"))
        .withColumn("mean", F.when(F.col("n") > 0, F.col("_mean") - shift))
        .withColumn("std", F.when(F.col("n") > 0, std))
        .drop("_n", "_mean", "_var")
    )


def spatial_check(
    df: DataFrame, value: str = "value", n: str = "n", mean: str = "mean", std: str = "std"
) -> DataFrame:
    """Add ``spatial_reason``, ``spatial_delta`` and ``z_score``."""
    v, m, s = F.col(value), F.col(mean), F.col(std)
    reason = spatial_reason(v, F.col(n), m, s)
    judged = reason != "SPATIAL_INSUFFICIENT_DATA"
    return df.withColumns(
        {
            "spatial_reason": reason,
            "spatial_delta": F.when(judged, spatial_delta(v, m)),
            "z_score": F.when(judged, spatial_z(v, m, s)),
        }
    )


def spatial_verdicts(long: DataFrame, edges: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """One row per present value: verdict, reason, fault and confidence of the neighbour tier.

    ``stats`` are the neighbour statistics if they are at hand, as from :func:`neighbor_stats_long`.
    """
    stats = neighbor_values(long, edges) if stats is None else stats
    linked = edges.select("station_id").distinct().withColumn("has_neighbors", F.lit(True))
    judged = spatial_check(
        long.filter(finite(F.col("value")))
        .join(stats, ["station_id", "ts", "variable"], "left")
        .join(linked, "station_id", "left")
    )
    mismatch = F.col("spatial_reason") == "SPATIAL_MISMATCH"
    has = F.coalesce(F.col("has_neighbors"), F.lit(False))
    return judged.withColumns(
        {
            "verdict": F.when(mismatch, "anomalous").otherwise("valid"),
            "fault_type": F.when(mismatch, "spatial_inconsistency"),
            "confidence": spatial_confidence(F.col("spatial_reason"), has),
        }
    ).drop("has_neighbors")
