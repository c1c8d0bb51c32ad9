"""Queries of the rule, neighbour and merge tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratusqc import adapters as A
from stratusqc.constants import VARIABLES
from stratusqc.functions.geo import cartesian
from stratusqc.functions.rules import could_be_flat, flatline_fails, is_circular, range_violation, step_delta, step_fails, zero_exempt
from stratusqc.operators import incremental as I
from stratusqc.operators import qc as Q
from stratusqc.operators import reshape as R
from stratusqc.operators import spatial as S
from stratusqc.operators.history import WEEK_SECONDS, earlier, field_values, time_span, with_balanced_history, with_history
from stratusqc.plans import oracle as O
from stratusqc.plans.registry import query
from stratusqc.session import scratch_dir, shuffles_removed, write_and_reread
from stratusqc.sources import sinks as SK


def long_with_limits(spark, sf):
    return R.readings_with_specs(A.readings_long(spark, sf), A.stations(spark, sf))


def variable_history(spark, sf, reduced, depth=20):
    """Long rows with limits and the column ``reduced`` makes of each variable's history at the station.

    The history is gathered once per reading in the wide layout and reduced before the join, which may have to
    shuffle: a window over long rows would sort seven times as many.
    """
    seen = with_history(A.readings(spark, sf), ["station_id"], ["ts"], list(VARIABLES), depth, span=time_span("ts", WEEK_SECONDS))
    rows = [F.struct(F.lit(v).alias("variable"), F.col(v).alias("value"), reduced(v)) for v in VARIABLES]
    return R.readings_with_specs(seen.select("reading_id", "station_id", "ts", F.inline(F.array(*rows))), A.stations(spark, sf))


def qc_rows(spark, sf):
    stations = A.stations(spark, sf)
    return Q.merged_verdicts(
        A.readings(spark, sf), stations, S.knn_stations(stations), span_seconds=WEEK_SECONDS
    )


_RULED = O.with_(O.LONG, O.STATIONS, O.SPECS, O.RULES)


@query(
    "readings_with_specs",
    O.with_(O.LONG, O.STATIONS, O.SPECS)
    + """SELECT l.reading_id, l.variable, round(value, 6) AS value, spec_min::DOUBLE AS spec_min,
         spec_max::DOUBLE AS spec_max, step_max::DOUBLE AS step_max, persistence_max
         FROM readings_long l JOIN specs USING (station_id, variable)""",
)
def readings_with_specs(spark, sf):
    return long_with_limits(spark, sf).select(
        "reading_id", "variable", F.round("value", 6).alias("value"), "spec_min", "spec_max", "step_max", "persistence_max"
    )


@query(
    "check_range",
    _RULED
    + """SELECT variable, coalesce(violation, 'ok') AS outcome, count(*) AS n, count(value) AS n_present
         FROM ruled GROUP BY 1, 2""",
)
def check_range(spark, sf):
    v = range_violation(F.col("value"), F.col("spec_min"), F.col("spec_max"))
    return (
        long_with_limits(spark, sf)
        .groupBy("variable", F.coalesce(v, F.lit("ok")).alias("outcome"))
        .agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_present"))
    )


@query(
    "check_step",
    _RULED
    + """SELECT reading_id, variable, round(delta, 6) AS delta, coalesce(delta > step_max, false) AS step_fail
         FROM ruled WHERE delta IS NOT NULL""",
)
def check_step(spark, sf):
    df = variable_history(spark, sf, lambda v: earlier("history", v).alias("previous"), 1)
    cur, prev, turn = F.col("value"), F.col("previous"), is_circular(F.col("variable"))
    return df.select(
        "reading_id",
        "variable",
        F.round(step_delta(cur, prev, turn), 6).alias("delta"),
        step_fails(cur, prev, F.col("step_max"), turn).alias("step_fail"),
    ).filter(F.col("delta").isNotNull())


@query(
    "check_persistence",
    _RULED + "SELECT reading_id, variable, flat_fail FROM ruled",
)
def check_persistence(spark, sf):
    def recent(v):
        return F.when(could_be_flat(F.col(v), earlier("history", v)), field_values("history", v)).alias("recent")

    df = variable_history(spark, sf, recent)
    flat = flatline_fails(F.col("recent"), F.col("value"), F.col("persistence_max"), zero_exempt(F.col("variable")))
    return df.select("reading_id", "variable", flat.alias("flat_fail"))


@query(
    "rule_verdict",
    _RULED
    + """SELECT reading_id, variable, rule_reason AS reason_code,
         CASE WHEN rule_reason = 'VALID_READING' THEN 'valid' ELSE 'anomalous' END AS verdict,
         CASE rule_reason WHEN 'RULE_PERSISTENCE_FAIL' THEN 'flatline' WHEN 'VALID_READING' THEN NULL ELSE 'spike' END AS fault_type,
         CASE rule_reason WHEN 'RULE_RANGE_FAIL' THEN 0.98 WHEN 'VALID_READING' THEN 1.0 ELSE 0.95 END::DOUBLE AS confidence
         FROM ruled""",
)
def rule_verdict(spark, sf):
    return Q.rule_verdicts(A.readings(spark, sf), A.stations(spark, sf), span_seconds=WEEK_SECONDS).select(
        "reading_id", "variable", "reason_code", "verdict", "fault_type", "confidence"
    )


@query(
    "rule_load_lineitem",
    """SELECT l_returnflag, l_linestatus, variable, count(*) AS n,
         count(*) FILTER (WHERE value < lo) AS below_min, count(*) FILTER (WHERE value > hi) AS above_max
       FROM (SELECT l_returnflag, l_linestatus, 'quantity' AS variable, l_quantity AS value, 5.0 AS lo, 45.0 AS hi FROM lineitem
             UNION ALL SELECT l_returnflag, l_linestatus, 'price', l_extendedprice, 2000.0, 60000.0 FROM lineitem
             UNION ALL SELECT l_returnflag, l_linestatus, 'discount', l_discount, 0.01, 0.08 FROM lineitem
             UNION ALL SELECT l_returnflag, l_linestatus, 'tax', l_tax, 0.01, 0.07 FROM lineitem) GROUP BY 1, 2, 3""",
)
def rule_load_lineitem(spark, sf):
    """Range rule over a large wide numeric table; one partial aggregation, no per-row shuffle."""
    limits = {
        "quantity": ("l_quantity", 5.0, 45.0),
        "price": ("l_extendedprice", 2000.0, 60000.0),
        "discount": ("l_discount", 0.01, 0.08),
        "tax": ("l_tax", 0.01, 0.07),
    }
    rows = [
        F.struct(F.lit(v).alias("variable"), range_violation(F.col(c), F.lit(lo), F.lit(hi)).alias("violation"))
        for v, (c, lo, hi) in limits.items()
    ]
    long = A.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.inline(F.array(*rows)))
    return long.groupBy("l_returnflag", "l_linestatus", "variable").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("violation") == "below_min").alias("below_min"),
        F.count_if(F.col("violation") == "above_max").alias("above_max"),
    )


@query(
    "station_cartesian",
    O.with_(O.STATIONS, O.KNN)
    + "SELECT station_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM xyz",
)
def station_cartesian(spark, sf):
    x, y, z = cartesian(F.col("latitude"), F.col("longitude"))
    return A.stations(spark, sf).select(
        "station_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(z, 6).alias("z")
    )


@query(
    "knn_stations",
    O.with_(O.STATIONS, O.KNN) + "SELECT station_id, neighbor_id, round(km, 6) AS km, rank FROM edges",
)
def knn_stations(spark, sf):
    return S.knn_stations(A.stations(spark, sf)).select(
        "station_id", "neighbor_id", F.round("km", 6).alias("km"), F.col("rank").cast("bigint").alias("rank")
    )


_NEAR = O.with_(O.LONG, O.STATIONS, O.KNN, O.NEIGHBORS)


@query(
    "contemporaneous_neighbors",
    O.with_(
        O.LONG,
        O.STATIONS,
        O.KNN,
        """
present AS MATERIALIZED (SELECT station_id, ts, variable, value FROM readings_long WHERE value IS NOT NULL),
sides AS MATERIALIZED (SELECT station_id, neighbor_id FROM edges),
sent AS MATERIALIZED (
  SELECT s.station_id, s.neighbor_id, p.ts, p.variable, p.value FROM sides s JOIN present p ON p.station_id = s.neighbor_id)""",
    )
    + """SELECT station_id, neighbor_id, strftime(ts, '%Y-%m-%d') AS day, variable, round(sent.value, 6) AS neighbor_value
         FROM sent JOIN present USING (station_id, ts, variable)""",
)
def contemporaneous_neighbors(spark, sf):
    long = A.readings_long(spark, sf).filter(F.col("value").isNotNull())
    edges = S.knn_stations(A.stations(spark, sf)).select("station_id", "neighbor_id")
    near = long.select(F.col("station_id").alias("neighbor_id"), "ts", "variable", F.col("value").alias("neighbor_value"))
    target = long.select("station_id", "ts", "variable")
    return (
        edges.join(near, "neighbor_id")
        .join(target, ["station_id", "ts", "variable"])
        .select(
            "station_id",
            "neighbor_id",
            F.date_format("ts", "yyyy-MM-dd").alias("day"),
            "variable",
            F.round("neighbor_value", 6).alias("neighbor_value"),
        )
    )


@query(
    "neighbor_stats",
    _NEAR
    + """SELECT station_id, strftime(ts, '%Y-%m-%d') AS day, variable, n, round(mean, 6) AS mean, round(std, 6) AS std
         FROM near""",
)
def neighbor_stats(spark, sf):
    edges = S.knn_stations(A.stations(spark, sf))
    return S.neighbor_stats_long(A.readings(spark, sf), edges).select(
        "station_id",
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        "variable",
        "n",
        F.round("mean", 6).alias("mean"),
        F.round("std", 6).alias("std"),
    )


@query(
    "same_instant_peers",
    O.with_(O.LONG)
    + """SELECT a.reading_id, a.variable, count(b.value) AS n, round(avg(b.value), 9) AS mean, round(stddev_pop(b.value), 9) AS std
         FROM readings_long a LEFT JOIN readings_long b
           ON a.ts = b.ts AND a.variable = b.variable AND a.station_id <> b.station_id
         GROUP BY 1, 2""",
)
def same_instant_peers(spark, sf):
    return S.same_instant_peers(A.readings_long(spark, sf)).select(
        "reading_id", "variable", "n", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std")
    )


_COMPARED = """judged AS (
  SELECT l.*, coalesce(n.n, 0) AS n, mean, std,
         CASE WHEN coalesce(n.n, 0) < 2 THEN 'SPATIAL_INSUFFICIENT_DATA'
              WHEN abs(value - mean) / greatest(std, 1.0) >= 3.0 AND abs(value - mean) >= 3.5 THEN 'SPATIAL_MISMATCH'
              ELSE 'SPATIAL_CONSISTENT' END AS reason_code
  FROM readings_long l LEFT JOIN near n USING (station_id, ts, variable) WHERE value IS NOT NULL)"""


@query(
    "spatial_check",
    O.with_(O.LONG, O.STATIONS, O.KNN, O.NEIGHBORS, _COMPARED)
    + """SELECT reading_id, variable, reason_code,
         CASE WHEN reason_code <> 'SPATIAL_INSUFFICIENT_DATA' THEN round(abs(value - mean), 6) END AS spatial_delta,
         CASE WHEN reason_code <> 'SPATIAL_INSUFFICIENT_DATA' THEN round(abs(value - mean) / greatest(std, 1.0), 6) END AS z_score
         FROM judged""",
)
def spatial_check(spark, sf):
    long = A.readings_long(spark, sf).filter(F.col("value").isNotNull())
    stats = S.neighbor_stats_long(A.readings(spark, sf), S.knn_stations(A.stations(spark, sf)))
    return S.spatial_check(long.join(stats, ["station_id", "ts", "variable"], "left")).select(
        "reading_id",
        "variable",
        F.col("spatial_reason").alias("reason_code"),
        F.round("spatial_delta", 6).alias("spatial_delta"),
        F.round("z_score", 6).alias("z_score"),
    )


@query(
    "spatial_verdict",
    O.with_(O.LONG, O.STATIONS, O.KNN, O.NEIGHBORS, _COMPARED)
    + """SELECT reading_id, variable, reason_code,
         CASE WHEN reason_code = 'SPATIAL_MISMATCH' THEN 'anomalous' ELSE 'valid' END AS verdict,
         CASE WHEN reason_code = 'SPATIAL_MISMATCH' THEN 'spatial_inconsistency' END AS fault_type,
         CASE WHEN station_id NOT IN (SELECT station_id FROM edges) THEN 0.50
              WHEN reason_code = 'SPATIAL_MISMATCH' THEN 0.95 ELSE 0.90 END::DOUBLE AS confidence
         FROM judged""",
)
def spatial_verdict(spark, sf):
    edges = S.knn_stations(A.stations(spark, sf))
    stats = S.neighbor_stats_long(A.readings(spark, sf), edges)
    return S.spatial_verdicts(A.readings_long(spark, sf), edges, stats).select(
        "reading_id", "variable", F.col("spatial_reason").alias("reason_code"), "verdict", "fault_type", "confidence"
    )


@query(
    "merged_verdict",
    O.with_(O.QC)
    + """SELECT qc_id, reading_id, variable, verdict, fault_type, reason_code, confidence::DOUBLE AS confidence,
         rule_reason, spatial_reason FROM qc""",
)
def merged_verdict(spark, sf):
    """The whole quality-control job: rules, neighbours and the merge table in one plan."""
    return qc_rows(spark, sf).select(
        "qc_id", "reading_id", "variable", "verdict", "fault_type", "reason_code", "confidence", "rule_reason", "spatial_reason"
    )


@query(
    "impute_value",
    O.with_(O.QC)
    + """SELECT qc_id, CASE WHEN n >= 2 THEN round_even(CAST(round(mean, 6) AS DECIMAL(18, 6)), 2) END::DOUBLE AS corrected_value,
         CASE WHEN n >= 2 THEN 'spatial_kdtree_neighbors' END AS impute_method,
         CASE WHEN n >= 2 THEN 0.94 END::DOUBLE AS impute_confidence FROM qc WHERE verdict <> 'valid'""",
)
def impute_value(spark, sf):
    return qc_rows(spark, sf).filter(F.col("verdict") != "valid").select(
        "qc_id", "corrected_value", "impute_method", "impute_confidence"
    )


@query(
    "reading_rollup",
    O.with_(O.QC)
    + """, ranked AS (
         SELECT *, row_number() OVER (PARTITION BY reading_id ORDER BY CASE verdict WHEN 'anomalous' THEN 0 ELSE 1 END,
           CASE WHEN verdict = 'anomalous' THEN qc_id ELSE -qc_id END) AS rn FROM qc)
         SELECT reading_id, verdict, CASE WHEN verdict <> 'valid' THEN coalesce(fault_type, reason_code) END AS fault_type
         FROM ranked WHERE rn = 1""",
)
def reading_rollup(spark, sf):
    return Q.reading_rollup(qc_rows(spark, sf))


@query(
    "judge_batches",
    O.with_(O.QC)
    + """SELECT qc_id, reading_id, variable, strftime(ts, '%Y-%m-%d') AS day, verdict, fault_type, reason_code, confidence::DOUBLE AS confidence,
         rule_reason, spatial_reason FROM qc""",
)
def judge_batches(spark, sf):
    """Three batches, one after the other into a store: half a month, the week behind it, and the rest with late readings."""
    readings, stations = A.readings(spark, sf), A.stations(spark, sf)
    late = (F.col("station_id") % 11 == 3) & (F.col("ts") >= "2024-01-10")
    half, week = F.col("ts") < "2024-01-16", F.col("ts") < "2024-01-23"
    store = scratch_dir(spark, "store")
    with shuffles_removed(spark):
        readings, stations = write_and_reread(readings, "readings"), write_and_reread(stations, "stations")
        edges = write_and_reread(S.knn_stations(stations), "edges")
        for chosen in (half & ~late, week & ~half & ~late, ~week | late):
            I.judge_batch(store, readings.filter(chosen), stations, edges, span_seconds=WEEK_SECONDS)
    return I.stored_verdicts(spark, store).select(
        "qc_id", "reading_id", "variable", F.date_format("created_at", "yyyy-MM-dd").alias("day"),
        "verdict", "fault_type", "reason_code", "confidence", "rule_reason", "spatial_reason",
    )


@query(
    "balanced_history",
    O.with_(O.READINGS)
    + """SELECT reading_id, round(lag(temperature) OVER w, 6) AS previous, count(*) OVER (w ROWS 20 PRECEDING) AS n_seen,
         round(coalesce(min(temperature) OVER (w ROWS 20 PRECEDING), -1), 6) AS lowest
         FROM readings WINDOW w AS (PARTITION BY station_id ORDER BY ts)""",
)
def balanced_history(spark, sf):
    """The last twenty readings of every reading, by equal shares of the rows: any station or day may hold most of them."""
    seen = with_balanced_history(A.readings(spark, sf), ["station_id"], ["ts"], ["temperature"], 20)
    return seen.select(
        "reading_id",
        F.round(earlier("history", "temperature"), 6).alias("previous"),
        F.size("history").cast("long").alias("n_seen"),
        F.round(F.coalesce(F.array_min(field_values("history", "temperature")), F.lit(-1.0)), 6).alias("lowest"),
    )


@query(
    "upsert_results",
    O.with_(O.QC)
    + """SELECT strftime(ts, '%Y-%m-%d') AS day, verdict, count(*) AS n, count(DISTINCT qc_id) AS n_keys, count(*) AS n_explained,
         CAST(sum(n) AS BIGINT) AS n_neighbors FROM qc GROUP BY 1, 2""",
)
def upsert_results(spark, sf):
    """Verdicts with their details as JSON, written, written again, and once more for a part: one row per key is kept."""
    path, rows = scratch_dir(spark, "results"), write_and_reread(Q.verdict_details(qc_rows(spark, sf)), "qc")
    for part in (rows, rows, rows.filter(F.col("qc_id") % 3 == 0)):
        SK.upsert_results(part, path)
    told = lambda field: F.get_json_object("details", field)
    return spark.read.parquet(path).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "verdict").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("qc_id").alias("n_keys"),
        F.count_if(told("$.rule.reason") == F.col("rule_reason")).alias("n_explained"),
        F.sum(F.coalesce(told("$.spatial.neighbor_count").cast("long"), F.lit(0))).alias("n_neighbors"),
    )
