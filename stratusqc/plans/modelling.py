"""Queries of features, models, labelled benchmarks, the registry and the feedback loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratusqc import adapters as A
from stratusqc.constants import FEATURES, VARIABLES
from stratusqc.functions.scoring import (
    isolation_confidence,
    isolation_flag,
    isolation_score,
    reconstruction_confidence,
    reconstruction_score,
)
from stratusqc.operators import evaluate as EV
from stratusqc.operators import faults as FA
from stratusqc.operators import feedback as FB
from stratusqc.operators import features as FE
from stratusqc.operators import forest as FO
from stratusqc.operators import model_store as MS
from stratusqc.operators import models as MO
from stratusqc.operators import qc as Q
from stratusqc.operators import quantiles as QU
from stratusqc.operators import reconstruction as RE
from stratusqc.operators import recurrent as RC
from stratusqc.operators import shapley as SH
from stratusqc.operators import spatial as S
from stratusqc.operators.history import WEEK_SECONDS
from stratusqc.plans import oracle as O
from stratusqc.plans.registry import query, stamp
from stratusqc.session import scratch_dir, write_and_reread

_ANGLE = "2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24.0"
_FEATURES = f"""
present AS (SELECT * FROM readings_long WHERE value IS NOT NULL),
features AS (
  SELECT reading_id, station_id, ts, variable, value, coalesce(value - lag(value) OVER w, 0.0) AS delta_1,
         value - avg(value) OVER w6 AS rolling_mean_diff, coalesce(stddev_samp(value) OVER w6, 0.0) AS rolling_std,
         sin({_ANGLE}) AS hour_sin, cos({_ANGLE}) AS hour_cos
  FROM present
  WINDOW w AS (PARTITION BY station_id, variable ORDER BY ts),
         w6 AS (PARTITION BY station_id, variable ORDER BY ts ROWS 5 PRECEDING))"""
_SERVING = f"""
seen AS (
  SELECT *, list(value) FILTER (WHERE value IS NOT NULL) OVER (PARTITION BY station_id, variable ORDER BY ts ROWS 20 PRECEDING) AS s
  FROM readings_long),
serving AS (
  SELECT reading_id, station_id, ts, variable, value, CASE WHEN len(s) > 1 THEN value - s[-2] ELSE 0.0 END AS delta_1,
         value - list_avg(s[-6:]) AS rolling_mean_diff, list_stddev_pop(s[-6:]) AS rolling_std,
         sin({_ANGLE}) AS hour_sin, cos({_ANGLE}) AS hour_cos
  FROM seen WHERE value IS NOT NULL)"""


def _rounded(columns, digits=6):
    return [F.round(c, digits).alias(c) for c in columns]


def _sql_rounded(columns, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def training_features(spark, sf):
    return FE.series_features(A.readings_long(spark, sf), span_seconds=WEEK_SECONDS)


@query("series_features", O.with_(O.LONG, _FEATURES) + f"SELECT reading_id, variable, {_sql_rounded(FEATURES)} FROM features")
def series_features(spark, sf):
    return training_features(spark, sf).select("reading_id", "variable", *_rounded(FEATURES))


@query("serving_features", O.with_(O.LONG, _SERVING) + f"SELECT reading_id, variable, {_sql_rounded(FEATURES)} FROM serving")
def serving_features(spark, sf):
    return FB.serving_features(A.readings(spark, sf), VARIABLES, span_seconds=WEEK_SECONDS).select(
        "reading_id", "variable", *_rounded(FEATURES)
    )


_Z = """
fitted AS (SELECT variable, %s FROM features GROUP BY 1),
scaled AS (SELECT f.*, %s FROM features f JOIN fitted USING (variable))""" % (
    ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in FEATURES),
    ", ".join(f"({c} - {c}_m) / CASE WHEN {c}_s > 0 THEN {c}_s ELSE 1.0 END AS {c}_z" for c in FEATURES),
)
_ZNAMES = [f"{c}_z" for c in FEATURES]


@query(
    "standardize", O.with_(O.LONG, _FEATURES, _Z) + f"SELECT reading_id, variable, {_sql_rounded(_ZNAMES)} FROM scaled"
)
def standardize(spark, sf):
    features = training_features(spark, sf)
    return FE.standardize(features, FE.fit_scaler(features)).select("reading_id", "variable", *_rounded(_ZNAMES))


_TOTAL = " + ".join(f"abs({c}_z)" for c in FEATURES) + " + 1e-6"


@query(
    "attribution",
    O.with_(O.LONG, _FEATURES, _Z)
    + f""", shares AS (SELECT reading_id, variable, {", ".join(f"round(abs({c}_z) / ({_TOTAL}), 4) AS {c}_share" for c in FEATURES)} FROM scaled)
      SELECT *, CASE {" ".join(f"WHEN {c}_share = greatest({', '.join(f'{d}_share' for d in FEATURES)}) THEN '{c}'" for c in FEATURES)} END AS primary_driver FROM shares""",
)
def attribution(spark, sf):
    features = training_features(spark, sf)
    return FE.attribution(FE.standardize(features, FE.fit_scaler(features))).select(
        "reading_id", "variable", *[f"{c}_share" for c in FEATURES], "primary_driver"
    )


@query(
    "sequence_windows",
    O.with_(O.LONG)
    + """, w AS (SELECT reading_id, variable, list(value) OVER (PARTITION BY station_id, variable ORDER BY ts ROWS 11 PRECEDING) AS s
           FROM readings_long WHERE value IS NOT NULL)
         SELECT reading_id, variable, round(s[1], 6) AS oldest, round(s[12], 6) AS newest, round(list_sum(s), 6) AS total FROM w WHERE len(s) = 12""",
)
def sequence_windows(spark, sf):
    w = FE.sequence_windows(A.readings_long(spark, sf), 12, span_seconds=WEEK_SECONDS)
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x)
    return w.select(
        "reading_id",
        "variable",
        F.round(F.get("window", F.lit(0)), 6).alias("oldest"),
        F.round(F.get("window", F.lit(11)), 6).alias("newest"),
        F.round(total, 6).alias("total"),
    )


@query(
    "padded_window",
    O.with_(O.LONG)
    + """, w AS (SELECT reading_id, variable, list(value) OVER (PARTITION BY station_id, variable ORDER BY ts ROWS 11 PRECEDING) AS s
           FROM readings_long WHERE value IS NOT NULL)
         SELECT reading_id, variable, round(s[1], 6) AS oldest, round(s[-1], 6) AS newest,
           round(list_sum(s) + (12 - len(s)) * s[1], 6) AS total FROM w""",
)
def padded_window(spark, sf):
    w = FE.sequence_windows(A.readings_long(spark, sf), 12, padded=True, span_seconds=WEEK_SECONDS)
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x)
    return w.select(
        "reading_id",
        "variable",
        F.round(F.get("window", F.lit(0)), 6).alias("oldest"),
        F.round(F.get("window", F.lit(11)), 6).alias("newest"),
        F.round(total, 6).alias("total"),
    )


@query(
    "row_position",
    O.with_(O.READINGS)
    + "SELECT reading_id, row_number() OVER (PARTITION BY station_id ORDER BY ts) - 1 AS pos FROM readings",
)
def row_position(spark, sf):
    return FA.row_position(A.readings(spark, sf)).select("reading_id", F.col("pos").cast("bigint").alias("pos"))


@query(
    "error_threshold",
    O.with_(O.LONG, _FEATURES)
    + """, errors AS (SELECT variable, rolling_mean_diff * rolling_mean_diff AS error FROM features),
         q AS (SELECT variable, quantile_cont(error, 0.98) AS p, avg(error) AS mean, stddev_pop(error) AS std FROM errors GROUP BY 1)
         SELECT variable, round(CASE WHEN p < mean + 2.0 * std THEN mean + 2.5 * std ELSE p END, 5) AS threshold, round(mean, 5) AS mean, round(std, 5) AS std FROM q""",
)
def error_threshold(spark, sf):
    errors = training_features(spark, sf).select(
        "variable", (F.col("rolling_mean_diff") * F.col("rolling_mean_diff")).alias("error")
    )
    return QU.error_threshold(errors).select("variable", *_rounded(["threshold", "mean", "std"], 5))


@query(
    "exact_quantile",
    "SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.98), 6) AS quantile FROM lineitem GROUP BY 1",
)
def exact_quantile(spark, sf):
    df = QU.exact_quantile(A.table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", 0.98)
    return df.select("l_returnflag", "n", F.round("quantile", 6).alias("quantile"))


_DECISION = "(120 - value) / 400.0::DOUBLE"


@query(
    "isolation_score",
    f"""WITH d AS (SELECT event_id, {_DECISION} AS d FROM events)
        SELECT event_id, d < 0.05 AS ml_flag, round(1 / (1 + exp(10 * (d - 0.05))), 6) AS ml_score,
          round_even(CAST(round(least(0.99, greatest(0.5, 0.5 + abs(d))), 9) AS DECIMAL(18, 9)), 2)::DOUBLE AS ml_confidence FROM d""",
)
def isolation_score_query(spark, sf):
    d, t = (F.lit(120) - F.col("value")) / F.lit(400.0), F.lit(0.05)
    return A.events(spark, sf).select(
        "event_id",
        isolation_flag(d, t).alias("ml_flag"),
        F.round(isolation_score(d, t), 6).alias("ml_score"),
        isolation_confidence(d).alias("ml_confidence"),
    )


@query(
    "reconstruction_score",
    """WITH e AS (SELECT event_id, value / 100.0::DOUBLE AS e FROM events)
       SELECT event_id, e > 0.8 AS ml_flag, round(1 / (1 + exp(-5 * (e / (0.8 + 1e-6) - 1))), 6) AS ml_score,
         round_even(CAST(round(least(0.99, greatest(0.5, 0.5 + 0.49 * least(1.0, e / (0.8 + 1e-6)))), 9) AS DECIMAL(18, 9)), 2)::DOUBLE AS ml_confidence FROM e""",
)
def reconstruction_score_query(spark, sf):
    e, t = F.col("value") / F.lit(100.0), F.lit(0.8)
    return A.events(spark, sf).select(
        "event_id",
        (e > t).alias("ml_flag"),
        F.round(reconstruction_score(e, t), 6).alias("ml_score"),
        reconstruction_confidence(e, t).alias("ml_confidence"),
    )


@query(
    "ml_only_verdict",
    O.with_(O.LONG, _SERVING)
    + """SELECT reading_id, variable, CASE WHEN value > 90 THEN 'anomalous' ELSE 'valid' END AS verdict, 'ML_ISOFOREST' AS reason_code,
         CASE WHEN value > 90 AND abs(delta_1) > 5 THEN 'spike' WHEN value > 90 THEN 'drift' END AS fault_type FROM serving""",
)
def ml_only_verdict(spark, sf):
    """Verdict rows of the model tier alone; a fixed limit stands in for the forest's flag."""
    rows = FB.serving_features(A.readings(spark, sf), VARIABLES, span_seconds=WEEK_SECONDS)
    flagged = rows.withColumn("ml_flag", F.col("value") > 90).withColumn("ml_confidence", F.lit(0.7))
    return FO.ml_verdicts(flagged).select("reading_id", "variable", "verdict", "reason_code", "fault_type")


def fitted_forest(spark, sf, trees=100):
    return FO.fit_forest(write_and_reread(training_features(spark, sf), "features"), trees=trees)


@query("isolation_forest_fit")
def isolation_forest_fit(spark, sf):
    nodes = fitted_forest(spark, sf).nodes
    return nodes.groupBy("variable", "tree").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("feature") < 0).alias("leaves")
    )


@query("isolation_forest_scores")
def isolation_forest_scores(spark, sf):
    model = fitted_forest(spark, sf)
    rows = FB.serving_features(A.readings(spark, sf), VARIABLES, span_seconds=WEEK_SECONDS)
    return FO.score_forest(rows, model).select(
        "reading_id", "variable", "ml_flag", F.round("ml_score", 6).alias("ml_score"), "ml_confidence"
    )


@query("reconstruction_fit")
def reconstruction_fit(spark, sf):
    model = RE.fit_reconstruction(A.readings_long(spark, sf), k=3, length=12, span_seconds=WEEK_SECONDS)
    return model.fitted.select("variable", *_rounded(["threshold", "error_mean", "error_std"]))


@query("reconstruction_scores")
def reconstruction_scores(spark, sf):
    long = A.readings_long(spark, sf)
    model = RE.fit_reconstruction(long, k=3, length=12, span_seconds=WEEK_SECONDS)
    windows = FE.sequence_windows(long, 12, padded=True, span_seconds=WEEK_SECONDS)
    return RE.score_reconstruction(windows, model).select(
        "reading_id", "variable", "ml_flag", *_rounded(["error", "ml_score"]), "ml_confidence"
    )


@query("merged_verdict_with_models")
def merged_verdict_with_models(spark, sf):
    """All four tiers: rules, isolation forest, neighbours and merge."""
    stations = A.stations(spark, sf)
    qc = Q.merged_verdicts(
        A.readings(spark, sf),
        stations,
        S.knn_stations(stations),
        scorer=FO.forest_scorer(fitted_forest(spark, sf)),
        span_seconds=WEEK_SECONDS,
    )
    return qc.select("qc_id", "verdict", "fault_type", "reason_code", "confidence", "impute_method", "ml_model_version")


@query(
    "model_select",
    O.with_(O.VERDICTS)
    + """SELECT reading_id, variable, CASE WHEN qc_id % 3 = 0 THEN value > 80 WHEN qc_id % 2 = 0 THEN value > 95 ELSE false END AS ml_flag,
         CASE WHEN qc_id % 3 = 0 THEN 0.8 WHEN qc_id % 2 = 0 THEN 0.6 ELSE 0.0 END::DOUBLE AS ml_score,
         CASE WHEN qc_id % 3 = 0 OR qc_id % 2 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS ml_confidence,
         CASE WHEN qc_id % 3 = 0 THEN 'reconstruction' WHEN qc_id % 2 = 0 THEN 'isolation_forest' END AS ml_model FROM verdicts""",
)
def model_select(spark, sf):
    rows = A.verdicts(spark, sf)

    def scored(condition, limit, score, model):
        return rows.filter(condition).select(
            "reading_id", "variable", (F.col("value") > limit).alias("ml_flag"), F.lit(score).alias("ml_score"),
            F.lit(0.9).alias("ml_confidence"), F.lit(model).alias("ml_model"), F.lit("v1").alias("ml_model_version"),
        )

    sequence = scored("qc_id % 3 = 0", 80, 0.8, "reconstruction")
    forest = scored("qc_id % 2 = 0", 95, 0.6, "isolation_forest")
    return MO.model_select(rows.select("reading_id", "variable"), sequence, forest).drop("ml_model_version")


# Labelled benchmark: every station gets the fault of its group.
_LABELLED = """
positioned AS (
  SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY station_id) AS n,
         station_id % 5 AS kind FROM readings),
faulty AS (
  SELECT p.reading_id, p.station_id, p.ts,
         CASE WHEN kind = 0 AND pos BETWEEN 10 AND 17 THEN f.first_t WHEN kind = 1 AND pos = 16 THEN temperature + 18
              WHEN kind = 3 AND pos BETWEEN 12 AND 35 THEN temperature + CASE WHEN least(24, n - 12) > 1 THEN 10.0::DOUBLE * (pos - 12) / (least(24, n - 12) - 1) ELSE 0.0 END
              WHEN kind = 4 AND pos BETWEEN 18 AND 23 THEN NULL ELSE temperature END AS temperature,
         CASE WHEN kind = 2 AND pos = 20 THEN humidity - 40 ELSE humidity END AS humidity,
         CASE WHEN kind = 0 AND pos BETWEEN 10 AND 17 THEN 'flatline' WHEN kind = 1 AND pos = 16 THEN 'spike' WHEN kind = 2 AND pos = 20 THEN 'spike'
              WHEN kind = 3 AND pos BETWEEN 12 AND 35 THEN 'drift' WHEN kind = 4 AND pos BETWEEN 18 AND 23 THEN 'dropout' ELSE 'valid' END AS fault_type,
         CASE WHEN kind = 2 AND pos = 20 THEN 'humidity' WHEN (kind = 0 AND pos BETWEEN 10 AND 17) OR (kind = 1 AND pos = 16)
              OR (kind = 3 AND pos BETWEEN 12 AND 35) OR (kind = 4 AND pos BETWEEN 18 AND 23) THEN 'temperature' END AS fault_variable
  FROM positioned p LEFT JOIN (SELECT station_id, temperature AS first_t FROM positioned WHERE pos = 10) f USING (station_id)),
scored_rows AS (
  SELECT *, fault_type <> 'valid' AS is_anomalous FROM faulty
  WHERE coalesce(fault_variable, 'temperature') = 'temperature' AND temperature IS NOT NULL)"""
_JUDGED = """
stepped AS (
  SELECT *, lag(temperature) OVER w AS previous, row_number() OVER w AS k,
         CASE WHEN station_id % 5 = 0 THEN 6 ELSE 3 END AS persistence_max
  FROM scored_rows WINDOW w AS (PARTITION BY station_id ORDER BY ts)),
flat AS (
  SELECT a.reading_id, count(*) AS present, arg_min(b.temperature, b.k) AS first_value, max(b.temperature) AS hi, min(b.temperature) AS lo
  FROM stepped a JOIN stepped b ON a.station_id = b.station_id AND b.k BETWEEN a.k - a.persistence_max + 1 AND a.k GROUP BY 1),
peers AS (
  SELECT a.reading_id, count(b.temperature) AS n, avg(b.temperature) AS mean, stddev_pop(b.temperature) AS std
  FROM scored_rows a LEFT JOIN faulty b ON a.ts = b.ts AND a.station_id <> b.station_id GROUP BY 1),
judged AS (
  SELECT s.*, CASE
    WHEN temperature < CASE WHEN station_id % 5 = 0 THEN -9999 ELSE 0 END OR temperature > CASE WHEN station_id % 5 = 0 THEN 150 ELSE 200 END THEN true
    WHEN abs(temperature - previous) > CASE WHEN station_id % 5 = 0 THEN 9999 ELSE 120 END
      THEN NOT (p.n >= 2 AND NOT (abs(temperature - mean) / greatest(std, 1.0) >= 3 AND abs(temperature - mean) >= 3.5))
    WHEN f.present = s.persistence_max AND hi - first_value < 1e-5 AND first_value - lo < 1e-5 THEN true
    ELSE p.n >= 2 AND abs(temperature - mean) / greatest(std, 1.0) >= 3 AND abs(temperature - mean) >= 3.5 END AS predicted
  FROM stepped s JOIN flat f USING (reading_id) JOIN peers p USING (reading_id))"""


def _metrics(truth: str, pred: str) -> str:
    tp, fp = f"count(*) FILTER (WHERE {truth} AND {pred})", f"count(*) FILTER (WHERE NOT {truth} AND {pred})"
    fn, tn = f"count(*) FILTER (WHERE {truth} AND NOT {pred})", f"count(*) FILTER (WHERE NOT {truth} AND NOT {pred})"
    return f"{tp} AS tp, {fp} AS fp, {fn} AS fn, {tn} AS tn"


_CONFUSION = """SELECT tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 4) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 4) AS recall,
  round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1 FROM m"""
_LABELQ = O.with_(O.READINGS, _LABELLED)


def labelled(spark, sf):
    readings = A.readings(spark, sf)
    kinds = F.array(*[F.lit(k) for k in FA.BENCHMARK])
    plan = A.stations(spark, sf).select("station_id", F.get(kinds, (F.col("station_id") % 5).cast("int")).alias("kind"))
    return FA.labelled_benchmark(readings, plan)


@query(
    "labelled_benchmark",
    _LABELQ + "SELECT reading_id, round(temperature, 6) AS temperature, round(humidity, 6) AS humidity, fault_type, fault_variable, fault_type <> 'valid' AS is_anomalous FROM faulty",
)
def labelled_benchmark(spark, sf):
    return labelled(spark, sf).select(
        "reading_id", *_rounded(["temperature", "humidity"]), "fault_type", "fault_variable", "is_anomalous"
    )


def _injected(name: str, hit: str, changed: str, run, extra: str = ""):
    """Register one injector with its SQL twin on all stations."""

    def fn(spark, sf):
        return run(A.readings(spark, sf)).select(
            "reading_id", F.round("temperature", 6).alias("temperature"), "is_anomalous", "fault_type"
        )

    sql = O.with_(O.READINGS) + f""", positioned AS (
      SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY station_id) AS n FROM readings),
      firsts AS (SELECT station_id, temperature AS first_t FROM positioned WHERE pos = 12)
      SELECT reading_id, round(CASE WHEN {hit} THEN {changed} ELSE temperature END, 6) AS temperature, ({hit}) AS is_anomalous,
        CASE WHEN {hit} THEN '{name.split("_")[1]}' ELSE 'valid' END AS fault_type
      FROM positioned LEFT JOIN firsts USING (station_id) {extra}"""
    query(name, sql)(fn)


_injected("inject_flatline", "pos BETWEEN 12 AND 19", "first_t", FA.inject_flatline)
_injected("inject_spike", "pos = 15", "temperature + 16.0", FA.inject_spike)
_injected(
    "inject_drift",
    "pos BETWEEN 10 AND 33",
    "temperature + CASE WHEN least(24, n - 10) > 1 THEN 9.0::DOUBLE * (pos - 10) / (least(24, n - 10) - 1) ELSE 0 END",
    FA.inject_drift,
)
_injected("inject_dropout", "false", "NULL", FA.inject_dropout, "WHERE pos NOT BETWEEN 14 AND 19")


@query(
    "inject_spatial_inconsistency",
    O.with_(O.READINGS)
    + """, positioned AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY ts) - 1 AS pos FROM readings)
         SELECT reading_id, round(temperature + CASE WHEN station_id = 3 AND pos BETWEEN 15 AND 19 THEN 14.0 ELSE 0 END, 6) AS temperature,
           (station_id = 3 AND pos BETWEEN 15 AND 19) AS is_anomalous FROM positioned""",
)
def inject_spatial_inconsistency(spark, sf):
    return FA.inject_spatial_inconsistency(A.readings(spark, sf), 3).select(
        "reading_id", F.round("temperature", 6).alias("temperature"), "is_anomalous"
    )


@query(
    "inject_regional_event",
    O.with_(O.READINGS)
    + """, b AS (SELECT min(ts) + INTERVAL 12 HOUR AS t0 FROM readings)
         SELECT reading_id, round(temperature + CASE WHEN ts >= t0 AND ts < t0 + INTERVAL 72 HOUR THEN 8.0 ELSE 0 END, 6) AS temperature,
           CASE WHEN ts >= t0 AND ts < t0 + INTERVAL 72 HOUR THEN 'plausible_extreme' ELSE 'valid' END AS fault_type, false AS is_anomalous
         FROM readings, b""",
)
def inject_regional_event(spark, sf):
    return FA.inject_regional_event(A.readings(spark, sf), hours=72).select(
        "reading_id", F.round("temperature", 6).alias("temperature"), "fault_type", "is_anomalous"
    )


@query(
    "confusion_metrics",
    _LABELQ + f", m AS (SELECT {_metrics('is_anomalous', '(temperature > 80)')} FROM scored_rows) " + _CONFUSION,
)
def confusion_metrics(spark, sf):
    rows = EV.evaluated_rows(labelled(spark, sf), "temperature")
    return EV.confusion(rows.withColumn("predicted", F.col("value") > 80))


_FAULTS = """SELECT fault_type, count(*) AS total_injected, count(*) FILTER (WHERE {p}) AS detected, count(*) FILTER (WHERE NOT {p}) AS missed,
  round(count(*) FILTER (WHERE {p})::DOUBLE / count(*), 4) AS recall FROM {t} WHERE fault_type <> 'valid' GROUP BY 1"""


@query("per_fault_recall", _LABELQ + _FAULTS.format(p="(temperature > 80)", t="scored_rows"))
def per_fault_recall(spark, sf):
    rows = EV.evaluated_rows(labelled(spark, sf), "temperature")
    return EV.per_fault_recall(rows.withColumn("predicted", F.col("value") > 80))


@query(
    "model_comparison",
    _LABELQ
    + """, c AS (SELECT fault_type, count(*) FILTER (WHERE is_anomalous) AS g, count(*) FILTER (WHERE is_anomalous AND temperature > 90) AS a,
           count(*) FILTER (WHERE is_anomalous AND temperature > 50) AS b FROM scored_rows GROUP BY 1),
         r AS (SELECT fault_type, g, CASE WHEN g > 0 THEN round(a::DOUBLE / g, 4) ELSE 1.0 END AS ra, CASE WHEN g > 0 THEN round(b::DOUBLE / g, 4) ELSE 1.0 END AS rb FROM c)
         SELECT fault_type, g AS ground_truth_count, ra AS recall_a, rb AS recall_b, round((rb - ra) * 100, 1) AS gain_points,
           fault_type = 'drift' AND rb > ra AS wins_on_drift FROM r""",
)
def model_comparison(spark, sf):
    rows = EV.evaluated_rows(labelled(spark, sf), "temperature")
    flags = rows.withColumn("a", F.col("value") > 90).withColumn("b", F.col("value") > 50)
    return EV.model_comparison(flags, "a", "b")


def judged_benchmark(spark, sf):
    return EV.merged_predictions(labelled(spark, sf), A.stations(spark, sf), span_seconds=WEEK_SECONDS)


@query(
    "evaluate_merged",
    O.with_(O.READINGS, _LABELLED, _JUDGED) + f", m AS (SELECT {_metrics('is_anomalous', 'predicted')} FROM judged) " + _CONFUSION,
)
def evaluate_merged(spark, sf):
    return EV.confusion(judged_benchmark(spark, sf))


@query(
    "evaluate_merged_per_fault",
    O.with_(O.READINGS, _LABELLED, _JUDGED) + _FAULTS.format(p="predicted", t="judged"),
)
def evaluate_merged_per_fault(spark, sf):
    return EV.per_fault_recall(judged_benchmark(spark, sf))


@query("evaluate_forest")
def evaluate_forest(spark, sf):
    """Forest trained on clean readings, measured on the labelled ones."""
    model = fitted_forest(spark, sf)
    rows = EV.evaluated_rows(labelled(spark, sf), "temperature")
    seen = FE.value_series(rows, 20, WEEK_SECONDS)
    scored = FO.score_forest(FE.add_features(seen, ddof=0), model)
    return EV.confusion(scored.withColumn("predicted", F.col("ml_flag")))


@query("compare_models")
def compare_models(spark, sf):
    """Forest and sequence model side by side on the labelled readings."""
    long = A.readings_long(spark, sf)
    forest = fitted_forest(spark, sf)
    sequence = RE.fit_reconstruction(long, k=3, length=12, span_seconds=WEEK_SECONDS)
    rows = EV.evaluated_rows(labelled(spark, sf), "temperature")
    seen = FE.value_series(rows, 20, WEEK_SECONDS)
    a = FO.score_forest(FE.add_features(seen, ddof=0), forest).select(
        "reading_id", "is_anomalous", "fault_type", F.col("ml_flag").alias("a")
    )
    windows = FE.sequence_windows(rows, 12, padded=True, span_seconds=WEEK_SECONDS)
    b = RE.score_reconstruction(windows, sequence).select("reading_id", F.col("ml_flag").alias("b"))
    return EV.model_comparison(a.join(b, "reading_id"), "a", "b")


@query(
    "active_models",
    O.with_(O.REGISTRY)
    + f"""SELECT variable, model_id, version, {O.stamp('activated_at')} AS activated_at FROM registry WHERE activated_at IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY variable ORDER BY registry.activated_at DESC, model_id DESC) = 1""",
)
def active_models(spark, sf):
    return MO.active_models(A.registry(spark, sf)).select(
        "variable", "model_id", "version", stamp("activated_at").alias("activated_at")
    )


@query(
    "registry_rollback",
    O.with_(O.REGISTRY)
    + """, again AS (SELECT * REPLACE (CASE WHEN model_id = 21 THEN TIMESTAMP '2030-01-01 00:00:00' ELSE activated_at END AS activated_at) FROM registry),
         best AS (SELECT model_id FROM again WHERE activated_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY variable ORDER BY activated_at DESC, model_id DESC) = 1)
         SELECT model_id, variable, model_id IN (SELECT model_id FROM best) AS is_active FROM again""",
)
def registry_rollback(spark, sf):
    """Going back to an earlier version; exactly one version per variable stays active."""
    again = MO.activate(A.registry(spark, sf), 21, "2030-01-01 00:00:00")
    return MO.with_active_flag(again).select("model_id", "variable", "is_active")


@query(
    "registry_list",
    O.with_(O.REGISTRY) + f"SELECT model_id, model_type, version, {O.stamp('trained_at')} AS trained_at FROM registry WHERE variable = 'humidity'",
)
def registry_list(spark, sf):
    return MO.registry_list(A.registry(spark, sf), "humidity").select(
        "model_id", "model_type", "version", stamp("trained_at").alias("trained_at")
    )


@query(
    "next_version",
    O.with_(O.REGISTRY) + "SELECT variable, 'v1.' || (count(*) + 1) || '.0' AS next_version FROM registry GROUP BY 1",
)
def next_version(spark, sf):
    return MO.next_version(A.registry(spark, sf))


@query(
    "feedback_pool_stats",
    O.with_(O.VERDICTS, O.FEEDBACK, O.REGISTRY)
    + """, act AS (SELECT variable, version FROM registry WHERE activated_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY variable ORDER BY activated_at DESC, model_id DESC) = 1)
         SELECT v.variable, count(*) AS total, count(*) FILTER (WHERE label = 'confirmed_fault') AS confirmed_faults,
           count(*) FILTER (WHERE label = 'false_alarm') AS false_alarms, count(*) FILTER (WHERE label = 'unsure') AS unsure,
           true AS can_retrain, coalesce(any_value(act.version), 'v1.0.0') AS active_version
         FROM feedback f JOIN verdicts v ON f.qc_result_id = v.qc_id LEFT JOIN act ON act.variable = v.variable GROUP BY 1""",
)
def feedback_pool_stats(spark, sf):
    return FB.feedback_pool_stats(A.feedback(spark, sf), A.verdicts(spark, sf), A.registry(spark, sf))


def event_readings(spark, sf):
    """Event-level readings, one sensor per row, matching the stored verdicts."""
    v = A.verdicts(spark, sf)
    return v.select(
        "reading_id",
        "station_id",
        F.col("created_at").alias("ts"),
        *[F.when(F.col("variable") == name, F.col("value")).alias(name) for name in VARIABLES],
    )


_SAMPLES = """
seen AS (
  SELECT v.*, n.name, CASE WHEN v.variable = n.name THEN v.value END AS x FROM verdicts v
  CROSS JOIN (VALUES ('temperature'), ('humidity'), ('pressure'), ('wind_speed'), ('wind_direction'), ('rainfall'), ('solar_radiation')) n(name)),
series AS (
  SELECT qc_id, name, variable, value,
    list(x) FILTER (WHERE x IS NOT NULL) OVER (PARTITION BY station_id, name ORDER BY created_at ROWS 20 PRECEDING) AS s FROM seen),
samples AS (
  SELECT f.feedback_id, f.label, q.variable, q.value, CASE WHEN len(s) > 1 THEN value - s[-2] ELSE 0.0 END AS delta_1,
    value - list_avg(s[-6:]) AS rolling_mean_diff, list_stddev_pop(s[-6:]) AS rolling_std
  FROM feedback f JOIN series q ON q.qc_id = f.qc_result_id AND q.name = q.variable)"""


def samples(spark, sf):
    return FB.feedback_samples(
        A.feedback(spark, sf), A.verdicts(spark, sf), event_readings(spark, sf), VARIABLES, span_seconds=WEEK_SECONDS
    )


@query(
    "feedback_samples",
    O.with_(O.VERDICTS, O.FEEDBACK, _SAMPLES)
    + "SELECT feedback_id, label, variable, value, round(delta_1, 6) AS delta_1, round(rolling_mean_diff, 6) AS rolling_mean_diff, round(rolling_std, 6) AS rolling_std FROM samples",
)
def feedback_samples(spark, sf):
    return samples(spark, sf).select(
        "feedback_id", "label", "variable", "value", *_rounded(["delta_1", "rolling_mean_diff", "rolling_std"])
    )


@query(
    "clean_baseline",
    O.with_(O.LONG)
    + "SELECT reading_id, variable FROM readings_long WHERE value IS NOT NULL",
)
def clean_baseline(spark, sf):
    return FB.clean_baseline(A.readings_long(spark, sf)).select("reading_id", "variable")


_CALIBRATION = """
pool AS (SELECT v.variable, f.label, (75 - v.value) / 300.0::DOUBLE AS decision FROM feedback f JOIN verdicts v ON v.qc_id = f.qc_result_id),
edges AS (SELECT variable, min(decision) FILTER (WHERE label = 'false_alarm') AS lo, max(decision) FILTER (WHERE label = 'confirmed_fault') AS hi,
            list_sort(list(decision) FILTER (WHERE label = 'false_alarm')) AS fa FROM pool GROUP BY 1),
thresholds AS (
  SELECT variable, CASE WHEN lo IS NULL THEN 0.0 WHEN hi IS NULL THEN lo - 0.002 WHEN lo > hi THEN (lo + hi) / 2
    ELSE fa[1 + CAST(floor((len(fa) - 1) * 0.25) AS INTEGER)] - 0.001 END AS threshold FROM edges)"""


def pool(spark, sf):
    judged = A.verdicts(spark, sf).select(F.col("qc_id").alias("qc_result_id"), "variable", "value")
    return A.feedback(spark, sf).join(judged, "qc_result_id").select(
        "variable", "label", ((F.lit(75) - F.col("value")) / F.lit(300.0)).alias("decision")
    )


@query(
    "calibrate_threshold",
    O.with_(O.VERDICTS, O.FEEDBACK, _CALIBRATION) + "SELECT variable, round(threshold, 6) AS threshold FROM thresholds",
)
def calibrate_threshold(spark, sf):
    return FB.calibrate_threshold(pool(spark, sf), 0.75).select("variable", F.round("threshold", 6).alias("threshold"))


@query(
    "feedback_outcome",
    O.with_(O.VERDICTS, O.FEEDBACK, _CALIBRATION)
    + """, c AS (SELECT variable, count(*) FILTER (WHERE label = 'false_alarm' AND decision < 0) AS prior, count(*) FILTER (WHERE label = 'false_alarm' AND decision < threshold) AS new_,
           count(*) FILTER (WHERE label = 'confirmed_fault') AS cf, count(*) FILTER (WHERE label = 'confirmed_fault' AND decision < threshold) AS kept
           FROM pool JOIN thresholds USING (variable) GROUP BY 1)
         SELECT variable, prior AS prior_flagged, new_ AS new_flagged, greatest(prior - new_, 0) AS eliminated,
           CASE WHEN prior > 0 THEN round((prior - new_) * 100.0::DOUBLE / prior, 1) ELSE 100.0 END AS reduction_pct,
           CASE WHEN cf > 0 THEN round(kept * 100.0::DOUBLE / cf, 1) ELSE 100.0 END AS retained_recall_pct FROM c""",
)
def feedback_outcome(spark, sf):
    p = pool(spark, sf)
    scored = p.withColumn("was_flagged", F.col("decision") < 0).join(FB.calibrate_threshold(p, 0.75), "variable")
    return FB.feedback_outcome(scored)


@query(
    "stack_training",
    O.with_(O.LONG, O.VERDICTS, O.FEEDBACK)
    + """SELECT variable, count(*) AS n FROM (
           SELECT variable FROM readings_long WHERE value IS NOT NULL
           UNION ALL SELECT v.variable FROM feedback f JOIN verdicts v ON v.qc_id = f.qc_result_id WHERE label = 'false_alarm') GROUP BY 1""",
)
def stack_training(spark, sf):
    """Baseline plus the samples that operators cleared, as used for retraining."""
    base = A.readings_long(spark, sf).filter(F.col("value").isNotNull())
    cleared = pool(spark, sf).filter("label = 'false_alarm'")
    stacked = base.select("variable", "value").unionByName(cleared.select("variable"), allowMissingColumns=True)
    return stacked.groupBy("variable").agg(F.count(F.lit(1)).alias("n"))


@query(
    "model_rollback",
    O.with_(O.LONG)
    + """SELECT variable, CASE WHEN variable IN ('temperature', 'pressure') THEN 'v1.1.0' ELSE 'v1.2.0' END AS active_version,
           CAST(1 AS BIGINT) AS n_active, CAST(2 AS BIGINT) AS n_versions, count(*) AS n_scored, count(*) AS n_as_active
         FROM readings_long WHERE value IS NOT NULL GROUP BY variable""",
)
def model_rollback(spark, sf):
    """Two trainings in a store, two variables taken back to the first; all rows scored by what is active then.

    ``n_as_active`` counts the rows whose decision is that of the version's own trees, kept aside from the training.
    """
    rows = write_and_reread(FE.series_features(FB.clean_baseline(A.readings_long(spark, sf))), "features")
    path, decisions = scratch_dir(spark, "models"), {}
    for version, seed in (("v1.1.0", 1), ("v1.2.0", 2)):
        model = FO.fit_forest(rows, trees=10, seed=seed)
        MS.ModelStore(spark, path).save_forest(model)
        scored = FO.score_forest(rows, model).select("reading_id", "variable", F.col("decision").alias("own"))
        decisions[version] = scored.withColumn("ml_model_version", F.lit(version))
    store = MS.ModelStore(spark, path)
    store.activate(MS.FOREST, {"temperature": "v1.1.0", "pressure": "v1.1.0"})
    now = MS.score_stored(rows, store.load_forest()).select("reading_id", "variable", "ml_model_version", "decision")
    own = decisions["v1.1.0"].unionByName(decisions["v1.2.0"])
    compared = now.join(own, ["reading_id", "variable", "ml_model_version"], "left")
    counts = compared.groupBy("variable", F.col("ml_model_version").alias("active_version")).agg(
        F.count(F.lit(1)).alias("n_scored"), F.count_if(F.col("decision") == F.col("own")).alias("n_as_active")
    )
    known = store.versions().groupBy("variable").agg(F.count_if("is_active").alias("n_active"), F.count(F.lit(1)).alias("n_versions"))
    return known.join(counts, "variable").select("variable", "active_version", "n_active", "n_versions", "n_scored", "n_as_active")


@query(
    "recurrent_fit",
    O.with_(O.LONG)
    + """, per_station AS (SELECT station_id, variable, count(*) AS n FROM readings_long WHERE value IS NOT NULL GROUP BY 1, 2)
         SELECT variable, CAST(sum(greatest(n - 11, 0)) AS BIGINT) AS n_windows, CAST(7225 AS BIGINT) AS n_weights, true AS loss_fell, true AS threshold_above_mean
         FROM per_station GROUP BY variable HAVING sum(n) >= 36 AND max(n) >= 12""",
)
def recurrent_fit(spark, sf):
    """The sequence autoencoder over all windows of all stations, three passes of four steps each."""
    model = RC.fit_recurrent(A.readings_long(spark, sf), epochs=3, slices=4, span_seconds=WEEK_SECONDS)
    return model.fitted.select(
        "variable", "n_windows", F.size("weights").cast("long").alias("n_weights"), (F.col("last_loss") < F.col("first_loss")).alias("loss_fell"),
        (F.col("threshold") > F.col("error_mean")).alias("threshold_above_mean"),
    )


@query(
    "tree_attribution",
    O.with_(O.LONG)
    + """SELECT variable, count(*) AS n_rows, count(*) AS n_additive, count(*) AS n_as_scored, count(*) AS n_with_driver
         FROM readings_long WHERE value IS NOT NULL GROUP BY variable HAVING count(*) >= 12""",
)
def tree_attribution(spark, sf):
    """Every row explained: values sum up to path length minus mean, and the path length is the one that scoring finds."""
    rows = write_and_reread(FE.series_features(FB.clean_baseline(A.readings_long(spark, sf))), "features")
    model = FO.fit_forest(rows, trees=8)
    told = SH.tree_attribution(rows, model)
    scaled = FE.standardize(rows, model.scaler)
    scores = FO.sample_scores(scaled, model.nodes, model.cutoffs).select("reading_id", "variable", "forest_score")
    n = F.col("sample_size").cast("double")
    usual = 2.0 * (F.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n
    joined = told.join(scores, ["reading_id", "variable"], "left").join(model.cutoffs.select("variable", "sample_size"), "variable")
    summed = sum((F.col(f"{c}_phi") for c in FEATURES), F.lit(0.0))
    close = lambda a, b: F.count_if(F.abs(a - b) < 1e-9)
    return joined.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n_rows"),
        close(summed, F.col("path_length") - F.col("expected_path")).alias("n_additive"),
        close(F.col("forest_score"), -F.pow(F.lit(2.0), -F.col("path_length") / usual)).alias("n_as_scored"),
        F.count_if(F.col("primary_driver").isin(*FEATURES)).alias("n_with_driver"),
    )


@query("retrain_job")
def retrain_job(spark, sf):
    """Retraining with feedback: outcome per variable (false alarms removed, recall kept) and the version now active."""
    long, registry = A.readings_long(spark, sf), A.registry(spark, sf)
    drawn = write_and_reread(samples(spark, sf), "samples")
    features = FB.baseline_features(long)
    model, outcome = FB.retrain(long, drawn, FB.baseline_forest(long, features=features), features=features)
    before = MO.active_models(registry).select("variable", F.col("version").alias("previous_version"))
    now = MO.active_models(FB.register_trained(registry, model)).select("variable", F.col("version").alias("active_version"))
    return outcome.join(before, "variable", "left").join(now, "variable")
