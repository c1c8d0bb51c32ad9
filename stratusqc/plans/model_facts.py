"""What SQL can tell of the model tier: its merge branches, wordings, and counts that hold for any trained model."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratusqc import adapters as A
from stratusqc.functions.alerts import alert_message
from stratusqc.functions.merge import imputed, merged_verdict
from stratusqc.operators import evaluate as EV
from stratusqc.operators import features as FE
from stratusqc.operators import feedback as FB
from stratusqc.operators import forest as FO
from stratusqc.operators import reconstruction as RE
from stratusqc.operators.history import WEEK_SECONDS
from stratusqc.plans import modelling as M
from stratusqc.plans import oracle as O
from stratusqc.plans.registry import query
from stratusqc.session import write_and_reread

_INPUTS = """inputs AS (
  SELECT event_id, value,
    ['VALID_READING', 'VALID_READING', 'RULE_RANGE_FAIL', 'VALID_READING', 'RULE_STEP_FAIL', 'VALID_READING', 'RULE_PERSISTENCE_FAIL'][1 + event_id % 7] AS rule_reason,
    (event_id // 7) % 2 = 0 AS ml_flag, (event_id % 101) / 100.0::DOUBLE AS ml_score, (50 + event_id % 47) / 100.0::DOUBLE AS ml_confidence,
    CASE WHEN (event_id // 14) % 2 = 0 THEN 'reconstruction' ELSE 'isolation_forest' END AS ml_model,
    CASE WHEN event_id % 11 > 0 THEN (event_id % 17 - 8)::DOUBLE END AS delta_1,
    ['SPATIAL_CONSISTENT', 'SPATIAL_MISMATCH', 'SPATIAL_INSUFFICIENT_DATA'][1 + (event_id // 28) % 3] AS spatial_reason,
    event_id % 5 AS n, value * 1.25 AS mean, CASE WHEN event_id % 3 > 0 THEN (event_id % 9 - 4) * 0.5::DOUBLE END AS rolling_mean_diff
  FROM events)"""


def inputs(spark, sf):
    """Signals of all tiers made of the event's number, so that every branch of the merge occurs."""
    e = F.col("event_id")
    pick = lambda names, by: F.get(F.array(*[F.lit(x) for x in names]), by.cast("int"))
    ok = "VALID_READING"
    return A.events(spark, sf).select(
        "event_id",
        F.col("user_id").alias("station_id"),
        F.col("value"),
        pick((ok, ok, "RULE_RANGE_FAIL", ok, "RULE_STEP_FAIL", ok, "RULE_PERSISTENCE_FAIL"), e % 7).alias("rule_reason"),
        (F.floor(e / 7) % 2 == 0).alias("ml_flag"),
        (e % 101 / F.lit(100.0)).alias("ml_score"),
        ((50 + e % 47) / F.lit(100.0)).alias("ml_confidence"),
        F.when(F.floor(e / 14) % 2 == 0, "reconstruction").otherwise("isolation_forest").alias("ml_model"),
        F.when(e % 11 > 0, (e % 17 - 8).cast("double")).alias("delta_1"),
        pick(("SPATIAL_CONSISTENT", "SPATIAL_MISMATCH", "SPATIAL_INSUFFICIENT_DATA"), F.floor(e / 28) % 3).alias("spatial_reason"),
        (e % 5).alias("n"),
        (F.col("value") * 1.25).alias("mean"),
        F.when(e % 3 > 0, (e % 9 - 4) * F.lit(0.5)).alias("rolling_mean_diff"),
    )


@query(
    "merge_matrix",
    "WITH "
    + _INPUTS
    + """, told AS (
      SELECT *, spatial_reason = 'SPATIAL_CONSISTENT' AS ok, spatial_reason = 'SPATIAL_MISMATCH' AS off FROM inputs),
    numbered AS (
      SELECT *, CASE WHEN rule_reason = 'RULE_RANGE_FAIL' THEN '1' WHEN rule_reason = 'RULE_PERSISTENCE_FAIL' THEN '2'
        WHEN rule_reason = 'RULE_STEP_FAIL' THEN CASE WHEN ok THEN '3a' ELSE '3b' END
        WHEN ml_flag THEN CASE WHEN off THEN '4a' WHEN ok THEN '4b' WHEN ml_score >= 0.75 THEN '4c' ELSE '4d' END
        WHEN off THEN '5' WHEN ml_score >= 0.55 THEN CASE WHEN ok THEN '6a' ELSE '6b' END ELSE '7' END AS matrix_row FROM told)
    SELECT event_id,
      CASE WHEN matrix_row IN ('3a', '4b', '6a', '7') THEN 'valid' WHEN matrix_row IN ('4d', '6b') THEN 'suspect' ELSE 'anomalous' END AS verdict,
      CASE matrix_row WHEN '1' THEN 'spike' WHEN '2' THEN 'flatline' WHEN '3a' THEN 'plausible_extreme' WHEN '3b' THEN 'spike'
        WHEN '4a' THEN CASE WHEN abs(coalesce(delta_1, 0)) < 4 THEN 'drift' ELSE 'spike' END WHEN '4b' THEN 'plausible_extreme'
        WHEN '4c' THEN 'drift' WHEN '4d' THEN 'drift' WHEN '5' THEN 'spatial_inconsistency' END AS fault_type,
      CASE matrix_row WHEN '1' THEN 'RULE_RANGE' WHEN '2' THEN 'RULE_FLATLINE' WHEN '3a' THEN 'SPATIAL_OVERRIDE_EXTREME' WHEN '3b' THEN 'RULE_STEP'
        WHEN '4a' THEN 'ML_AND_SPATIAL_CONFIRMED' WHEN '4b' THEN 'SPATIAL_VALIDATED_EXTREME'
        WHEN '4c' THEN CASE ml_model WHEN 'reconstruction' THEN 'ML_LSTM_AE' ELSE 'ML_ISOFOREST' END WHEN '4d' THEN 'ML_BORDERLINE'
        WHEN '5' THEN 'SPATIAL_MISMATCH' WHEN '6b' THEN 'ML_SUSPECT' ELSE 'VALID_READING' END AS reason_code,
      CASE matrix_row WHEN '1' THEN 0.99 WHEN '2' THEN 0.98 WHEN '3a' THEN 0.88 WHEN '3b' THEN 0.95 WHEN '4a' THEN least(0.98, greatest(ml_confidence, 0.88))
        WHEN '4b' THEN 0.92 WHEN '4c' THEN ml_confidence WHEN '4d' THEN 0.65 WHEN '5' THEN 0.92 WHEN '6a' THEN 0.95 WHEN '6b' THEN 0.60 ELSE 1.0 END::DOUBLE AS confidence
    FROM numbered""",
)
def merge_matrix(spark, sf):
    """All twelve rows of the decision table, the model's among them."""
    names = ("rule_reason", "ml_flag", "ml_score", "ml_confidence", "ml_model", "delta_1", "spatial_reason")
    return inputs(spark, sf).select("event_id", merged_verdict(*[F.col(c) for c in names]).alias("m")).select("event_id", "m.*")


@query(
    "impute_both_ways",
    "WITH "
    + _INPUTS
    + """ SELECT event_id,
      CASE WHEN n >= 2 THEN round_even(CAST(round(mean, 6) AS DECIMAL(18, 6)), 2)
        WHEN rolling_mean_diff IS NOT NULL THEN round_even(CAST(round(value - rolling_mean_diff, 6) AS DECIMAL(18, 6)), 2) END::DOUBLE AS corrected_value,
      CASE WHEN n >= 2 THEN 'spatial_kdtree_neighbors' WHEN rolling_mean_diff IS NOT NULL THEN 'temporal_rolling_baseline' END AS method,
      CASE WHEN n >= 2 THEN 0.94 WHEN rolling_mean_diff IS NOT NULL THEN 0.82 END::DOUBLE AS confidence
    FROM inputs""",
)
def impute_both_ways(spark, sf):
    """Neighbours' mean, else the sensor's own rolling mean, else nothing."""
    told = imputed(F.col("value"), F.col("n"), F.col("mean"), F.col("rolling_mean_diff"))
    return inputs(spark, sf).select("event_id", told.alias("i")).select("event_id", "i.*")


@query(
    "alert_wording",
    "WITH "
    + O.VERDICTS
    + """, graded AS (
      SELECT v.*, """
    + O.SEVERITY
    + """ AS severity, (qc_id % 400) / 4.0::DOUBLE AS x, CAST(round(confidence * 100) AS INTEGER) AS percent FROM verdicts v WHERE verdict <> 'valid'),
    shown AS (SELECT *, CASE WHEN qc_id % 13 = 0 THEN 'None' ELSE CAST(x AS VARCHAR) END AS shown_x FROM graded)
    SELECT qc_id, concat('[', upper(severity), '] Station ', station_id, ' (ST', station_id, ') - ', upper(variable[1]), variable[2:], ': ',
      CASE reason_code
        WHEN 'RULE_RANGE' THEN concat('Sensor value ', shown_x, ' breached physical bounds (Confidence: ', percent, '%).')
        WHEN 'RULE_FLATLINE' THEN concat('Sensor stuck / persistent flatline detected (', CASE WHEN qc_id % 13 = 0 THEN 6 ELSE 3 + qc_id % 4 END, ' identical readings at ', shown_x, ').')
        WHEN 'RULE_STEP' THEN concat('Sudden implausible rate-of-change jump (+', shown_x, ') without regional confirmation.')
        WHEN 'ML_AND_SPATIAL_CONFIRMED' THEN concat('Calibration drift confirmed by both ML reconstruction error and neighboring AWS deviation (Confidence: ', percent, '%).')
        WHEN 'SPATIAL_MISMATCH' THEN concat('Spatial mismatch with neighboring stations (delta: ', shown_x, ', z-score: ', shown_x, ').')
        WHEN 'ML_ISOFOREST' THEN concat('Statistical anomaly flagged by Isolation Forest (anomaly score: ', shown_x, ').')
        ELSE concat('Anomalous sensor behavior detected (', reason_code, ', Confidence: ', percent, '%).') END) AS message
    FROM shown""",
)
def alert_wording(spark, sf):
    """All seven wordings, with and without the numbers that go into them."""
    x = F.when(F.col("qc_id") % 13 != 0, F.col("qc_id") % 400 / F.lit(4.0))
    flat = F.when(F.col("qc_id") % 13 != 0, 3 + F.col("qc_id") % 4)
    flagged = A.alerts(spark, sf).select(F.col("alert_id").alias("qc_id"), "severity").join(A.verdicts(spark, sf), "qc_id")
    name, code = F.concat(F.lit("Station "), "station_id"), F.concat(F.lit("ST"), "station_id")
    told = alert_message(F.col("severity"), name, code, F.col("variable"), F.col("reason_code"), F.col("confidence"), x, flat, x, x, x, x, x)
    return flagged.select("qc_id", told.alias("message"))


@query(
    "forest_facts",
    O.with_(O.LONG)
    + """SELECT variable, CAST(12 AS BIGINT) AS trees, least(count(*), 256) AS sample_size, true AS trees_are_whole, count(*) AS n_scored,
           count(*) AS n_flag_agrees, true AS share_as_asked
         FROM readings_long WHERE value IS NOT NULL GROUP BY variable HAVING count(*) >= 12""",
)
def forest_facts(spark, sf):
    """Every tree is whole (one leaf more than splits), every row scored once, flags follow decisions, and 3 % are flagged.

    Ties at the cut may leave out rows that have the same score.
    """
    rows = write_and_reread(M.training_features(spark, sf), "features")
    model = FO.fit_forest(rows, trees=12)
    leaf = F.col("feature") < 0
    trees = model.nodes.groupBy("variable", "tree").agg((F.count_if(leaf) == F.count_if(~leaf) + 1).alias("whole"))
    trees = trees.groupBy("variable").agg(F.count(F.lit(1)).alias("trees"), F.bool_and("whole").alias("trees_are_whole"))
    scored = write_and_reread(FO.score_forest(rows, model).select("variable", "decision", "ml_flag"), "scored")
    share = scored.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n_scored"),
        F.count_if(F.col("ml_flag") == (F.col("decision") < 0)).alias("n_flag_agrees"),
        F.count_if("ml_flag").alias("_below"),
        F.count_if(F.col("decision") <= 0).alias("_upto"),
    )
    wanted = F.floor((F.col("n_scored") - 1) * 0.03) + 1
    between = (F.col("_below") <= wanted) & (F.col("_upto") >= wanted - 1)
    return trees.join(model.cutoffs, "variable").join(share, "variable").select(
        "variable", "trees", F.col("sample_size").cast("long").alias("sample_size"), "trees_are_whole", "n_scored", "n_flag_agrees",
        between.alias("share_as_asked"),
    )


@query(
    "sequence_facts",
    O.with_(O.LONG)
    + """, present AS (SELECT * FROM readings_long WHERE value IS NOT NULL),
      w AS (SELECT variable, value, lag(value, 11) OVER (PARTITION BY station_id, variable ORDER BY ts) AS oldest, lag(value, 1) OVER (PARTITION BY station_id, variable ORDER BY ts) AS before FROM present),
      m AS (SELECT variable, count(*) AS n_windows, round(avg(oldest), 5) AS first_mean, round(avg(value), 5) AS last_mean, round(var_pop(oldest), 4) AS first_var,
        round(covar_pop(oldest, value), 4) AS first_last_cov, round(covar_pop(before, value), 4) AS neighbor_cov FROM w WHERE oldest IS NOT NULL GROUP BY 1),
      rows_ AS (SELECT variable, count(*) AS n_scored, count(*) AS n_flag_agrees FROM present GROUP BY 1 HAVING count(*) >= 36)
      SELECT * FROM m JOIN rows_ USING (variable)""",
)
def sequence_facts(spark, sf):
    """Moments of all windows, which the linear model is made of; every row scored once, flags following errors."""
    long = A.readings_long(spark, sf)
    windows = FE.sequence_windows(long.filter(F.col("value").isNotNull()), 12, span_seconds=WEEK_SECONDS).select("variable", "window")
    moments = RE.window_moments(windows, 12)
    model = RE.fit_reconstruction(long, k=3, length=12, span_seconds=WEEK_SECONDS)
    padded = FE.sequence_windows(long, 12, padded=True, span_seconds=WEEK_SECONDS)
    agrees = F.col("ml_flag") == (F.col("error") > F.col("threshold"))
    scored = RE.score_reconstruction(padded, model).groupBy("variable").agg(F.count(F.lit(1)).alias("n_scored"), F.count_if(agrees).alias("n_flag_agrees"))
    last = 12 * 13 // 2 - 1  # pairs are listed row by row of the upper triangle
    return moments.join(scored, "variable").select(
        "variable", "n_windows", "n_scored", "n_flag_agrees",
        F.round(F.get("center", F.lit(0)), 5).alias("first_mean"),
        F.round(F.get("center", F.lit(11)), 5).alias("last_mean"),
        F.round(F.get("cov", F.lit(0)), 4).alias("first_var"),
        F.round(F.get("cov", F.lit(11)), 4).alias("first_last_cov"),
        F.round(F.get("cov", F.lit(last - 1)), 4).alias("neighbor_cov"),
    )


@query(
    "evaluation_facts",
    M._LABELQ
    + """, c AS (SELECT fault_type, count(*) AS n_rows, count(*) FILTER (WHERE is_anomalous) AS ground_truth_count FROM scored_rows GROUP BY 1)
      SELECT fault_type, n_rows AS n_by_forest, n_rows AS n_by_sequence, ground_truth_count, n_rows AS n_in_confusion, true AS recalls_fit FROM c""",
)
def evaluation_facts(spark, sf):
    """Both models judge every labelled row once, and the evaluation counts each under its fault."""
    long = A.readings_long(spark, sf)
    forest = M.fitted_forest(spark, sf, trees=12)
    sequence = RE.fit_reconstruction(long, k=3, length=12, span_seconds=WEEK_SECONDS)
    rows = write_and_reread(EV.evaluated_rows(M.labelled(spark, sf), "temperature"), "labelled")
    seen = FE.value_series(rows, 20, WEEK_SECONDS)
    a = FO.score_forest(FE.add_features(seen, ddof=0), forest).select("reading_id", "is_anomalous", "fault_type", F.col("ml_flag").alias("a"))
    b = RE.score_reconstruction(FE.sequence_windows(rows, 12, padded=True, span_seconds=WEEK_SECONDS), sequence)
    both = write_and_reread(a.join(b.select("reading_id", F.col("ml_flag").alias("b")), "reading_id", "full"), "both")
    judged = both.groupBy("fault_type").agg(F.count("a").alias("n_by_forest"), F.count("b").alias("n_by_sequence"))
    counted = EV.confusion(both, "is_anomalous", "a", "fault_type")
    counted = counted.select("fault_type", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n_in_confusion"), F.col("recall").alias("_recall"))
    compared = EV.model_comparison(both, "a", "b").select("fault_type", "ground_truth_count", "recall_a")
    fit = (F.col("ground_truth_count") == 0) | (F.col("recall_a") == F.col("_recall"))
    return judged.join(counted, "fault_type").join(compared, "fault_type").select(
        "fault_type", "n_by_forest", "n_by_sequence", "ground_truth_count", "n_in_confusion", fit.alias("recalls_fit")
    )


@query(
    "retrain_facts",
    O.with_(O.LONG, O.VERDICTS, O.FEEDBACK, O.REGISTRY)
    + """, versions AS (SELECT variable, 'v1.' || (count(*) + 1) || '.0' AS next FROM registry GROUP BY 1),
      trained AS (SELECT variable, count(*) AS n FROM readings_long WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) >= 12)
      SELECT variable, coalesce(next, 'v1.1.0') AS active_version, CAST(1 AS BIGINT) AS n_active, true AS outcome_fits
      FROM trained LEFT JOIN versions USING (variable)""",
)
def retrain_facts(spark, sf):
    """After retraining every trained variable has its next version active, and an outcome whose numbers fit together."""
    long, registry = A.readings_long(spark, sf), A.registry(spark, sf)
    drawn = write_and_reread(M.samples(spark, sf), "samples")
    model, outcome = FB.retrain(long, drawn, FB.baseline_forest(long, trees=10), trees=10)
    after = FB.register_trained(registry, model)
    active = M.MO.active_models(after).groupBy("variable").agg(F.max("version").alias("active_version"), F.count(F.lit(1)).alias("n_active"))
    prior, new = F.col("prior_flagged"), F.col("new_flagged")
    fits = (F.col("eliminated") == F.greatest(prior - new, F.lit(0))) & F.col("retained_recall_pct").between(0, 100) & (F.col("reduction_pct") <= 100)
    return outcome.select("variable", fits.alias("outcome_fits")).join(active, "variable")
