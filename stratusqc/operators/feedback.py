"""Learning from operator feedback: samples, threshold calibration, retraining."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratusqc.constants import FEATURES, HISTORY_DEPTH
from stratusqc.functions.rules import finite
from stratusqc.operators.features import add_features, series_features
from stratusqc.operators.forest import ForestModel, fit_forest, score_forest
from stratusqc.operators.history import field_values, time_span, with_history
from stratusqc.operators.models import active_models, next_version, register
from stratusqc.operators.quantiles import exact_quantile
from stratusqc.session import write_and_reread


def feedback_pool_stats(feedback: DataFrame, qc: DataFrame, registry: DataFrame) -> DataFrame:
    """Per variable: labels by kind, whether retraining is possible, and the active version."""
    label = F.col("label")
    counts = (
        feedback.join(qc.select(F.col("qc_id").alias("qc_result_id"), "variable"), "qc_result_id")
        .groupBy("variable")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(label == "confirmed_fault").alias("confirmed_faults"),
            F.count_if(label == "false_alarm").alias("false_alarms"),
            F.count_if(label == "unsure").alias("unsure"),
        )
    )
    active = active_models(registry).select("variable", F.col("version").alias("active_version"))
    return counts.join(active, "variable", "left").select(
        "*", (F.col("total") > 0).alias("can_retrain")
    ).withColumn("active_version", F.coalesce("active_version", F.lit("v1.0.0")))


def serving_features(
    readings: DataFrame, variables: Sequence[str], depth: int = HISTORY_DEPTH, span_seconds: int | None = None
) -> DataFrame:
    """Model inputs of every present value, seen with the present values of the last ``depth`` readings."""
    span = time_span("ts", span_seconds) if span_seconds else None
    wide = with_history(readings, ["station_id"], ["ts"], list(variables), depth, span=span)
    per_variable = [
        F.struct(
            F.lit(v).alias("variable"),
            F.col(v).alias("value"),
            F.when(finite(F.col(v)), F.filter(field_values("history", v), finite)).alias("series"),
        )
        for v in variables
    ]
    long = wide.select("reading_id", "station_id", "ts", F.inline(F.array(*per_variable)))
    return add_features(long.filter(finite(F.col("value"))), ddof=0)


def feedback_samples(
    feedback: DataFrame, qc: DataFrame, readings: DataFrame, variables: Sequence[str], span_seconds: int | None = None
) -> DataFrame:
    """Labelled readings with their model inputs; features are computed once by window, then joined."""
    judged = qc.select(F.col("qc_id").alias("qc_result_id"), "reading_id", "variable")
    labels = feedback.select("feedback_id", "qc_result_id", "label")
    features = serving_features(readings, variables, span_seconds=span_seconds)
    return labels.join(judged, "qc_result_id").join(features, ["reading_id", "variable"])


def clean_baseline(long: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """All present values of the training period as training rows; without bounds, of all time.

    Whole series are kept, so differences and rolling values mean the same for a fleet of any size.
    """
    rows = long.filter(finite(F.col("value")))
    if start is not None:
        rows = rows.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.filter(F.col("ts") < F.lit(end).cast("timestamp"))
    return rows


def calibrate_threshold(scores: DataFrame, target: float = 1.0) -> DataFrame:
    """Decision threshold per variable from scored samples (variable, label, decision).

    No false alarms: 0. Only false alarms: just below the lowest. Separable: midway. Otherwise
    just below the false alarm at the rank that clears the wanted share.
    """
    cleared = F.col("label") == "false_alarm"
    edges = scores.groupBy("variable").agg(
        F.min(F.when(cleared, F.col("decision"))).alias("min_fa"),
        F.max(F.when(F.col("label") == "confirmed_fault", F.col("decision"))).alias("max_cf"),
    )
    cut = exact_quantile(scores.filter(cleared), "variable", "decision", 1.0 - target).select(
        "variable", F.col("lower").alias("cut")
    )
    lowest, highest = F.col("min_fa"), F.col("max_cf")
    return edges.join(cut, "variable", "left").select(
        "variable",
        F.when(lowest.isNull(), 0.0)
        .when(highest.isNull(), lowest - 0.002)
        .when(lowest > highest, (lowest + highest) / 2)
        .otherwise(F.col("cut") - 0.001)
        .alias("threshold"),
    )


def feedback_outcome(samples: DataFrame) -> DataFrame:
    """Effect of a new threshold (variable, label, was_flagged, decision, threshold)."""
    fa, cf = F.col("label") == "false_alarm", F.col("label") == "confirmed_fault"
    below = F.col("decision") < F.col("threshold")
    counts = samples.groupBy("variable").agg(
        F.count_if(fa & F.col("was_flagged")).alias("prior_flagged"),
        F.count_if(fa & below).alias("new_flagged"),
        F.count_if(cf).alias("_cf"),
        F.count_if(cf & below).alias("_kept"),
    )
    prior, new = F.col("prior_flagged"), F.col("new_flagged")
    return counts.select(
        "variable",
        "prior_flagged",
        "new_flagged",
        F.greatest(prior - new, F.lit(0)).alias("eliminated"),
        F.when(prior > 0, F.bround((prior - new) * 100.0 / prior, 1)).otherwise(100.0).alias("reduction_pct"),
        F.when(F.col("_cf") > 0, F.bround(F.col("_kept") * 100.0 / F.col("_cf"), 1))
        .otherwise(100.0)
        .alias("retained_recall_pct"),
    )


def retrain(
    long: DataFrame,
    samples: DataFrame,
    previous: ForestModel | None = None,
    target: float = 1.0,
    version: str = "v1.1.0",
    trees: int = 100,
    features: DataFrame | None = None,
) -> tuple[ForestModel, DataFrame]:
    """Retrain on ``long`` plus all samples marked as false alarms; returns model and outcome.

    ``features`` are the :func:`baseline_features` of ``long`` if they are at hand.

    Too little data is an error (no forest for that variable), never topped up with invented rows.
    Variables without judged samples keep their threshold and have an outcome of no alarms.
    """
    base = series_features(clean_baseline(long)) if features is None else features
    columns = ["variable", "station_id", "ts", *FEATURES]
    inliers = samples.filter(F.col("label") == "false_alarm")
    training = write_and_reread(base.select(*columns).unionByName(inliers.select(*columns)), "training")
    fitted = fit_forest(training, trees=trees, version=version)
    judged = samples.filter(F.col("label").isin("false_alarm", "confirmed_fault"))
    scored = write_and_reread(score_forest(judged, fitted).select("feedback_id", "variable", "label", "decision"), "scored")
    thresholds = write_and_reread(calibrate_threshold(scored, target), "thresholds")
    before = (
        score_forest(judged, previous).select("feedback_id", F.col("ml_flag").alias("was_flagged"))
        if previous is not None
        else judged.select("feedback_id", F.lit(True).alias("was_flagged"))
    )
    outcome = feedback_outcome(scored.join(before, "feedback_id").join(thresholds, "variable"))
    trained = fitted.cutoffs.select("variable", F.col("threshold").alias("_kept"))
    whole = trained.drop("_kept").join(outcome, "variable", "left").fillna(
        {"prior_flagged": 0, "new_flagged": 0, "eliminated": 0, "reduction_pct": 100.0, "retained_recall_pct": 100.0}
    )
    cut = trained.join(thresholds, "variable", "left").select("variable", F.coalesce("threshold", "_kept").alias("threshold"))
    return fitted.with_threshold(cut, version), whole


def baseline_features(long: DataFrame) -> DataFrame:
    """Training rows of the clean baseline, written once: fitting reads them several times."""
    return write_and_reread(series_features(clean_baseline(long)), "features")


def baseline_forest(long: DataFrame, trees: int = 100, features: DataFrame | None = None) -> ForestModel:
    """The forest in use before any feedback: the clean baseline alone; ``features`` as for :func:`retrain`."""
    return fit_forest(baseline_features(long) if features is None else features, trees=trees)


def register_trained(registry: DataFrame, model: ForestModel) -> DataFrame:
    """``registry`` with one row per trained variable, under its next version and activated after all others.

    Into an empty registry models go from id 1, trained now.
    """
    last = registry.agg(F.max("model_id").alias("id"), F.max(F.greatest("trained_at", "activated_at")).alias("at")).first()
    at = F.current_timestamp() if last["at"] is None else F.lit(last["at"]) + F.expr("interval 1 second")
    row = (
        model.cutoffs.select("variable")
        .join(next_version(registry), "variable", "left")
        .select(
            (F.lit(last["id"] or 0) + F.row_number().over(Window.orderBy("variable"))).alias("model_id"),
            F.lit("isolation_forest").alias("model_type"),
            "variable",
            F.coalesce("next_version", F.lit("v1.1.0")).alias("version"),
            at.alias("trained_at"),
            at.alias("activated_at"),
        )
    )
    return write_and_reread(register(registry, row), "registry")
