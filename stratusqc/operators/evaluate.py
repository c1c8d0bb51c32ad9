"""Quality of predictions on labelled readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratusqc.constants import HISTORY_DEPTH
from stratusqc.functions.rules import could_be_flat, finite
from stratusqc.operators.history import earlier, field_values, time_span, with_history
from stratusqc.operators.qc import apply_rules, merge_tiers, neutral_model
from stratusqc.operators.spatial import same_instant_peers


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def confusion(df: DataFrame, truth: str = "is_anomalous", pred: str = "predicted", *keys: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and F1, overall or per key; undefined ratios are 0."""
    t, p = F.col(truth), F.col(pred)
    counts = df.groupBy(*keys).agg(
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"),
    )
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return counts.withColumns(
        {
            "precision": F.bround(precision, 4),
            "recall": F.bround(recall, 4),
            "f1": F.bround(_ratio(2 * precision * recall, precision + recall), 4),
        }
    )


def per_fault_recall(df: DataFrame, pred: str = "predicted") -> DataFrame:
    """Rows, detections, misses and recall of every fault type but ``valid``."""
    p = F.col(pred)
    counts = (
        df.filter(F.col("fault_type") != "valid")
        .groupBy("fault_type")
        .agg(F.count(F.lit(1)).alias("total_injected"), F.count_if(p).alias("detected"), F.count_if(~p).alias("missed"))
    )
    return counts.withColumn("recall", F.bround(_ratio(F.col("detected").cast("double"), F.col("total_injected")), 4))


def model_comparison(df: DataFrame, pred_a: str, pred_b: str, truth: str = "is_anomalous") -> DataFrame:
    """Recall of two predictors per fault type, gain of the second in points; 1.0 where nothing was to find."""
    t = F.col(truth)
    counts = df.groupBy("fault_type").agg(
        F.count_if(t).alias("ground_truth_count"),
        F.count_if(t & F.col(pred_a)).alias("_a"),
        F.count_if(t & F.col(pred_b)).alias("_b"),
    )
    recall = lambda hits: F.when(
        F.col("ground_truth_count") > 0, F.bround(F.col(hits) / F.col("ground_truth_count"), 4)
    ).otherwise(F.lit(1.0))
    return (
        counts.withColumns({"recall_a": recall("_a"), "recall_b": recall("_b")})
        .withColumn("gain_points", F.bround((F.col("recall_b") - F.col("recall_a")) * 100, 1))
        .withColumn("wins_on_drift", (F.col("fault_type") == "drift") & (F.col("recall_b") > F.col("recall_a")))
        .drop("_a", "_b")
    )


def evaluated_rows(labelled: DataFrame, variable: str) -> DataFrame:
    """Long rows that count for one variable: faults of other variables and missing values are left out."""
    other = F.col("is_anomalous") & F.col("fault_variable").isNotNull() & (F.col("fault_variable") != variable)
    return labelled.filter(~F.coalesce(other, F.lit(False)) & finite(F.col(variable))).select(
        "reading_id",
        "station_id",
        "ts",
        F.lit(variable).alias("variable"),
        F.col(variable).alias("value"),
        "is_anomalous",
        "fault_type",
    )


def merged_predictions(
    labelled: DataFrame,
    stations: DataFrame,
    variable: str = "temperature",
    scorer=None,
    span_seconds: int | None = None,
) -> DataFrame:
    """Rules, models, same-instant peers and the merge on labelled rows; ``predicted`` means anomalous.

    Here the neighbours are all other stations at that instant, the left-out rows among them.
    """
    rows = evaluated_rows(labelled, variable)
    span = time_span("ts", span_seconds) if span_seconds else None
    seen = with_history(rows, ["station_id"], ["ts"], ["value"], HISTORY_DEPTH, span=span)
    values = field_values("history", "value")
    inputs = seen.withColumn("previous", earlier("history", "value")).withColumn(
        "recent", F.when(could_be_flat(F.col("value"), F.col("previous")), values)
    )
    if scorer is not None:
        inputs = inputs.withColumn("series", values)
    specs = stations.select("station_id", "sensor_specs")
    ruled = apply_rules(inputs.drop("history").join(specs, "station_id"))
    everybody = labelled.select("ts", F.lit(variable).alias("variable"), F.col(variable).alias("value"))
    compared = same_instant_peers(ruled, everybody).withColumnsRenamed(
        {"n": "neighbor_n", "mean": "neighbor_mean", "std": "neighbor_std"}
    )
    judged = merge_tiers(scorer(compared) if scorer else neutral_model(compared))
    truth = rows.select("reading_id", "is_anomalous", "fault_type")
    return judged.select("reading_id", "verdict", "reason_code").join(truth, "reading_id").withColumn(
        "predicted", F.col("verdict") == "anomalous"
    )
