"""The quality-control job: rules, models and neighbours merged into one verdict per value."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratusqc.constants import HISTORY_DEPTH, VARIABLES
from stratusqc.functions.merge import imputed, merged_verdict, verdict_rank
from stratusqc.functions.rules import (
    could_be_flat,
    finite,
    flatline_fails,
    is_circular,
    range_violation,
    rule_outcome,
    spec_limits,
    step_delta,
    step_fails,
    zero_exempt,
)
from stratusqc.functions.spatial import spatial_delta, spatial_reason, spatial_z
from stratusqc.operators.history import earlier, field_values, time_span, with_history
from stratusqc.operators.spatial import neighbor_stats

def _variable_inputs(v: str, series: bool) -> Column:
    """What the checks need to know about one variable's past, as one struct of the wide row."""
    value, previous = F.col(v), earlier("history", v)
    values = field_values("history", v)
    parts = [
        F.lit(v).alias("variable"),
        value.alias("value"),
        previous.alias("previous"),
        F.when(could_be_flat(value, previous), values).alias("recent"),
    ]
    if series:
        parts.append(F.when(finite(value), F.filter(values, finite)).alias("series"))
    return F.struct(*parts).alias(f"_in_{v}")


def _with_neighbors(v: str) -> Column:
    """The variable's struct, extended by its neighbour statistics."""
    statistics = [F.col(f"{v}_{s}").alias(f"neighbor_{s}") for s in ("n", "mean", "std")]
    return F.struct(F.col(f"_in_{v}").alias("i"), *statistics)


def prepared_values(
    readings: DataFrame,
    stations: DataFrame,
    edges: DataFrame | None = None,
    series: bool = False,
    depth: int = HISTORY_DEPTH,
    span_seconds: int | None = None,
    variables: Sequence[str] = VARIABLES,
) -> DataFrame:
    """Long rows with rule flags and, if asked for, neighbour statistics and the recent series.

    History is gathered once per reading in the wide layout and unpivoted last: one window and one
    shuffle serve all variables and all tiers. It is reduced to the few values the checks need
    before the joins, which may have to shuffle.
    """
    span = time_span("ts", span_seconds) if span_seconds else None
    seen = with_history(readings, ["station_id"], ["ts"], list(variables), depth, span=span)
    ids = ["reading_id", "station_id", "ts"]
    wide = seen.select(*ids, *[_variable_inputs(v, series) for v in variables])
    wide = wide.join(stations.select("station_id", "sensor_specs"), "station_id")
    if edges is None:
        structs = [F.col(f"_in_{v}") for v in variables]
        return apply_rules(wide.select(*ids, "sensor_specs", F.inline(F.array(*structs))))
    wide = wide.join(neighbor_stats(readings, edges, variables), ["station_id", "ts"], "left")
    long = wide.select(*ids, "sensor_specs", F.inline(F.array(*[_with_neighbors(v) for v in variables])))
    return apply_rules(long.select(*ids, "sensor_specs", "i.*", "neighbor_n", "neighbor_mean", "neighbor_std"))


def apply_rules(long: DataFrame) -> DataFrame:
    """Evaluate the three rules on rows with value, previous, recent values and ``sensor_specs``."""
    limits = spec_limits(F.col("sensor_specs"), F.col("variable"))
    value, previous, variable = F.col("value"), F.col("previous"), F.col("variable")
    count = F.col("persistence_max")
    return (
        long.withColumns({name: limits[name] for name in ("min", "max", "step_max", "persistence_max")})
        .withColumns(
            {
                "violation": range_violation(value, F.col("min"), F.col("max")),
                "delta": step_delta(value, previous, is_circular(variable)),
                "step_fail": step_fails(value, previous, F.col("step_max"), is_circular(variable)),
                "flat_fail": flatline_fails(F.col("recent"), value, count, zero_exempt(variable)),
            }
        )
        .withColumn(
            "flat_value",
            F.when(F.col("flat_fail"), F.coalesce(F.get("recent", F.size("recent") - count), value)),
        )
        .drop("sensor_specs", "recent", "min", "max", "step_max")
    )


def rule_verdicts(readings: DataFrame, stations: DataFrame, **options) -> DataFrame:
    """Rule tier alone: one row per reading and variable, missing values included."""
    long = prepared_values(readings, stations, **options)
    outcome = rule_outcome(F.col("violation"), F.col("step_fail"), F.col("flat_fail"))
    return long.withColumn("_o", outcome).select(
        "reading_id", "station_id", "ts", "variable", "value", "previous", "violation", "delta", "_o.*"
    )


def merged_verdicts(
    readings: DataFrame,
    stations: DataFrame,
    edges: DataFrame,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    depth: int = HISTORY_DEPTH,
    span_seconds: int | None = None,
) -> DataFrame:
    """Final verdict for every value that is present.

    ``scorer`` adds ml_flag, ml_score, ml_confidence, ml_model, ml_model_version,
    delta_1 and rolling_mean_diff to rows carrying ``series``, the present values of
    the last readings; without one the model tier is neutral.
    """
    long = prepared_values(
        readings, stations, edges, series=scorer is not None, depth=depth, span_seconds=span_seconds
    ).filter(finite(F.col("value")))
    return merge_tiers(scorer(long) if scorer else neutral_model(long))


def neutral_model(df: DataFrame) -> DataFrame:
    """Model columns for rows that no active model covers."""
    return df.withColumns(
        {
            "ml_flag": F.lit(False),
            "ml_score": F.lit(0.0),
            "ml_confidence": F.lit(0.5),
            "ml_model": F.lit(None).cast("string"),
            "ml_model_version": F.lit(None).cast("string"),
            "delta_1": F.lit(None).cast("double"),
            "rolling_mean_diff": F.lit(None).cast("double"),
        }
    )


def merge_tiers(long: DataFrame) -> DataFrame:
    """Turn rule flags, model columns and neighbour statistics into the merged verdict."""
    value, n, mean, std = (F.col(c) for c in ("value", "neighbor_n", "neighbor_mean", "neighbor_std"))
    rule = rule_outcome(F.col("violation"), F.col("step_fail"), F.col("flat_fail"))
    spatial = spatial_reason(value, n, mean, std)
    compared = F.col("spatial_reason") != "SPATIAL_INSUFFICIENT_DATA"
    return (
        long.withColumns({"rule_reason": rule["reason_code"], "spatial_reason": spatial})
        .withColumns(
            {
                "_m": merged_verdict(
                    F.col("rule_reason"),
                    F.col("ml_flag"),
                    F.col("ml_score"),
                    F.col("ml_confidence"),
                    F.col("ml_model"),
                    F.col("delta_1"),
                    F.col("spatial_reason"),
                ),
                "_i": imputed(value, n, mean, F.col("rolling_mean_diff")),
                "spatial_delta": F.when(compared, spatial_delta(value, mean)),
                "z_score": F.when(compared, spatial_z(value, mean, std)),
            }
        )
        .select(
            (F.col("reading_id") * 10 + variable_index(F.col("variable"))).alias("qc_id"),
            "reading_id",
            "station_id",
            F.col("ts").alias("created_at"),
            "variable",
            "value",
            "_m.verdict",
            "_m.fault_type",
            "_m.reason_code",
            "_m.confidence",
            "ml_model_version",
            "rule_reason",
            "delta",
            "persistence_max",
            "flat_value",
            "ml_flag",
            "ml_score",
            "spatial_reason",
            F.col("neighbor_n").alias("neighbor_count"),
            "neighbor_mean",
            "spatial_delta",
            "z_score",
            F.col("_i.corrected_value").alias("corrected_value"),
            F.col("_i.method").alias("impute_method"),
            F.col("_i.confidence").alias("impute_confidence"),
        )
    )


def variable_index(variable: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in VARIABLES]), variable)


def verdict_details(qc: DataFrame) -> DataFrame:
    """Explanation of each verdict as nested fields; serialise with ``to_json`` at the sink only."""
    return qc.withColumn(
        "details",
        F.struct(
            F.struct(
                F.col("rule_reason").alias("reason"),
                F.bround("value", 3).alias("value"),
                F.bround("delta", 3).alias("delta"),
                F.bround("flat_value", 3).alias("identical_value"),
                F.col("persistence_max").alias("consecutive_count"),
            ).alias("rule"),
            F.struct(F.col("ml_flag").alias("is_anom"), F.bround("ml_score", 4).alias("score")).alias("ml"),
            F.struct(
                F.col("spatial_reason").alias("reason"),
                F.bround("neighbor_mean", 3).alias("neighbor_mean"),
                F.bround("spatial_delta", 3).alias("spatial_delta"),
                F.bround("z_score", 3).alias("z_score"),
                F.col("neighbor_count").alias("neighbor_count"),
            ).alias("spatial"),
            F.struct(
                F.col("corrected_value"),
                F.col("impute_method").alias("method"),
                F.col("impute_confidence").alias("confidence"),
            ).alias("imputation"),
        ),
    )


def reading_rollup(qc: DataFrame) -> DataFrame:
    """Worst verdict of each reading, with its fault type or else its reason.

    Among several anomalous rows the first reported one speaks, among suspect ones the last.
    """
    anomalous, valid = F.col("verdict") == "anomalous", F.col("verdict") == "valid"
    label = F.when(~valid, F.coalesce("fault_type", "reason_code"))
    order = F.struct(verdict_rank(F.col("verdict")), F.when(anomalous, -F.col("qc_id")).otherwise(F.col("qc_id")))
    worst = F.max_by(F.struct("verdict", label.alias("label")), order)
    return qc.groupBy("reading_id").agg(worst.alias("_w")).select(
        "reading_id", F.col("_w.verdict").alias("verdict"), F.col("_w.label").alias("fault_type")
    )
