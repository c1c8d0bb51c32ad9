"""Choice between models, and the registry of model versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ML_COLUMNS = ("ml_flag", "ml_score", "ml_confidence", "ml_model", "ml_model_version")
ROW_KEY = ["reading_id", "variable"]


def model_select(rows: DataFrame, sequence: DataFrame | None, forest: DataFrame | None) -> DataFrame:
    """Model columns per row: the sequence model's if it scored the row, else the forest's, else neutral."""
    neutral = {
        "ml_flag": F.lit(False),
        "ml_score": F.lit(0.0),
        "ml_confidence": F.lit(0.5),
        "ml_model": F.lit(None).cast("string"),
        "ml_model_version": F.lit(None).cast("string"),
    }
    out, sources = rows, []
    for prefix, scored in (("s", sequence), ("f", forest)):
        if scored is not None:
            part = scored.select(*ROW_KEY, *[F.col(c).alias(f"_{prefix}_{c}") for c in ML_COLUMNS])
            out = out.join(part, ROW_KEY, "left")
            sources.append(prefix)
    picked = {c: F.coalesce(*[F.col(f"_{p}_{c}") for p in sources], neutral[c]) for c in ML_COLUMNS}
    return out.withColumns(picked).drop(*[f"_{p}_{c}" for p in sources for c in ML_COLUMNS])


def register(registry: DataFrame, row: DataFrame) -> DataFrame:
    """Append-only: a new version arrives with its activation time and thereby becomes active."""
    return registry.unionByName(row, allowMissingColumns=True)


def activate(registry: DataFrame, model_id: int, at: str) -> DataFrame:
    """Roll back or forward to a known version by recording a new activation time for it."""
    again = F.when(F.col("model_id") == model_id, F.lit(at).cast("timestamp")).otherwise(F.col("activated_at"))
    return registry.withColumn("activated_at", again)


def with_active_flag(registry: DataFrame) -> DataFrame:
    """``is_active`` is true for the last activated version of each variable only."""
    active = active_models(registry).select(F.col("model_id"), F.lit(True).alias("_a"))
    return registry.join(active, "model_id", "left").withColumn("is_active", F.coalesce("_a", F.lit(False))).drop("_a")


def active_models(registry: DataFrame) -> DataFrame:
    """One row per variable: the version activated last."""
    used = registry.filter(F.col("activated_at").isNotNull())
    rest = [c for c in registry.columns if c != "variable"]
    last = F.max_by(F.struct(*rest), F.struct("activated_at", "model_id"))
    return used.groupBy("variable").agg(last.alias("_m")).select("variable", "_m.*").select(*registry.columns)


def registry_list(registry: DataFrame, variable: str | None = None) -> DataFrame:
    df = registry if variable is None else registry.filter(F.col("variable") == variable)
    return df.orderBy(F.col("trained_at").desc(), F.col("model_id").desc())


def next_version(registry: DataFrame) -> DataFrame:
    """Version the next training of each variable will carry."""
    return registry.groupBy("variable").agg(
        F.concat(F.lit("v1."), F.count(F.lit(1)) + 1, F.lit(".0")).alias("next_version")
    )
