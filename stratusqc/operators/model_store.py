"""Model versions that outlive a session: their tables, and which of them is active.

A store is a folder. ``tables/<name>/artefact=<id>`` holds the tables of one training; they are written first and are
never changed. ``commits/<number>.json`` holds the decisions: a commit registers or activates versions and is one file,
written aside and then moved to its name, which must not exist yet. Whoever reads sees a commit whole or not at all, and
of two writers with the same number the second looks at the first one's commit and tries the next number. Tables of a
training that was never committed are not seen by anybody.

Of each variable one version of each kind of model is active: the one that was activated last. Going back to an older
version is one more commit, and scoring then uses the older version's tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratusqc.operators.features import add_features
from stratusqc.operators.forest import ForestModel, score_forest
from stratusqc.operators.qc import neutral_model
from stratusqc.operators.reconstruction import ReconstructionModel, reconstruction_scorer
from stratusqc.session import write_and_reread

ENTRY = "commit long, action string, model_type string, variable string, version string, artefact string, at timestamp"
FOREST, SEQUENCE = "isolation_forest", "reconstruction"
TRIES = 20


class ModelStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Commits

    def _files(self):
        hadoop = self.spark._jvm.org.apache.hadoop
        folder = hadoop.fs.Path(f"{self.root}/commits")
        return hadoop, folder, hadoop.fs.FileContext.getFileContext(folder.toUri(), self.spark._jsc.hadoopConfiguration())

    def last_commit(self) -> int:
        _, folder, context = self._files()
        if not context.util().exists(folder):
            return 0
        names = [s.getPath().getName() for s in context.util().listStatus(folder)]
        return max((int(n.split(".")[0]) for n in names if n[0] not in "._"), default=0)

    def commit(self, entries: Callable[[DataFrame], list[dict]]) -> int:
        """Record what ``entries`` makes of the versions known so far; returns the commit's number."""
        for _ in range(TRIES):
            known = self.last_commit()
            lines = [json.dumps({"commit": known + 1, **e}) for e in entries(self.versions(known))]
            if self._move_into_place(known + 1, "\n".join(lines) + "\n"):
                return known + 1
        raise RuntimeError(f"others commit to {self.root} all the time")

    def _move_into_place(self, number: int, text: str) -> bool:
        hadoop, folder, context = self._files()
        aside = hadoop.fs.Path(folder, f".{uuid.uuid4().hex}")
        files = aside.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = files.create(aside)
        out.write(bytearray(text.encode()))
        out.close()
        none = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, hadoop.fs.Path(folder, f"{number:010d}.json"), none)
        except Py4JJavaError as error:
            context.delete(aside, False)
            if "FileAlreadyExistsException" not in error.java_exception.toString():
                raise
            return False
        return True

    def versions(self, upto: int | None = None) -> DataFrame:
        """One row per version: model_type, variable, version, artefact, registered_at, activated_at, is_active."""
        upto = self.last_commit() if upto is None else upto
        if not upto:
            entries = self.spark.createDataFrame([], ENTRY)
        else:
            entries = self.spark.read.schema(ENTRY).json(f"{self.root}/commits").filter(F.col("commit") <= upto)
        key = ["model_type", "variable"]
        activated = F.col("action") == "activate"
        rows = entries.groupBy(*key, "version").agg(
            F.max("artefact").alias("artefact"),
            F.min(F.when(F.col("action") == "register", F.col("at"))).alias("registered_at"),
            F.max_by(F.when(activated, F.col("at")), F.when(activated, F.col("commit"))).alias("activated_at"),
            F.max(F.when(activated, F.col("commit"))).alias("_last"),
        )
        newest = entries.filter(activated).groupBy(*key).agg(F.max("commit").alias("_newest"))
        active = F.coalesce(F.col("_last") == F.col("_newest"), F.lit(False))
        return rows.join(newest, key, "left").withColumn("is_active", active).drop("_last", "_newest")

    def activate(self, model_type: str, versions: dict[str, str]) -> int:
        """Make these versions (by variable) the active ones."""
        at = _now()

        def entries(known: DataFrame) -> list[dict]:
            there = {(r["variable"], r["version"]) for r in known.filter(F.col("model_type") == model_type).collect()}
            missing = set(versions.items()) - there
            if missing:
                raise ValueError(f"not in the store: {sorted(missing)}")
            return [{"action": "activate", "model_type": model_type, "variable": v, "version": n, "at": at} for v, n in sorted(versions.items())]

        return self.commit(entries)

    # Tables

    def save(self, model_type: str, tables: dict[str, DataFrame]) -> dict[str, str]:
        """Keep a training's tables, each with a column ``variable``; its versions become active. Returns them by variable.

        The variables are those of the first table. A variable's versions are numbered in the order of their commits.
        """
        artefact, at = uuid.uuid4().hex, _now()
        for name, table in tables.items():
            table.write.parquet(f"{self.root}/tables/{name}/artefact={artefact}")
        trained = sorted(r["variable"] for r in next(iter(tables.values())).select("variable").distinct().collect())
        given: dict[str, str] = {}

        def entries(known: DataFrame) -> list[dict]:
            own = known.filter(F.col("model_type") == model_type).groupBy("variable").agg(F.count(F.lit(1)).alias("n"))
            counts = {r["variable"]: r["n"] for r in own.collect()}
            given.update({v: f"v1.{counts.get(v, 0) + 1}.0" for v in trained})
            both = {"model_type": model_type, "at": at}
            return [
                {"action": action, "variable": v, "version": given[v], **({"artefact": artefact} if action == "register" else {}), **both}
                for v in trained
                for action in ("register", "activate")
            ]

        if trained:
            self.commit(entries)
        return given

    def active(self, model_type: str) -> DataFrame:
        chosen = self.versions().filter((F.col("model_type") == model_type) & F.col("is_active"))
        return chosen.select("variable", "version", "artefact")

    def load(self, model_type: str, names: list[str]) -> dict[str, DataFrame]:
        """The tables of the active versions, with their column ``version``; only files of these trainings are read."""
        rows = self.active(model_type).collect()  # one row per variable
        if not rows:
            raise LookupError(f"no active {model_type} in {self.root}")
        chosen = self.spark.createDataFrame([tuple(r) for r in rows], "variable string, version string, artefact string")
        trainings = sorted({r["artefact"] for r in rows})
        out = {}
        for name in names:
            stored = self.spark.read.parquet(f"{self.root}/tables/{name}")
            out[name] = stored.filter(F.col("artefact").isin(trainings)).join(chosen, ["variable", "artefact"]).drop("artefact")
        return out

    # Models

    def save_forest(self, model: ForestModel) -> dict[str, str]:
        return self.save(FOREST, {"forest_cutoffs": model.cutoffs, "forest_nodes": model.nodes, "forest_scaler": model.scaler})

    def load_forest(self) -> ForestModel:
        """The active forest of each variable; ``cutoffs`` names each one's version."""
        tables = self.load(FOREST, ["forest_cutoffs", "forest_nodes", "forest_scaler"])
        cutoffs = tables["forest_cutoffs"].withColumnRenamed("version", "stored_version")
        return ForestModel(tables["forest_nodes"].drop("version"), tables["forest_scaler"].drop("version"), cutoffs)

    def save_sequence(self, model: ReconstructionModel) -> dict[str, str]:
        return self.save(SEQUENCE, {"sequence_model": model.fitted.withColumn("window_length", F.lit(model.length))})

    def load_sequence(self) -> ReconstructionModel:
        table = self.load(SEQUENCE, ["sequence_model"])["sequence_model"]
        lengths = [r["window_length"] for r in table.select("window_length").distinct().collect()]
        if len(lengths) != 1:
            raise ValueError(f"active sequence models have windows of different lengths: {sorted(lengths)}")
        return ReconstructionModel(table.drop("version", "window_length"), lengths[0])


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")


def score_stored(features: DataFrame, model: ForestModel) -> DataFrame:
    """:func:`score_forest` with each variable's own version."""
    scored = score_forest(features, model)
    return scored.withColumn("ml_model_version", F.col("stored_version")).drop("stored_version")


def active_scorer(store: ModelStore):
    """Model tier of the merged job: a variable's sequence model if one is active, else its forest, else neutral.

    The rows are written once and then read by kind of model, each by the variables it covers.
    """

    def covered(model_type: str) -> dict[str, str]:
        return {r["variable"]: r["version"] for r in store.active(model_type).collect()}

    by_sequence, by_forest = covered(SEQUENCE), covered(FOREST)
    by_forest = {v: n for v, n in by_forest.items() if v not in by_sequence}

    def score(long: DataFrame) -> DataFrame:
        rows = write_and_reread(long, "series")
        columns = [*neutral_model(rows.limit(0)).columns]
        parts = [neutral_model(rows.filter(~F.col("variable").isin([*by_sequence, *by_forest])))]
        if by_sequence:
            own = reconstruction_scorer(store.load_sequence())(rows.filter(F.col("variable").isin([*by_sequence])))
            named = F.create_map(*[F.lit(x) for pair in by_sequence.items() for x in pair])
            parts.append(own.withColumn("ml_model_version", named[F.col("variable")]))
        if by_forest:
            own = rows.filter(F.col("variable").isin([*by_forest]))
            parts.append(score_stored(add_features(own, ddof=0), store.load_forest()))
        out = parts[0].select(*columns)
        for part in parts[1:]:
            out = out.unionByName(part.select(*columns))
        return out

    return score
