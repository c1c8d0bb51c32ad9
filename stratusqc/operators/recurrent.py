"""Sequence autoencoder of two recurrent layers, trained by gradients that are summed over all partitions.

An LSTM reads a window of values; its last state is all that a second LSTM gets to write the window down again. Clean
windows are rebuilt well, deformed ones are not; the mean squared difference is the window's error.

Training is plain synchronous descent (Adam). The scaled windows are written once, dealt into slices by hash. A step
reads one slice: each task works through its windows by back-propagation through time and returns one vector for each
variable; vectors are added up in groups first, so that the driver gets a bounded number of them, whatever the number
of tasks. The weights, some seven thousand numbers per variable, are all the driver holds. An epoch is one pass over
all slices, so every window counts the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratusqc.constants import SEQUENCE_LENGTH
from stratusqc.functions.features import padded_sequence
from stratusqc.functions.rules import finite
from stratusqc.functions.scoring import reconstruction_confidence, reconstruction_score
from stratusqc.operators.features import sequence_windows
from stratusqc.operators.quantiles import error_threshold
from stratusqc.session import scratch_dir, write_and_reread

HIDDEN = 24
#: Gradient vectors per variable that the driver adds up at most.
MOST_VECTORS = 64
#: Windows that one call works on, which bounds a task's memory.
CHUNK = 2048


def shapes(hidden: int) -> dict[str, tuple[int, ...]]:
    """Reader (from values), writer (from the state), and the line from the writer's state to a value."""
    four = 4 * hidden
    return {
        "read_x": (four, 1), "read_h": (four, hidden), "read_b": (four,),
        "write_x": (four, hidden), "write_h": (four, hidden), "write_b": (four,),
        "out": (hidden,), "out_b": (1,),
    }


def n_weights(hidden: int) -> int:
    return sum(int(np.prod(s)) for s in shapes(hidden).values())


def split(flat: np.ndarray, hidden: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(hidden).items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def initial(hidden: int, seed: int, variable: str) -> np.ndarray:
    bound = 1 / np.sqrt(hidden)
    return np.random.default_rng([seed, *variable.encode()]).uniform(-bound, bound, n_weights(hidden))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _step(z: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    i, f, g, o = np.split(z, 4, axis=1)
    i, f, g, o = _sigmoid(i), _sigmoid(f), np.tanh(g), _sigmoid(o)
    after = f * c + i * g
    tc = np.tanh(after)
    return i, f, g, o, c, after, tc, o * tc


def _back(step: tuple[np.ndarray, ...], dh: np.ndarray, dc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of a step's inner sums and of the cell before it."""
    i, f, g, o, before, _, tc, _ = step
    dc = dc + dh * o * (1 - tc * tc)
    dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dc * i * (1 - g * g), dh * tc * o * (1 - o)], axis=1)
    return dz, dc * f


def _forward(w: dict[str, np.ndarray], x: np.ndarray) -> tuple[list, list, np.ndarray]:
    n, length = x.shape
    hidden = len(w["out"])
    h, c, reading = np.zeros((n, hidden)), np.zeros((n, hidden)), []
    for t in range(length):
        step = _step(x[:, t, None] * w["read_x"][:, 0] + h @ w["read_h"].T + w["read_b"], c)
        reading.append(step)
        c, h = step[5], step[7]
    given = h @ w["write_x"].T + w["write_b"]
    h, c, writing, y = np.zeros((n, hidden)), np.zeros((n, hidden)), [], np.empty((n, length))
    for t in range(length):
        step = _step(given + h @ w["write_h"].T, c)
        writing.append(step)
        c, h = step[5], step[7]
        y[:, t] = h @ w["out"] + w["out_b"][0]
    return reading, writing, y


def window_errors(flat: np.ndarray, x: np.ndarray, hidden: int) -> np.ndarray:
    """Mean squared difference of each window and what is rebuilt of it."""
    w = split(flat, hidden)
    parts = [((_forward(w, x[k : k + CHUNK])[2] - x[k : k + CHUNK]) ** 2).mean(axis=1) for k in range(0, len(x), CHUNK)]
    return np.concatenate(parts) if parts else np.zeros(0)


def gradient(flat: np.ndarray, x: np.ndarray, hidden: int) -> tuple[float, np.ndarray]:
    """Sum over all windows and places of the squared differences, and its gradient."""
    w = split(flat, hidden)
    out = np.zeros_like(flat)
    d = split(out, hidden)  # views
    reading, writing, y = _forward(w, x)
    off = y - x
    zero = np.zeros((len(x), hidden))
    dh, dc, dgiven = zero, zero, np.zeros((len(x), 4 * hidden))
    for t in range(x.shape[1] - 1, -1, -1):
        dy = 2 * off[:, t]
        d["out"] += dy @ writing[t][7]
        d["out_b"] += dy.sum()
        dz, dc = _back(writing[t], dh + dy[:, None] * w["out"], dc)
        if t:
            d["write_h"] += dz.T @ writing[t - 1][7]
        dgiven += dz
        dh = dz @ w["write_h"]
    latent = reading[-1][7]
    d["write_x"] += dgiven.T @ latent
    d["write_b"] += dgiven.sum(axis=0)
    dh, dc = dgiven @ w["write_x"], zero
    for t in range(x.shape[1] - 1, -1, -1):
        dz, dc = _back(reading[t], dh, dc)
        d["read_x"][:, 0] += dz.T @ x[:, t]
        d["read_b"] += dz.sum(axis=0)
        if t:
            d["read_h"] += dz.T @ reading[t - 1][7]
        dh = dz @ w["read_h"]
    return float((off * off).sum()), out


# Training over partitions

_SUMS = "variable string, part int, n long, loss double, gradient binary"


def _windows(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _gradients(batches: Iterable[pa.RecordBatch], weights: dict[str, np.ndarray], hidden: int, length: int) -> Iterator[pa.RecordBatch]:
    """One vector for each variable of this task."""
    from pyspark import TaskContext

    part, sums = TaskContext.get().partitionId(), {}
    for batch in batches:
        names = batch.column("variable").to_numpy(zero_copy_only=False)
        x = _windows(batch.column("window"), length)
        for name in sorted(set(names)):
            own = x[names == name]
            n, loss, total = sums.get(name, (0, 0.0, np.zeros(n_weights(hidden))))
            for k in range(0, len(own), CHUNK):
                more, g = gradient(weights[name], own[k : k + CHUNK], hidden)
                loss, total = loss + more, total + g
            sums[name] = (n + len(own), loss, total)
    rows = [(name, part, n, loss, g.tobytes()) for name, (n, loss, g) in sums.items()]
    names = ["variable", "part", "n", "loss", "gradient"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(5)], names=names)


def _add_up(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("part")
    total = sum((np.frombuffer(g) for g in frame["gradient"]), np.zeros(len(frame["gradient"].iloc[0]) // 8))
    return pd.DataFrame({"variable": [key[0]], "part": [int(key[1])], "n": [int(frame["n"].sum())], "loss": [float(frame["loss"].sum())], "gradient": [total.tobytes()]})


def summed_gradients(
    windows: DataFrame, weights: dict[str, np.ndarray], hidden: int, length: int, grouped: bool
) -> dict[str, tuple[int, float, np.ndarray]]:
    """Windows, loss and gradient per variable over all of ``windows``; ``grouped`` where there are many tasks."""
    vectors = windows.select("variable", "window").mapInArrow(partial(_gradients, weights=weights, hidden=hidden, length=length), _SUMS)
    if grouped:
        vectors = vectors.groupBy("variable", (F.col("part") % MOST_VECTORS).alias("group")).applyInPandas(_add_up, _SUMS)
    out: dict[str, tuple[int, float, np.ndarray]] = {}
    for r in sorted(vectors.collect(), key=lambda r: (r["variable"], r["part"])):
        n, loss, total = out.get(r["variable"], (0, 0.0, 0.0))
        out[r["variable"]] = (n + r["n"], loss + r["loss"], total + np.frombuffer(r["gradient"]))
    return out


@dataclass
class Adam:
    """Descent with running means of a gradient and of its square."""

    weights: np.ndarray
    rate: float
    mean: np.ndarray | float = 0.0
    square: np.ndarray | float = 0.0
    steps: int = 0

    def step(self, g: np.ndarray) -> None:
        self.steps += 1
        self.mean = 0.9 * self.mean + 0.1 * g
        self.square = 0.999 * self.square + 0.001 * g * g
        mean, square = self.mean / (1 - 0.9**self.steps), self.square / (1 - 0.999**self.steps)
        self.weights = self.weights - self.rate * mean / (np.sqrt(square) + 1e-8)


@dataclass(frozen=True)
class RecurrentModel:
    """``fitted``: variable, value_mean, value_std, weights, threshold, error_mean, error_std, n_windows, first_loss, last_loss."""

    fitted: DataFrame
    hidden: int = HIDDEN
    length: int = SEQUENCE_LENGTH
    version: str = "v1.0.0-rec"


def _scaled(window, mean, std):
    width = F.when(std > 0, std).otherwise(F.lit(1.0))
    return F.transform(window, lambda x: (x - mean) / width)


def fit_recurrent(
    long: DataFrame,
    hidden: int = HIDDEN,
    length: int = SEQUENCE_LENGTH,
    epochs: int = 10,
    slices: int = 8,
    rate: float = 0.02,
    seed: int = 42,
    span_seconds: int | None = None,
    version: str = "v1.0.0-rec",
) -> RecurrentModel:
    """Fit one autoencoder per variable over all windows of present values; ``epochs * slices`` steps.

    Variables with fewer than three windows' worth of values get none. With no variable left the model is empty and
    scores nothing. The same rows in the same files give the same weights.
    """
    spark = long.sparkSession
    present = long.filter(finite(F.col("value")))
    scaler = present.groupBy("variable").agg(
        F.avg("value").alias("value_mean"), F.stddev_pop("value").alias("value_std"), F.count(F.lit(1)).alias("n")
    )
    scaler = write_and_reread(scaler.filter(F.col("n") >= 3 * length).drop("n"), "recurrent-scaler")
    windows = sequence_windows(present, length, span_seconds=span_seconds).join(scaler, "variable").select(
        "variable",
        _scaled(F.col("window"), F.col("value_mean"), F.col("value_std")).alias("window"),
        F.pmod(F.xxhash64("station_id", "ts", F.lit(seed)), F.lit(slices)).alias("slice"),
        F.xxhash64("variable", "station_id", "ts").alias("_deal"),
    )
    path = scratch_dir(spark, "windows")
    # Few bytes, much work: every slice gets a file for each core, so that all cores work on each step.
    dealt = windows.repartition(max(2, spark.sparkContext.defaultParallelism), "_deal").drop("_deal")
    dealt.write.partitionBy("slice").parquet(path)
    windows = spark.read.schema("variable string, window array<double>, slice long").parquet(path)
    names = sorted(r["variable"] for r in scaler.select("variable").collect())
    grouped = windows.rdd.getNumPartitions() > MOST_VECTORS
    tuned = {name: Adam(initial(hidden, seed, name), rate) for name in names}
    counts, first, last = dict.fromkeys(names, 0), {}, {}
    for epoch in range(epochs):
        lost, seen = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0)
        for k in range(slices):
            weights = {name: a.weights for name, a in tuned.items()}
            for name, (n, loss, g) in summed_gradients(windows.filter(F.col("slice") == k), weights, hidden, length, grouped).items():
                tuned[name].step(g / (n * length))
                lost[name] += loss
                seen[name] += n
        last = {name: lost[name] / max(1, seen[name] * length) for name in names}
        first, counts = first or last, seen
    rows = [(n, tuned[n].weights.tolist(), counts[n], first.get(n), last.get(n)) for n in names if counts[n]]
    trained = spark.createDataFrame(rows, "variable string, weights array<double>, n_windows long, first_loss double, last_loss double")
    errors = with_errors(windows, {n: a.weights for n, a in tuned.items()}, hidden).select("variable", "error")
    cutoffs = error_threshold(write_and_reread(errors, "recurrent-errors")).select(
        "variable", "threshold", F.col("mean").alias("error_mean"), F.col("std").alias("error_std")
    )
    return RecurrentModel(write_and_reread(scaler.join(trained, "variable").join(cutoffs, "variable"), "recurrent"), hidden, length, version)


def with_errors(rows: DataFrame, weights: dict[str, np.ndarray], hidden: int) -> DataFrame:
    """``rows`` with ``error`` of their scaled ``window``; null for variables without weights and null windows."""

    @F.pandas_udf("double")
    def error(variable: pd.Series, window: pd.Series) -> pd.Series:
        out = np.full(len(window), np.nan)
        names, there = variable.to_numpy(), window.notna().to_numpy()
        for name, own in weights.items():
            hit = np.flatnonzero((names == name) & there)
            if len(hit):
                out[hit] = window_errors(own, np.stack(window.iloc[hit].to_list()), hidden)
        return pd.Series(out)

    return rows.withColumn("error", F.nanvl(error("variable", "window"), F.lit(None).cast("double")))


def score_recurrent(rows: DataFrame, model: RecurrentModel) -> DataFrame:
    """Rows with a full or padded ``window`` -> error, ml_flag, ml_score, ml_confidence; as for the linear model."""
    weights = {r["variable"]: np.array(r["weights"]) for r in model.fitted.select("variable", "weights").collect()}
    facts = model.fitted.select("variable", F.col("value_mean").alias("_mean"), F.col("value_std").alias("_std"), "threshold")
    joined = rows.join(facts, "variable")
    kept = [c for c in rows.columns if c != "window"]
    scaled = joined.select(*kept, "threshold", F.col("window").alias("_raw"), _scaled(F.col("window"), F.col("_mean"), F.col("_std")).alias("window"))
    scored = with_errors(scaled, weights, model.hidden).drop("window").withColumnRenamed("_raw", "window")
    error, threshold = F.col("error"), F.col("threshold")
    return scored.withColumns(
        {
            "ml_flag": error > threshold,
            "ml_score": reconstruction_score(error, threshold),
            "ml_confidence": reconstruction_confidence(error, threshold),
            "ml_model": F.lit("reconstruction"),
            "ml_model_version": F.lit(model.version),
        }
    )


def recurrent_scorer(model: RecurrentModel):
    """Model tier of the merged job; brings no rolling features, as the sequence model has none."""

    def score(long: DataFrame) -> DataFrame:
        rows = long.withColumn("window", padded_sequence(F.col("series"), model.length))
        return (
            score_recurrent(rows, model)
            .drop("threshold", "window")
            .withColumns({c: F.lit(None).cast("double") for c in ("delta_1", "rolling_mean_diff")})
        )

    return score
