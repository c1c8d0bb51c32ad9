"""Quality selection by importance resampling.

Two bags of hashed byte n-grams are learned: one of target documents (a bounded, documented sample of rows
labelled as good) and one of all raw documents. A document's importance is the ratio of its likelihoods under the
two, taken per n-gram, so that length does not decide. A Gumbel draw, fixed by the document itself, is added and
the k documents with the largest keys are sampled without replacement. k is the number of raw documents whose
importance is at least that of nearly all target documents.

The models are vectors of ``BUCKETS`` counts. Tasks send their counts in pieces, which are added up in two
rounds, so no task receives a piece from every other. Only the finished ratios (512 kB) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from stratusqc.llm.common import byte_slices, fresh_name, mix64, text_bytes, text_or_empty
from stratusqc.session import write_and_reread

BUCKETS = 1 << 16
GRAM = 4
#: At most so many labelled target documents are used; the model changes little beyond.
TARGET_ROWS = 20_000
#: Share of target documents whose importance lies above the cut.
KEEP_TARGET = 0.9995
#: Scale of the Gumbel draw in units of importance per n-gram.
NOISE = 0.002
#: Added to each count of either model.
PRIOR = 0.5
PIECE = 1 << 12
ROUNDS = 64


def gram_codes(raw: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram that begins at each byte; digits count as equal."""
    b = raw.astype(np.uint32)
    b[(b >= 48) & (b <= 57)] = 48
    n = max(0, len(b) - GRAM + 1)
    word = np.zeros(n, np.uint32)
    for k in range(GRAM):
        word |= b[k : k + n] << np.uint32(8 * k)
    return ((word * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) & (BUCKETS - 1)


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts and the text each belongs to; none reaches from one text into the next."""
    raw, starts = text_bytes(texts)
    codes = gram_codes(raw)
    lengths = np.maximum(np.diff(starts) - GRAM + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    begins = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(begins - starts[:-1], lengths)
    return codes[at], owner


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    target, raw = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for part in byte_slices(batches):
        codes, owner = _grams(part.column("text"))
        good = part.column("good").to_numpy(zero_copy_only=False).astype(bool)
        raw += np.bincount(codes, minlength=BUCKETS)
        if good.any():
            target += np.bincount(codes[good[owner]], minlength=BUCKETS)
    pieces = range(BUCKETS // PIECE)
    cut = [[v[p * PIECE : (p + 1) * PIECE].tobytes() for p in pieces] for v in (target, raw)]
    turn = TaskContext.get().partitionId() % ROUNDS
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(pieces), pa.int64()), pa.array([turn] * len(pieces), pa.int64()), pa.array(cut[0], pa.binary()), pa.array(cut[1], pa.binary())],
        ["piece", "turn", "target", "raw"],
    )


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the pieces of one group as they come in."""
    key, sums = None, {c: np.zeros(PIECE, np.int64) for c in ("target", "raw")}
    for batch in batches:
        for name, total in sums.items():
            for value in batch.column(name):
                total += np.frombuffer(value.as_py(), np.int64)
        if batch.num_rows:
            key = [batch.column("piece")[0].as_py(), batch.column("turn")[0].as_py()]
    if key:
        values = [[key[0]], [key[1]], [sums["target"].tobytes()], [sums["raw"].tobytes()]]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names=["piece", "turn", "target", "raw"])


def _weigh(texts: pa.Array, draws: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Importance per n-gram and Gumbel draw of each text. A few n-grams say little; they are drawn towards nought."""
    codes, owner = _grams(texts)
    total = np.bincount(owner, weights=ratios[codes], minlength=len(texts))
    counts = np.bincount(owner, minlength=len(texts))
    uniform = ((mix64(draws.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return total / (counts + 1), -np.log(-np.log(uniform))


def _score(batches: Iterable[pa.RecordBatch], ratios: np.ndarray, noise: float, names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Every column that came in but the last two (text without nulls, draw), then importance and key."""
    text, draw, importance, key = names
    for part in byte_slices(batches, text):
        weight, gumbel = _weigh(part.column(text), part.column(draw).to_numpy(zero_copy_only=False), ratios)
        kept = [n for n in part.schema.names if n not in (text, draw)]
        columns = [part.column(n) for n in kept] + [pa.array(weight), pa.array(weight + noise * gumbel)]
        yield pa.RecordBatch.from_arrays(columns, names=[*kept, importance, key])


@dataclass(frozen=True)
class Selection:
    """Log ratios by bucket, and the smallest key that is sampled."""

    ratios: np.ndarray
    noise: float
    threshold: float

    def scored(self, docs: DataFrame, importance: str = "importance", key: str = "key") -> DataFrame:
        """All columns of ``docs`` with importance and key."""
        text, draw = fresh_name(docs, "full_text"), fresh_name(docs, "draw")
        given = docs.select("*", text_or_empty().alias(text), F.xxhash64(F.col("doc_id").cast("long"), text_or_empty()).alias(draw))
        kinds = StructType([*docs.schema.fields, StructField(importance, DoubleType()), StructField(key, DoubleType())])
        return given.mapInArrow(partial(_score, ratios=self.ratios, noise=self.noise, names=(text, draw, importance, key)), kinds)

    def keep(self, docs: DataFrame) -> DataFrame:
        """The sampled rows of ``docs`` with their own columns."""
        importance, key = fresh_name(docs, "importance"), fresh_name(docs, "key")
        return self.scored(docs, importance, key).filter(F.col(key) >= self.threshold).drop(importance, key)


def _models(rows: DataFrame) -> np.ndarray:
    kinds = "piece long, turn long, target binary, raw binary"
    sums = rows.mapInArrow(_count, kinds).groupBy("piece", "turn").applyInArrow(_add, kinds)
    sums = sums.groupBy("piece").applyInArrow(_add, kinds)
    found = {r["piece"]: r for r in sums.collect()}
    if not found:
        return np.zeros(BUCKETS)
    target, raw = (np.concatenate([np.frombuffer(found[p][c], np.int64) for p in sorted(found)]) for c in ("target", "raw"))
    if not target.any():
        return np.zeros(BUCKETS)
    return np.log((target + PRIOR) / (target.sum() + PRIOR * BUCKETS)) - np.log((raw + PRIOR) / (raw.sum() + PRIOR * BUCKETS))


def largest(values: DataFrame, column: str, k: int, bins: int = 1000) -> float:
    """The k-th largest value, by counting in bins that are made finer around it; nothing is sorted as a whole."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    above = 0
    while high > low:
        width = (high - low) / bins
        inside = values.filter(F.col(column).between(low, high))
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        counts = {r["place"]: r for r in inside.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()}
        for p in sorted(counts, reverse=True):
            if above + counts[p]["n"] >= k:
                low, high = counts[p]["low"], counts[p]["high"]
                break
            above += counts[p]["n"]
    return low


def select(docs: DataFrame, labels: DataFrame, noise: float = NOISE) -> Selection:
    """Learns both models from ``docs`` and ``labels`` (doc_id, quality) and sets the threshold of the top k keys.

    Null texts count as empty; an empty text has an importance of nought and, as there is nothing against it, is
    kept with a usual cut. Rows that agree in doc_id and text have one draw and are kept or left together. Without
    labelled target documents, or without documents, all is kept. Other columns are not looked at.
    """
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("labelled_id")).distinct()
    share = min(1.0, TARGET_ROWS / max(good.count(), 1))
    # A threshold on a hash, not a limit: the same rows however they are dealt. About TARGET_ROWS ids are broadcast.
    good = good.filter(F.pmod(F.xxhash64("labelled_id"), F.lit(1 << 20)) < int(share * (1 << 20))).withColumn("good", F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.join(F.broadcast(good), F.col("doc_id") == F.col("labelled_id"), "left")
    rows = rows.select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"))
    model = Selection(_models(rows.select("text", "good")), noise, -np.inf)
    keys = write_and_reread(model.scored(rows).drop("text"), "importance")
    cut = keys.filter("good").select(F.percentile("importance", F.lit(1 - KEEP_TARGET))).first()[0]
    k = keys.filter(F.col("importance") >= cut).count() if cut is not None else 0
    return Selection(model.ratios, noise, largest(keys, "key", k)) if k else model
