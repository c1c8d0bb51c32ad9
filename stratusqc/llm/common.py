"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all contracts of this package: blank and the characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]"


def kept_by_process() -> dict:
    """What a Python process keeps between tasks.

    Functions of this package travel with each job, and their globals with them; what shall outlive a task, or
    shall not travel, is kept in a module of the process itself.
    """
    return sys.modules.setdefault("_kept_by_process", ModuleType("_kept_by_process")).__dict__


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have in any case of letters."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def byte_slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in slices of about ``most`` bytes of text, so that arrays per byte stay small.

    A text longer than that makes a slice of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = text_offsets(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def text_offsets(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    raw = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    return raw[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and where each begins (one entry more than texts).

    Nulls must have been replaced before.
    """
    offsets = text_offsets(texts)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def partitions_for(df: DataFrame, least: int = 1) -> int:
    """As many partitions as the session shuffles into."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
