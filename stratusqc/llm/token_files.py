"""Token ids as compact binary segments: patched frame of reference.

Documents are range-partitioned and sorted by doc_id; every task encodes its range and cuts it into segments of about
``SEGMENT`` ids. Ids are packed in blocks of 128: the block's minimum is subtracted, the rest is packed at the width
that holds nine tenths of the block, and what doesn't fit leaves its upper bits in the block's exception list.
Block starts are indexed, so that any range of ids can be read without unpacking what lies before it.

Segments are rows of a Parquet table, because every store that Spark can write to takes those, tasks commit them
atomically, and a lost executor only repeats its own range.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratusqc.llm.common import byte_slices, partitions_for, text_or_empty
from stratusqc.llm.wordcodes import word_codes

END_ID = 0
BLOCK = 128
SEGMENT = 1 << 20
#: Share of a block's values that fit its width.
PERCENTILE = 0.9
MAGIC = b"PFR1"
HEADER = "<4sHHQII"

SEGMENTS = "part long, number long, before long, n_tokens long, n_docs long, body binary"


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Columns of 128 values below 2 ** width as columns of 2 * width 64-bit words."""
    words = np.zeros((2 * width, values.shape[1]), np.uint64)
    for j in range(BLOCK):
        word, shift = divmod(j * width, 64)
        words[word] |= values[j] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= values[j] >> np.uint64(64 - shift)
    return words


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    values, mask = np.zeros((BLOCK, words.shape[1]), np.uint64), np.uint64((1 << width) - 1)
    for j in range(BLOCK if width else 0):
        word, shift = divmod(j * width, 64)
        values[j] = words[word] >> np.uint64(shift)
        if shift + width > 64:
            values[j] |= words[word + 1] << np.uint64(64 - shift)
    values &= mask
    return values


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    return np.frexp(values.astype(np.float32 if values.max(initial=0) < 1 << 24 else np.float64))[1].astype(np.uint8)


def encode_segment(doc_ids: np.ndarray, missing: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """Documents with their ends in ``ids``; ``missing`` marks documents without an id.

    A block is its packed words, then the places of its exceptions (one byte each) and their upper bits (four
    bytes each), filled up to whole words.
    """
    n = len(ids)
    blocks = -(-n // BLOCK)
    values = np.full(blocks * BLOCK, ids[-1] if n else 0, np.uint64)
    values[:n] = ids
    values = values.reshape(blocks, BLOCK)
    least = values.min(axis=1) if blocks else np.zeros(0, np.uint64)
    values -= least[:, None]
    bits = _widths(values)
    place = min(BLOCK - 1, int(np.ceil(PERCENTILE * BLOCK)) - 1)
    widths = np.partition(bits, place, axis=1)[:, place] if blocks else np.zeros(0, np.uint8)
    over = bits > widths[:, None]
    exceptions = over.sum(axis=1).astype(np.int64)
    packed = 2 * widths.astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(packed + (5 * exceptions + 7) // 8)])
    payload = np.zeros(int(starts[-1]), "<u8")
    by_place = np.ascontiguousarray(values.T)
    for width in np.unique(widths[widths > 0]).tolist():
        at = np.flatnonzero(widths == width)
        words = _pack(by_place[:, at] & np.uint64((1 << width) - 1), width)
        payload[starts[at][:, None] + np.arange(2 * width)] = words.T
    raw = payload.view(np.uint8)
    block, position = np.nonzero(over)
    rank = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    base = 8 * (starts[block] + packed[block])
    raw[base + rank] = position
    upper = (values[block, position] >> widths[block].astype(np.uint64)).astype("<u4")
    raw[(base + exceptions[block] + 4 * rank)[:, None] + np.arange(4)] = upper.view(np.uint8).reshape(-1, 4)
    parts = [
        struct.pack(HEADER, MAGIC, 1, BLOCK, n, len(ends), blocks),
        doc_ids.astype("<i8").tobytes(),
        missing.astype(np.uint8).tobytes(),
        ends.astype("<u8").tobytes(),
        starts.astype("<u8").tobytes(),
        least.astype("<u4").tobytes(),
        widths.tobytes(),
        exceptions.astype(np.uint8).tobytes(),
        payload.tobytes(),
    ]
    return b"".join(parts)


class Segment:
    """A segment read from its bytes; ids are unpacked on demand."""

    def __init__(self, body: bytes):
        magic, version, block, self.n, docs, blocks = struct.unpack_from(HEADER, body)
        if magic != MAGIC or version != 1 or block != BLOCK:
            raise ValueError("not a segment of this format")
        at = struct.calcsize(HEADER)

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.missing, self.ends = take("<i8", docs), take("u1", docs), take("<u8", docs)
        self.starts, self.least, self.widths = take("<u8", blocks + 1).astype(np.int64), take("<u4", blocks), take("u1", blocks)
        self.exceptions = take("u1", blocks)
        self.payload = take("<u8", int(self.starts[-1]))

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from ``start`` to ``stop``; only the blocks that hold them are unpacked."""
        stop = self.n if stop is None else min(stop, self.n)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-stop // BLOCK)
        widths, starts = self.widths[first:last].astype(np.int64), self.starts[first:last]
        values = np.zeros((last - first, BLOCK), np.uint64)
        for width in np.unique(widths[widths > 0]).tolist():
            at = np.flatnonzero(widths == width)
            words = np.ascontiguousarray(self.payload[starts[at][:, None] + np.arange(2 * width)].T)
            values[at] = _unpack(words, width).T
        exceptions = self.exceptions[first:last].astype(np.int64)
        block = np.repeat(np.arange(last - first), exceptions)
        if len(block):
            raw = self.payload.view(np.uint8)
            rank = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
            base = 8 * (starts[block] + 2 * widths[block])
            upper = raw[(base + exceptions[block] + 4 * rank)[:, None] + np.arange(4)]
            upper = np.ascontiguousarray(upper).view("<u4").ravel().astype(np.uint64)
            values[block, raw[base + rank]] |= upper << widths[block].astype(np.uint64)
        values += self.least[first:last].astype(np.uint64)[:, None]
        return values.ravel()[start - first * BLOCK : stop - first * BLOCK].astype("<u4")


def _write(batches: Iterable[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    codes, part = word_codes(path), TaskContext.get().partitionId()
    held: list[tuple] = []
    number = before = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, number, before
        doc_ids, counts, ids = (np.concatenate([h[k] for h in held]) for k in (0, 2, 3))
        missing = np.concatenate([h[1] for h in held])
        body = encode_segment(doc_ids, missing, np.cumsum(counts), ids)
        row = [part, number, before, len(ids), len(counts), body]
        kinds = [pa.int64()] * 5 + [pa.binary()]
        held, number, before = [], number + 1, before + len(ids)
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["part", "number", "before", "n_tokens", "n_docs", "body"])

    size = 0
    for rows in byte_slices(batches):
        ids, counts = codes.texts(rows.column("text").to_pylist())
        ids = np.insert(ids, np.cumsum(counts), end_id)
        column = rows.column("doc_id")
        held.append((column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False), counts + 1, ids))
        size += len(ids)
        if size >= SEGMENT:
            yield flush()
            size = 0
    if held:
        yield flush()


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Writes the ids of all documents, each followed by ``end_id``, in ascending order of doc_id to folder ``path``.

    A null text counts as empty; rows without an id come first, rows with the same id in order of a hash of their
    texts; other columns are left out. An empty table gives a folder without segments.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions_for(docs), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    segments = rows.select("doc_id", "text").mapInArrow(partial(_write, path=tokenizer_path, end_id=end_id), SEGMENTS)
    segments.write.option("compression", "uncompressed").parquet(path)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for start, body in zip(rows.column("start").to_pylist(), rows.column("body")):
            segment = Segment(body.as_py())
            ids, ends = segment.ids(), segment.ends.astype(np.int64)
            begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            raw = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32)), pa.py_buffer(ids.tobytes())])
            columns = [pa.array(segment.doc_ids, mask=segment.missing.astype(bool)), pa.array(begins + start), pa.array(ends - begins), raw]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) of each document.

    Ids before a range are summed over one row per written range, of which there are as many as shuffle partitions.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    ranges = segments.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = ranges.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    placed = segments.join(F.broadcast(bases), "part").select((F.col("base") + F.col("before")).alias("start"), "body")
    return placed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")
