"""Byte-pair encoding through a table of distinct words, and decoding through the table of pieces.

1. Tasks split their texts into words and number the distinct ones. A block of documents is kept as numbers, its
   distinct words go to buckets by their hash.
2. A bucket sees each distinct word of the corpus once, however often it occurs, and encodes it once. Every block
   gets the ids of its words back.
3. Blocks join the ids to their documents by position, and the ids to pieces of text by id.

A word that is everywhere reaches its bucket once per block, not once per occurrence. Texts themselves are never
shuffled, only their numbers. Blocks are bounded by ``BLOCK_WORDS``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratusqc.llm.common import byte_slices, partitions_for, text_or_empty
from stratusqc.llm.wordcodes import WordCodes, word_codes

BLOCK_WORDS = 3_000_000
#: Ids put together at a time.
STEP = 1 << 20

SPLIT = "bucket long, block long, words binary, doc_ids array<long>, counts array<long>, numbers binary, homes binary"
SPLIT_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
SPLIT_NAMES = ["bucket", "block", "words", "doc_ids", "counts", "numbers", "homes"]
OWN = ["doc_ids", "counts", "numbers", "homes"]
ENCODED = "block long, bucket long, lengths binary, ids binary, doc_ids array<long>, counts array<long>, numbers binary, homes binary"
ENCODED_SCHEMA = pa.schema(
    [("block", pa.int64()), ("bucket", pa.int64()), ("lengths", pa.binary()), ("ids", pa.binary()), *zip(OWN, SPLIT_KINDS[3:])]
)


def _small(raw: bytes) -> bytes:
    """Compressed, behind its length."""
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _large(raw: bytes) -> bytes:
    return pa.Codec("zstd").decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)


def _squeezed(numbers: np.ndarray) -> bytes:
    """Whole numbers by byte planes, compressed; small ones take little."""
    return _small(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unsqueezed(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(_large(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _listed(words: list[str]) -> bytes:
    texts = [w.encode() for w in words]
    lengths = _squeezed(np.fromiter(map(len, texts), np.int64, len(texts)))
    return len(lengths).to_bytes(8, "little") + lengths + _small(b"".join(texts))


def _words(raw: bytes) -> list[str]:
    cut = 8 + int.from_bytes(raw[:8], "little")
    ends = np.cumsum(_unsqueezed(raw[8:cut])).tolist()
    text = _large(raw[cut:])
    return [text[s:e].decode() for s, e in zip([0, *ends], ends)]


def _gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def _block(part: int, buckets: int, index: dict, numbers: list, counts: list, doc_ids: list) -> pa.RecordBatch:
    whole = np.concatenate(numbers)
    # Frequent words get small numbers, and stand in this order in their buckets too.
    order = np.argsort(-np.bincount(whole, minlength=len(index)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    words = list(index)
    words = [words[k] for k in order.tolist()]
    homes = np.fromiter((crc32(w.encode()) % buckets for w in words), np.int64, len(words))
    by_home = np.argsort(homes, kind="stable")
    cuts = np.searchsorted(homes[by_home], np.arange(buckets + 1))
    by_home = by_home.tolist()
    spans = [(b, s, e) for b, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if e > s]
    rows = [(b, part, _listed([words[k] for k in by_home[s:e]]), None, None, None, None) for b, s, e in spans]
    rows.append((part % buckets, part, None, doc_ids, counts, _squeezed(rank[whole]), _squeezed(homes)))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), SPLIT_KINDS)], names=SPLIT_NAMES)


def _split(batches: Iterable[pa.RecordBatch], path: str, buckets: int) -> Iterator[pa.RecordBatch]:
    codes, part = word_codes(path), TaskContext.get().partitionId() << 24
    index: dict[str, int] = {}
    numbers, counts, doc_ids, held = [], [], [], 0
    for rows in byte_slices(batches):
        split = [codes.words(t) for t in rows.column("text").to_pylist()]
        words = list(chain.from_iterable(split))
        own = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(own < 0).tolist()
        for k in missing:
            index.setdefault(words[k], len(index))
        own[missing] = [index[words[k]] for k in missing]
        numbers.append(own)
        counts += map(len, split)
        doc_ids += rows.column("doc_id").to_pylist()
        held += len(words)
        if held >= BLOCK_WORDS:
            yield _block(part, buckets, index, numbers, counts, doc_ids)
            index, numbers, counts, doc_ids, held, part = {}, [], [], [], 0, part + 1
    if doc_ids:
        yield _block(part, buckets, index, numbers, counts, doc_ids)


def _encode(table: pa.Table, codes: WordCodes) -> pa.Table:
    """Encodes the distinct words of a bucket and answers every block; rows of documents go on as they are."""
    rows = table.to_pylist()
    asked = [(r["block"], r["bucket"], _words(r["words"])) for r in rows if r["words"] is not None]
    order, pool, lengths = codes.encode(list(dict.fromkeys(chain.from_iterable(a[2] for a in asked)))) if asked else ([], None, None)
    index = dict(zip(order, range(len(order))))
    out = [{k: r[k] for k in ("block", "bucket", *OWN)} for r in rows if r["words"] is None]
    for block, bucket, words in asked:
        at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        own = _gather(pool, (np.cumsum(lengths) - lengths)[at], lengths[at])
        out.append({"block": block, "bucket": bucket, "lengths": _squeezed(lengths[at]), "ids": _squeezed(own)})
    return pa.Table.from_pylist(out, schema=ENCODED_SCHEMA)


def pieces(codes: WordCodes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all pieces one after the other, where each id's begins and how many it has."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    back = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    vocabulary = codes.tokenizer.get_vocab(with_added_tokens=True)
    added = codes.tokenizer.get_added_tokens_decoder()
    by_id = {i: piece.encode() if i in added else bytes(back[c] for c in piece) for piece, i in vocabulary.items()}
    texts = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    lengths = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths, lengths


def _assemble(batches: Iterator[pa.RecordBatch], table: tuple) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in b.to_pylist()]
    own = next(r for r in rows if r["doc_ids"] is not None)
    answers = sorted((r for r in rows if r["lengths"] is not None), key=lambda r: r["bucket"])
    nothing = [np.zeros(0, np.int64)]
    by_home = np.concatenate([_unsqueezed(r["lengths"]) for r in answers] or nothing)
    pool = np.concatenate([_unsqueezed(r["ids"]) for r in answers] or nothing)
    # Answers stand bucket after bucket; the words of a bucket in the order of their numbers.
    place = np.argsort(_unsqueezed(own["homes"]), kind="stable")
    lengths, starts = np.empty_like(by_home), np.empty_like(by_home)
    lengths[place], starts[place] = by_home, np.cumsum(by_home) - by_home
    counts = np.array(own["counts"], np.int64)
    numbers = _unsqueezed(own["numbers"])
    word_ends = np.cumsum(counts)
    id_ends = np.concatenate([[0], np.cumsum(lengths[numbers])])[word_ends]
    raw, piece_starts, piece_lengths = table
    first = 0
    while first < len(counts):
        base = id_ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(id_ends, base + STEP, side="right")))
        chosen = numbers[word_ends[first] - counts[first] : word_ends[stop - 1]]
        ids = _gather(pool, starts[chosen], lengths[chosen])
        text = _gather(raw, piece_starts[ids], piece_lengths[ids]).tobytes()
        ends = np.concatenate([[0], id_ends[first:stop] - base])
        cuts = np.concatenate([[0], np.cumsum(piece_lengths[ids])])[ends].tolist()
        texts = [text[s:e].decode("utf-8", "replace") for s, e in zip(cuts, cuts[1:])]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(own["doc_ids"][first:stop], pa.int64()), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])
        first = stop


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids and decoded (the text of those ids) of every row of ``docs``.

    A null text counts as empty and has no ids; null and repeated doc_ids are passed on; other columns are not
    looked at; an empty table gives no rows. Names of special tokens in a text become their ids, as the tokenizer
    has it, and are decoded to their names.
    """
    buckets = partitions_for(docs)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _split(batches, tokenizer_path, buckets)

    def encode(group: pa.Table) -> pa.Table:
        return _encode(group, word_codes(tokenizer_path))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _assemble(batches, pieces_of_worker(tokenizer_path))

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    encoded = given.mapInArrow(split, SPLIT).groupBy("bucket").applyInArrow(encode, ENCODED)
    return encoded.groupBy("block").applyInArrow(assemble, "doc_id long, ids array<int>, decoded string")


def pieces_of_worker(path: str) -> tuple:
    codes = word_codes(path)
    if not hasattr(codes, "pieces"):
        codes.pieces = pieces(codes)
    return codes.pieces
