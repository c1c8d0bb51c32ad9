"""Hashed word shingles of many texts at a time, with arrays over their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from stratusqc.llm.common import kept_by_process, mix64, text_bytes

_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

def _powers(n: int) -> list[np.ndarray]:
    """Powers of the step and of its inverse; not a global, which would travel with every job."""
    kept = kept_by_process()
    if len(kept.get("powers", ((),))[0]) < n:
        kept["powers"] = []
        for step in (_STEP, _STEP_BACK):
            full = np.full(n, step, np.uint64)
            full[0] = 1
            kept["powers"].append(np.cumprod(full, dtype=np.uint64))
    return kept["powers"]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts in lower case (A-Z only), where each word begins and ends, and how many words each text has."""
    raw, starts = text_bytes(texts)
    if not len(raw):
        return raw, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts) - 1, np.int64)
    inside = ~_IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[starts] = True
    first = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1]))
    last = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1
    return _LOWER[raw], first, last, np.diff(np.searchsorted(first, starts))


def stretch_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes, from sums over powers."""
    powers, back = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * powers[: len(raw)], out=sums[1:])
    return mix64((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, A-Z as a-z, and how many words each text has."""
    raw, first, last, counts = words(texts)
    return stretch_hashes(raw, first, last), counts


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, one text after the other, and how many each has.

    A text with fewer words than ``size`` has its whole sequence of words as its one shingle; without words it has none.
    """
    hashed, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    begins = ends - counts
    hashes, owners = [], []
    for length in range(1, size + 1):
        texts_here = np.flatnonzero(counts == length if length < size else counts >= size)
        if not len(texts_here):
            continue
        windows = counts[texts_here] - length + 1
        owner = np.repeat(texts_here, windows)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + begins[owner]
        folded = np.full(len(at), length, np.uint64)
        for k in range(length):
            folded = mix64(folded * np.uint64(0xA24BAED4963EE407) + hashed[at + k])
        hashes.append(folded)
        owners.append(owner)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    shingles, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    return shingles[new], np.bincount(owner[new], minlength=len(counts))
