"""Words of many texts as arrays over their bytes."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from stratusqc.llm.common import text_bytes

#: Bytes between words: blank and the characters 9 to 13.
BLANKS = np.zeros(256, bool)
BLANKS[[32, 9, 10, 11, 12, 13]] = True


class Words(NamedTuple):
    """Bytes of all words without what stands between them, the length of each word, and the words of each text."""

    letters: np.ndarray
    lengths: np.ndarray
    counts: np.ndarray

    def strings(self) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        return pa.LargeStringArray.from_buffers(len(self.lengths), pa.py_buffer(offsets), pa.py_buffer(self.letters))


def split_words(texts: pa.Array, between: np.ndarray, lower: np.ndarray | None = None) -> Words:
    """The longest stretches of bytes that are not ``between``; nulls must have been replaced before.

    ``lower`` maps bytes before they are looked at. Bytes of characters outside ASCII have to be treated alike, so that
    no character is torn.
    """
    raw, starts = text_bytes(texts)
    if lower is not None:
        raw = lower[raw]
    if not len(raw):
        return Words(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(len(starts) - 1, np.int64))
    inside = ~between[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[starts] = True
    first = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1]))
    last = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1
    return Words(np.ascontiguousarray(raw[inside]), last - first, np.diff(np.searchsorted(first, starts)))


def joined_by_blank(words: Words, kept: np.ndarray) -> pa.Array:
    """One text for each text: its kept words with one blank between neighbours."""
    owner = np.repeat(np.arange(len(words.counts)), words.counts)[kept]
    lengths = words.lengths[kept]
    last = np.ones(len(owner), bool)
    last[:-1] = owner[1:] != owner[:-1]
    room = lengths + ~last
    at = np.cumsum(room) - room
    out = np.full(int(room.sum()), 32, np.uint8)
    letters = words.letters[np.repeat(kept, words.lengths)]
    out[np.arange(len(letters)) + np.repeat(at - (np.cumsum(lengths) - lengths), lengths)] = letters
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=room, minlength=len(words.counts)).astype(np.int64))])
    return pa.LargeStringArray.from_buffers(len(words.counts), pa.py_buffer(offsets), pa.py_buffer(out))
