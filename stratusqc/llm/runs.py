"""Periodic runs of words, through a dictionary of basic factors.

A run is a stretch of words with smallest period q that holds at least ``repeats`` periods and ``least`` words and can't
be made longer. The dictionary names, for each power of two, all factors of that length that occur more than once in
their text; equal factors have equal names. At each length every occurrence is set against its successor; successors
within twice the factor's length that follow each other at one distance form arithmetic progressions, and each
progression proposes its difference as a period. The dictionary then tells in as many steps as it has lengths how far a
proposal reaches to both sides. Several lengths propose the same run, and multiples of its period do too; of equal
stretches the smallest period stays.

Why no run is missed: take the power of two with q <= 2^k < 2q. Inside the run a factor of that length recurs after q
words and not before, and with four periods it is there at least three times in a row.

All work is on arrays over slices of about a megabyte of text. A longer text is a slice of its own and needs about four
bytes a word for every length at which something recurs; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratusqc.llm.common import byte_slices, text_or_empty
from stratusqc.llm.word_arrays import BLANKS, joined_by_blank, split_words

RUN = "struct<start:long,length:long,period:long>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Factors:
    """The dictionary: for each power of two, a name at every place whose factor recurs in its text, else -1.

    ``codes`` are the words of all texts, one after the other; ``counts`` how many words each text has.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        ends = np.cumsum(counts)
        self.start, self.end = np.repeat(ends - counts, counts), np.repeat(ends, counts)
        self.names: list[np.ndarray] = []
        self.proposals: list[tuple[np.ndarray, np.ndarray]] = []
        owner = np.repeat(np.arange(len(counts)), counts)
        places = np.arange(len(codes))
        key = owner * (int(codes.max(initial=0)) + 1) + codes
        length = 1
        while len(places):
            names, places = self._level(places, key, length)
            if not len(places):
                break
            self.names.append(names)
            # Both halves of a longer factor that recurs recur too.
            fits = places + 2 * length <= self.end[places]
            places = places[fits]
            second = names[places + length]
            places, second = places[second >= 0], second[second >= 0]
            key = names[places].astype(np.int64) * (int(names.max(initial=0)) + 1) + second
            length *= 2

    def _level(self, places: np.ndarray, key: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        at, sorted_key = places[order], key[order]
        equal = sorted_key[1:] == sorted_key[:-1]
        recurs = np.zeros(len(at), bool)
        recurs[1:] |= equal
        recurs[:-1] |= equal
        number = np.cumsum(np.concatenate([[0], ~equal]))
        names = np.full(len(self.end), -1, np.int32)
        names[at[recurs]] = number[recurs]
        # Distance to the successor, 0 where there is none within twice the length.
        apart = np.diff(at)
        near = equal & (apart <= 2 * length)
        successor = np.zeros(len(self.end), np.int64)
        successor[at[:-1][near]] = apart[near]
        here = np.flatnonzero(successor)
        here = here[successor[here + successor[here]] == successor[here]]
        step = successor[here]
        # Neighbouring places with one distance belong to one stretch, which is proposed once.
        new = np.ones(len(here), bool)
        new[1:] = (np.diff(here) != 1) | (np.diff(step) != 0)
        self.proposals.append((here[new], step[new]))
        return names, np.sort(at[recurs])

    def equal_ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and from b on, b being behind a in the same text, are the same."""
        total = np.zeros(len(a), np.int64)
        end = self.end[a]
        for k in range(len(self.names) - 1, -1, -1):
            fits = b + total + (1 << k) <= end
            i, j = np.where(fits, a + total, 0), np.where(fits, b + total, 0)
            same = fits & (self.names[k][i] >= 0) & (self.names[k][i] == self.names[k][j])
            total += same.astype(np.int64) << k
        return total

    def equal_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words in front of a and in front of b are the same."""
        total = np.zeros(len(a), np.int64)
        start = self.start[a]
        for k in range(len(self.names) - 1, -1, -1):
            fits = a - total - (1 << k) >= start
            i, j = np.where(fits, a - total - (1 << k), 0), np.where(fits, b - total - (1 << k), 0)
            same = fits & (self.names[k][i] >= 0) & (self.names[k][i] == self.names[k][j])
            total += same.astype(np.int64) << k
        return total

    def runs(self, least: int, repeats: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end (exclusive) and period of all runs by start, then period; places count over all texts."""
        if not self.proposals:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, period = (np.concatenate(x) for x in zip(*self.proposals))
        start, end = at - self.equal_before(at, at + period), at + period + self.equal_ahead(at, at + period)
        enough = end - start >= np.maximum(least, repeats * period)
        start, end, period = start[enough], end[enough], period[enough]
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        first = np.ones(len(start), bool)
        first[1:] = (np.diff(start) != 0) | (np.diff(end) != 0)
        start, end, period = start[first], end[first], period[first]
        order = np.lexsort((period, start))
        return start[order], end[order], period[order]


def _find(batches: Iterable[pa.RecordBatch], least: int, repeats: int) -> Iterator[pa.RecordBatch]:
    for rows in byte_slices(batches):
        words = split_words(rows.column("text"), BLANKS)
        codes = words.strings().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        factors = Factors(codes, words.counts)
        start, end, period = factors.runs(least, repeats)
        # A word goes if a run holds it behind the run's first period.
        change = np.zeros(len(codes) + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, end, -1)
        kept = np.cumsum(change[:-1]) == 0
        begins = np.cumsum(words.counts) - words.counts
        owner = np.searchsorted(begins + words.counts, start, side="right")
        found = pa.StructArray.from_arrays([pa.array(start - begins[owner]), pa.array(end - start), pa.array(period)], fields=list(_RUN))
        bounds = np.searchsorted(owner, np.arange(len(words.counts) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(words.counts), pa.ListArray.from_arrays(pa.array(bounds), found), joined_by_blank(words, kept).cast(pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )


def find_runs(docs: DataFrame, least: int = 6, repeats: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start, then period) and collapsed of every row.

    ``collapsed`` has the words that no run holds behind its first period, joined by one blank. Words are what stands
    between blanks and the characters 9 to 13. A null text counts as empty and, like all texts without words, has no
    runs and an empty collapsed text. Null and repeated ids stay as they are, row by row; an empty table gives no rows;
    columns besides doc_id and text are not looked at. ``repeats`` is at least four: with fewer a progression of three
    occurrences need not exist.
    """
    if repeats < 4 or least < 1:
        raise ValueError("runs need four repeats and one word at least")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return texts.mapInArrow(partial(_find, least=least, repeats=repeats), f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")
