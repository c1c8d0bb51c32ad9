"""Packing of documents into training windows by the sum-of-squares rule.

Every task packs the documents of its own partition, so nothing is shuffled. Full windows of a long document
are sequences of their own. What is left of it goes, uncut, into an open window: of all fill levels that
still have room, the one that leaves the smallest sum of squared counts of open windows per level. The counts
stand in an array with one entry per level, so a placement costs a fixed number of steps.

Of the windows that are open at the end of a partition the well-filled ones stay as they were placed. The emptiest are
taken apart, as few as it takes to fill the others' gaps, and only the last of their pieces are cut. What then is left,
less than a window, is cut at powers of two. Hence a partition, whatever its size, pads nothing. At most ``MOST_OPEN``
windows are open at a time; beyond that they are closed in the same way.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratusqc.llm.common import byte_slices, text_or_empty
from stratusqc.llm.wordcodes import word_codes

WINDOW = 2048
END_ID = 1
MOST_OPEN = 4096

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Packer:
    """Fill levels of open windows and the pieces in them."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.next = window, first_sequence
        self.rows: list[tuple] = []
        #: Tokens of windows that were taken apart, and cuts made then.
        self.moved = self.cut = 0
        self._empty()

    def _empty(self) -> None:
        self.open = 0
        self.windows: list[list[list]] = [[] for _ in range(self.window)]
        #: What one more window at a level adds to the sum of squares; a full window counts nowhere.
        self.adds = np.ones(self.window + 1, np.int64)
        self.adds[self.window] = 0
        #: What one window less at a level takes from it; a level without windows can't be chosen.
        self.takes = np.full(self.window, -(1 << 40), np.int64)
        self.takes[0] = 0

    def _count(self, level: int, by: int) -> None:
        if 0 < level < self.window:
            self.open += by
            self.adds[level] += 2 * by
            self.takes[level] = self.adds[level] - 2 if self.adds[level] > 1 else -(1 << 40)

    def level_for(self, length: int) -> int:
        """The fill level to place a piece at; of equal ones the fullest."""
        room = self.window - length
        change = self.adds[length : length + room + 1] - self.takes[: room + 1] if room < self.window else self.adds[length:] - self.takes
        return room - int(np.argmin(change[::-1]))

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.window:
            self._close([(doc_id, start, total, ids[start : start + self.window])])
            start += self.window
        if start == total:
            return
        length = total - start
        level = self.level_for(length)
        held = self.windows[level].pop() if level else []
        held.append((doc_id, start, total, ids[start:].copy()))
        self._count(level, -1)
        self._count(level + length, 1)
        if level + length == self.window:
            self._close(held)
        else:
            self.windows[level + length].append(held)
            if self.open > MOST_OPEN:
                self.finish()

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, total, ids in pieces:
            self.rows.append((doc_id, start, len(ids), total, self.next, offset, ids.astype("<u4").tobytes()))
            offset += len(ids)
        self.next += 1

    def finish(self) -> None:
        """Closes all open windows full: the emptiest give their pieces to the gaps of the others.

        Only as many windows are taken apart as the gaps need. Their pieces go whole into the tightest gap that holds
        them; the gaps that are left are filled by cutting, and what is left of the pieces, less than a window, is cut
        at powers of two.
        """
        windows = [(level, held) for level in range(len(self.windows) - 1, 0, -1) for held in self.windows[level]]
        self._empty()
        kept, given, gaps = len(windows), 0, sum(self.window - level for level, _ in windows)
        while kept and given < gaps:
            kept -= 1
            given += windows[kept][0]
            gaps -= self.window - windows[kept][0]
        spare = sorted((p for _, held in windows[kept:] for p in held), key=lambda p: -len(p[3]))
        self.moved += given
        # Kept windows by their gaps, the tightest first.
        open_ = [(self.window - level, k, windows[k][1]) for k, (level, _) in enumerate(windows[:kept])]
        rest = []
        for piece in spare:
            at = bisect_left(open_, (len(piece[3]),))
            if at == len(open_):
                rest.append(piece)
                continue
            gap, k, held = open_.pop(at)
            held.append(piece)
            if gap == len(piece[3]):
                self._close(held)
            else:
                insort(open_, (gap - len(piece[3]), k, held))
        left = sum(len(p[3]) for p in rest)
        for doc_id, start, total, ids in rest:
            while len(ids):
                if not open_:
                    open_.append((min(self.window, 1 << (left.bit_length() - 1)), -1, []))
                gap, k, held = open_[-1]
                cut = ids[:gap]
                held.append((doc_id, start, total, cut))
                self.cut += len(cut) < len(ids)
                start, ids, left = start + len(cut), ids[len(cut) :], left - len(cut)
                open_[-1] = (gap - len(cut), k, held)
                if gap == len(cut):
                    self._close(open_.pop()[2])

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 7
        self.rows = []
        kinds = [pa.int64()] * 6 + [pa.binary()]
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``PIECES``; ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers.

    ``docs`` needs doc_id and text; other columns are not looked at. A null text counts as empty and still has
    its end id; rows with a null or repeated doc_id are documents of their own. An empty table gives no rows.
    """
    if window & (window - 1) or not 1 < window <= 1 << 20:
        raise ValueError("the window must be a power of two")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = word_codes(tokenizer_path)
        packer = Packer(window, TaskContext.get().partitionId() << 32)
        for part in byte_slices(batches):
            ids, counts = codes.texts(part.column("text").to_pylist())
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id)
            ends += np.arange(1, len(ends) + 1)
            begin = 0
            for doc_id, end in zip(part.column("doc_id").to_pylist(), ends.tolist()):
                packer.add(doc_id, ids[begin:end])
                begin = end
            yield packer.taken()
        packer.finish()
        yield packer.taken()

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return wanted.mapInArrow(run, PIECES)
