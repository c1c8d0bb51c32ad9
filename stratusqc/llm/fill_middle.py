"""Fill-in-the-middle documents, cut at token counts that content-defined chunks remember.

A text is cut into chunks where a rolling hash over its last bytes says so, so that equal passages give equal chunks
wherever they stand. For each chunk a summary is kept under the chunk's own bytes: how many tokens and characters it
has, and whether it begins and ends inside a run of letters. Only chunks that the worker hasn't met are counted; a
chunk that it has met is found by its hash and verified by its bytes. Summaries combine: a run of letters that crosses
from one chunk into the next counts once. Running totals over a document's chunks give its number of tokens and name
the chunk in which a cut lies, and only that chunk is looked at again.

Tokens are runs of ASCII letters and single other characters. Chunks may part a character of several bytes: only its
first byte counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratusqc.llm.common import byte_slices, kept_by_process, mix64, text_bytes, text_or_empty

MARKS = ("<P>", "<S>", "<M>")
#: Bytes that the rolling hash sees, and mean, least and greatest bytes of a chunk.
WINDOW, MEAN, LEAST, MOST = 16, 512, 64, 8192
#: Bytes of chunks that one worker process remembers; beyond it the table is started anew.
REMEMBERED = 32 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_FIRST = (np.arange(256) & 0xC0) != 0x80
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def chunk_starts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the chunks of all texts begin, and the end of the last; ``starts`` are those of the texts and the end.

    A text's chunks depend on that text alone.
    """
    cuts = np.zeros(0, np.int64)
    if len(raw) > WINDOW:
        # The hash of a window: its bytes' values, each turned by its distance from the end.
        rolled = np.zeros(len(raw) - WINDOW + 1, np.uint64)
        values = _BYTES[raw]
        for k in range(WINDOW):
            part = values[k : k + len(rolled)]
            turn = np.uint64(4 * (WINDOW - 1 - k))
            rolled ^= (part << turn) | (part >> (np.uint64(64) - turn)) if turn else part
        cuts = np.flatnonzero(rolled % np.uint64(MEAN - LEAST) == 0) + WINDOW
    out = []
    at = np.searchsorted(cuts, starts)
    for k in range(len(starts) - 1):
        begin, end = int(starts[k]), int(starts[k + 1])
        last = begin
        if begin < end:
            out.append(begin)
        for cut in [*cuts[at[k] : at[k + 1]].tolist(), end]:
            # Windows that reach back into the text before don't count.
            if cut != end and (cut - last < LEAST or cut - WINDOW < begin):
                continue
            out += range(last + MOST, cut, MOST)
            if cut != end:
                out.append(cut)
            last = cut
    return np.array([*out, starts[-1]], np.int64)


def token_starts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """At which bytes a token begins, if the stretches that begin at ``starts`` stand alone."""
    letter = _LETTER[raw]
    after = np.zeros(len(raw), bool)
    after[1:] = letter[:-1]
    after[starts[starts < len(raw)]] = False
    return np.where(letter, ~after, _FIRST[raw])


def gathered(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all given stretches, one after the other, and where each begins there, with the end."""
    lengths = end - begin
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return raw[np.arange(bounds[-1]) + np.repeat(begin - bounds[:-1], lengths)], bounds


class ChunkTable:
    """Summaries of chunks under the chunks' bytes: tokens, characters, begins with a letter, ends with a letter."""

    def __init__(self):
        self.kept: dict[bytes, tuple[int, int, int, int]] = {}
        self.size = self.counted = self.met = 0

    def summaries(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        data = raw.tobytes()
        marks = bounds.tolist()
        chunks = [data[a:b] for a, b in zip(marks[:-1], marks[1:])]
        if self.size > REMEMBERED:
            self.kept.clear()
            self.size = 0
        # Looking a chunk up compares its bytes with those of the chunk that has the same hash.
        unseen = list(dict.fromkeys(c for c in chunks if c not in self.kept))
        self.counted += len(unseen)
        self.met += len(chunks)
        if unseen:
            fresh = np.frombuffer(b"".join(unseen), np.uint8)
            ends = np.cumsum([len(c) for c in unseen])
            starts = np.concatenate([[0], ends[:-1]])
            tokens = np.add.reduceat(token_starts(fresh, starts).astype(np.int64), starts)
            chars = np.add.reduceat(_FIRST[fresh].astype(np.int64), starts)
            rows = zip(tokens.tolist(), chars.tolist(), _LETTER[fresh[starts]].tolist(), _LETTER[fresh[ends - 1]].tolist())
            self.kept.update(zip(unseen, rows))
            self.size += len(fresh)
        return np.array([self.kept[c] for c in chunks], np.int64).reshape(-1, 4)


def chunk_table() -> ChunkTable:
    kept = kept_by_process()
    if "chunk_table" not in kept:
        kept["chunk_table"] = ChunkTable()
    return kept["chunk_table"]


class Counted:
    """Token counts of texts from the summaries of their chunks, and the places of cuts."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, table: ChunkTable):
        self.raw, self.starts = raw, starts
        self.bounds = chunk_starts(raw, starts)
        summary = table.summaries(raw, self.bounds)
        begins = self.bounds[:-1]
        follows = np.ones(len(begins), bool)
        follows[np.searchsorted(begins, starts[:-1][starts[:-1] < starts[1:]])] = False
        ends_with = np.concatenate([[0], summary[:-1, 3]]) if len(summary) else np.zeros(0, np.int64)
        #: Whether a chunk goes on with the letters of the chunk before it.
        self.crossed = follows & (ends_with > 0) & (summary[:, 2] > 0)
        self.tokens = np.concatenate([[0], np.cumsum(summary[:, 0] - self.crossed)])
        self.chars = np.concatenate([[0], np.cumsum(summary[:, 1])])
        self.first = np.searchsorted(begins, starts)  # a text's first chunk, and one behind the last text's
        self.counts = self.tokens[self.first[1:]] - self.tokens[self.first[:-1]]

    def cut(self, texts: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The byte in front of which ``units`` tokens of each of ``texts`` end, and how many characters are before it."""
        place, chars = self.starts[texts].copy(), np.zeros(len(texts), np.int64)
        whole = units >= self.counts[texts]
        place[whole] = self.starts[texts[whole] + 1]
        chars[whole] = self.chars[self.first[texts[whole] + 1]] - self.chars[self.first[texts[whole]]]
        inner = np.flatnonzero(~whole & (units > 0))
        if len(inner):
            text, first = texts[inner], self.first[texts[inner]]
            target = self.tokens[first] + units[inner]  # tokens before the one that begins at the cut
            chunk = np.searchsorted(self.tokens, target, side="right") - 1
            bytes_, bounds = gathered(self.raw, self.bounds[chunk], self.bounds[chunk + 1])
            begins = token_starts(bytes_, bounds[:-1])
            begins[bounds[:-1][self.crossed[chunk]]] = False
            seen = np.concatenate([[0], np.cumsum(begins)])
            at = np.searchsorted(seen, seen[bounds[:-1]] + target - self.tokens[chunk] + 1) - 1
            place[inner] = self.bounds[chunk] + at - bounds[:-1]
            known = np.concatenate([[0], np.cumsum(_FIRST[bytes_])])
            chars[inner] = self.chars[chunk] - self.chars[first] + known[at] - known[bounds[:-1]]
        return place, chars


def _transform(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks = [m.encode() for m in MARKS]
    p, s, m = marks
    for rows in byte_slices(batches):
        raw, starts = text_bytes(rows.column("text"))
        counted = Counted(raw, starts, chunk_table())
        draw_a, draw_b, draw_plain, draw_order = (rows.column(f"draw_{k}").to_numpy() for k in range(1, 5))
        n, texts = counted.counts, np.arange(rows.num_rows)
        a, b = draw_a % (n + 1), draw_b % (n + 1)
        (first, first_chars), (second, second_chars) = counted.cut(texts, np.minimum(a, b)), counted.cut(texts, np.maximum(a, b))
        data, forms, outputs = raw.tobytes(), [], []
        plain = (draw_plain > 0) | (n == 0)
        for k, (begin, cut, other, end) in enumerate(zip(starts[:-1].tolist(), first.tolist(), second.tolist(), starts[1:].tolist())):
            text = data[begin:end]
            if plain[k] or any(x in text for x in marks):
                plain[k] = True
                forms.append("plain")
                outputs.append(text)
                continue
            prefix, middle, suffix = text[: cut - begin], text[cut - begin : other - begin], text[other - begin :]
            forms.append("spm" if draw_order[k] else "psm")
            outputs.append(b"".join((s, suffix, p, prefix, m, middle) if draw_order[k] else (p, prefix, s, suffix, m, middle)))
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(n), pa.array(forms), pa.array(first_chars, mask=plain), pa.array(second_chars - first_chars, mask=plain),
             pa.array(outputs, pa.binary()).cast(pa.string())],
            names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars and output of every row.

    What is drawn for a row depends on ``seed`` and its id alone, so that reruns give the same output. Texts that are
    empty or hold one of the marks stay plain, as do ``plain_percent`` of all; ``spm_percent`` of the others have the
    suffix first. A null text counts as empty, a null id as the empty string; repeated rows are treated row by row, rows
    with one id alike. An empty table gives no rows. Columns besides doc_id and text are not looked at.
    """
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(name, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_or_empty().alias("text"),
        draws[0].alias("draw_1"),
        draws[1].alias("draw_2"),
        (draws[2] % 100 >= 100 - plain_percent).cast("long").alias("draw_3"),
        (draws[3] % 100 < spm_percent).cast("long").alias("draw_4"),
    )
    return texts.mapInArrow(_transform, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of.

    Texts with marks in them are plain, so that the marks of the others part them exactly.
    """
    parts = F.split(output, "|".join(MARKS), -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
