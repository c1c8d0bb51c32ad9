"""Words of texts as a byte-pair tokenizer sees them, and their token ids.

A tokenizer splits a text into words before it merges, so the ids of a text are the ids of its words in
order. Words repeat, texts hardly do: every task encodes each word once and looks it up afterwards.
A text with characters outside a plain set, or with the name of a special token, is treated as one word,
so that the tokenizer itself decides; its ids are right in every case.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np

from stratusqc.llm.common import kept_by_process

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Characters whose classes are the same in every Unicode version; all else is left to the tokenizer.
UNUSUAL = re.compile(rf"[^\t-\r\x20-\x7e{LETTERS}–—‘’“”…€]")
BYTE_WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^\t-\r {LETTERS}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
LOWER_WORDS = re.compile(rf"'(?:[stmdSTMD]|[rRvV][eE]|[lL][lL])|[{LETTERS}]+|[0-9]|[^\t-\r {LETTERS}0-9]+")
#: Marks a whole text that stands for a word.
WHOLE = "\0"
#: Words kept in one worker process; beyond it the table is started anew.
MOST_WORDS = 600_000
GROUP = 256


class WordCodes:
    """Encodes words with one tokenizer file and remembers them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()))
        self.lower = self.tokenizer.normalizer is not None
        self.pattern = LOWER_WORDS if self.lower else BYTE_WORDS
        #: Bytes that a token stands for, or 1 where a token ends its word.
        self.measure = np.zeros(max(vocab.values()) + 1, np.int64)
        for piece, i in vocab.items():
            self.measure[i] = piece.endswith("</w>") if self.lower else len(piece)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.size = 0
        self.pool = np.zeros(1 << 16, np.uint16)
        self.lengths = np.zeros(1 << 15, np.int32)
        self.starts = np.zeros(1 << 15, np.int64)

    def words(self, text: str) -> list[str]:
        if (not text.isascii() or "\0" in text or "\x7f" in text or not text.isprintable()) and UNUSUAL.search(text) or "<|" in text and self.special.search(text):
            return [WHOLE + text]
        return self.pattern.findall(text)

    def encode(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words in another order, the ids of all of them one after the other, and how many each has.

        Words are given to the tokenizer many at a time where their bounds can be told afterwards.
        """
        if self.lower:
            joined = [w for w in words if w[0] != WHOLE]
        else:
            joined = [w for w in words if w[0] == " " and len(w) > 1 and w[1] not in "\t\n\v\f\r "]
        groups = [joined[i : i + GROUP] for i in range(0, len(joined), GROUP)]
        glue = " " if self.lower else ""
        order, ids, lengths = [], [], []
        done = set(joined)
        alone = [w for w in words if w not in done]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast([glue.join(g) for g in groups], add_special_tokens=False)):
            got = np.array(e.ids, np.uint16)
            marks = np.cumsum(self.measure[got])
            wanted = np.arange(1, len(g) + 1) if self.lower else np.cumsum([len(w.encode()) for w in g])
            ends = np.searchsorted(marks, wanted) + 1
            if not len(got) or marks[-1] != wanted[-1] or (marks[np.minimum(ends, len(got)) - 1] != wanted).any():
                alone += g
                continue
            order += g
            ids.append(got)
            lengths.append(np.diff(ends, prepend=0))
        for w, e in zip(alone, self.tokenizer.encode_batch_fast([w[w[0] == WHOLE :] for w in alone], add_special_tokens=False)):
            order.append(w)
            ids.append(np.array(e.ids, np.uint16))
            lengths.append(np.array([len(e.ids)]))
        return order, np.concatenate(ids), np.concatenate(lengths)

    def codes(self, words: list[str]) -> np.ndarray:
        """Place of each word in the table of this process."""
        if len(self.index) > MOST_WORDS or self.size > 16 * MOST_WORDS:
            self.clear()
        codes = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(codes < 0).tolist()
        if missing:
            self._add(*self.encode(list(dict.fromkeys([words[i] for i in missing]))))
            codes[missing] = [self.index[words[i]] for i in missing]
        return codes

    def _add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first, count = len(self.index), len(words)
        while self.size + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while first + count > len(self.lengths):
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.pool[self.size : self.size + len(ids)] = ids
        self.lengths[first : first + count] = lengths
        self.starts[first : first + count] = self.size + np.cumsum(lengths) - lengths
        self.size += len(ids)
        self.index.update(zip(words, range(first, first + count)))

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        split = [self.words(t) for t in texts]
        codes = self.codes(list(chain.from_iterable(split)))
        lengths = self.lengths[codes].astype(np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.starts[codes] - (ends - lengths), lengths) + np.arange(total)]
        words = np.cumsum([0, *map(len, split)])
        marks = np.concatenate([[0], ends])[words]
        return ids, np.diff(marks)


def word_codes(path: str) -> WordCodes:
    """One table per worker process, kept from task to task."""
    kept = kept_by_process()
    if path not in kept:
        kept[path] = WordCodes(path)
    return kept[path]
