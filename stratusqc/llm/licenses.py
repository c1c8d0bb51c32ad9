"""Licence scans through a positional index of rare words.

Templates are licence names and notices. For each template its words with the highest inverse document frequency over
all documents are its anchors; the index lists, for each such word, the templates and positions where it stands. The
words of a file are looked up in that index. An occurrence at word p of a word that a template has at t says that the
template may begin at p - t; occurrences that agree on one beginning are intersected there, each counting by its
frequency weight. A beginning that gathers enough weight is an alignment. It becomes a finding once the whole template
is compared at that place and all of the template's mandatory key phrases are found next to it.

Names of the base list are templates as well: there all words are mandatory, so a finding is a place where the phrase
stands word for word.

The frequencies come from one counting pass over all documents, of which only one number for each word of the templates
reaches the driver; the index is as large as the templates are and travels with the job. Each file is then scanned
where it is read; nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratusqc.llm.common import byte_slices, text_or_empty
from stratusqc.llm.word_arrays import split_words


class Template(NamedTuple):
    label: str
    words: str
    #: Phrases that have to stand word for word next to an alignment; none means the whole template.
    phrases: tuple[str, ...] = ()


#: Names whose every place counts.
BASE = (Template("mit", "mit license"), Template("apache", "apache license"), Template("gpl", "general public license"))

#: Notices by which works name their licence.
NOTICES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("free of charge", "obtaining a copy")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license", "version 2")),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license", "version 3")),
    Template("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2")),
    Template("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3", ("affero general public license", "version 3")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "with or without modification")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "2 0")),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license", "2 0")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0",)),
    Template("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    Template("mit", "spdx license identifier mit", ("spdx license identifier mit",)),
    Template("apache-2.0", "spdx license identifier apache 2 0", ("spdx license identifier apache 2 0",)),
    Template("gpl-2.0", "spdx license identifier gpl 2 0", ("spdx license identifier gpl 2 0",)),
    Template("gpl-3.0", "spdx license identifier gpl 3 0", ("spdx license identifier gpl 3 0",)),
    Template("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)

#: Words of a template that the index lists, rarest first.
ANCHORS = 4
#: Share of its anchors' weight that an alignment needs, and words by which a key phrase may lie outside it.
ENOUGH, SLACK = 0.5, 3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False

FOUND = "struct<start:long,words:long,label:string,base:boolean,share:double>"
_FOUND = pa.struct([("start", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("base", pa.bool_()), ("share", pa.float64())])


class Index:
    """The templates as word numbers, their anchors and the postings of each anchor."""

    def __init__(self, base: tuple[Template, ...], notices: tuple[Template, ...], frequencies: dict[str, int] | None = None, documents: int = 0):
        self.templates = [*base, *notices]
        self.n_base = len(base)
        self.vocabulary = sorted({w for t in self.templates for w in " ".join([t.words, *t.phrases]).split()})
        number = {w: k for k, w in enumerate(self.vocabulary)}
        coded = lambda phrase: np.array([number[w] for w in phrase.split()], np.int64)
        self.words = [coded(t.words) for t in self.templates]
        self.phrases = [[coded(p) for p in (t.phrases or (t.words,))] for t in self.templates]
        frequencies = frequencies or {}
        self.weight = np.array([1 + math.log((documents + 1) / (frequencies.get(w, 0) + 1)) for w in self.vocabulary])
        postings: list[list[tuple[int, int]]] = [[] for _ in self.vocabulary]
        self.total = np.zeros(len(self.templates))
        for t, words in enumerate(self.words):
            # Rarest words first; ties by place, so that every task picks the same.
            anchors = sorted(range(len(words)), key=lambda i: (-self.weight[words[i]], i))
            for i in anchors if t < self.n_base else anchors[:ANCHORS]:
                postings[words[i]].append((t, i))
                self.total[t] += self.weight[words[i]]
        self.counts = np.array([len(p) for p in postings], np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        flat = np.array([x for p in postings for x in p], np.int64).reshape(-1, 2)
        self.template, self.position = flat[:, 0], flat[:, 1]

    def alignments(self, codes: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, template and beginning of all alignments; given are a word's number, text and place for words of templates."""
        hits = self.counts[codes]
        row = np.repeat(np.arange(len(codes)), hits)
        posting = np.arange(len(row)) - np.repeat(np.cumsum(hits) - hits, hits) + self.first[codes[row]]
        template, begin, text = self.template[posting], place[row] - self.position[posting], owner[row]
        order = np.lexsort((begin, template, text))
        template, begin, text, votes = template[order], begin[order], text[order], self.weight[codes[row]][order]
        if not len(order):
            return text, template, begin
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(text) != 0) | (np.diff(template) != 0) | (np.diff(begin) != 0)
        at = np.flatnonzero(new)
        gathered = np.add.reduceat(votes, at)
        need = np.where(template[at] < self.n_base, 1.0, ENOUGH) * self.total[template[at]]
        at = at[gathered >= need - 1e-9]
        return text[at], template[at], begin[at]

    def findings(self, words: dict[int, int], template: int, begin: int) -> float | None:
        """Weighted share of the template's words that stand at this alignment, or None if a key phrase is missing.

        ``words`` has the numbers of one text's words of templates by their places.
        """
        own = self.words[template]
        if template < self.n_base:
            return 1.0 if all(words.get(begin + i) == w for i, w in enumerate(own.tolist())) else None
        for phrase in self.phrases[template]:
            wanted = phrase.tolist()
            tries = range(begin - SLACK, begin + len(own) + SLACK - len(wanted) + 1)
            if not any(all(words.get(p + i) == w for i, w in enumerate(wanted)) for p in tries):
                return None
        weights = self.weight[own]
        return float(sum(x for i, (x, w) in enumerate(zip(weights, own.tolist())) if words.get(begin + i) == w) / weights.sum())


def _coded(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number, text and place of every word that templates have, and how many words each text has."""
    words = split_words(texts, _BETWEEN, _LOWER)
    codes = pc.index_in(words.strings(), value_set=vocabulary)
    known = np.flatnonzero(codes.is_valid().to_numpy(zero_copy_only=False))
    owner = np.repeat(np.arange(len(words.counts)), words.counts)[known]
    begins = np.cumsum(words.counts) - words.counts
    return codes.drop_null().to_numpy().astype(np.int64), owner, known - begins[owner], words.counts


def _count(batches: Iterable[pa.RecordBatch], vocabulary: list[str]) -> Iterator[pa.RecordBatch]:
    values, total, rows_seen = pa.array(vocabulary, pa.large_string()), np.zeros(len(vocabulary), np.int64), 0
    for rows in byte_slices(batches):
        codes, owner, _, _ = _coded(rows.column("text"), values)
        total += np.bincount(np.unique(owner * len(vocabulary) + codes) % len(vocabulary), minlength=len(vocabulary))
        rows_seen += rows.num_rows
    yield pa.RecordBatch.from_arrays([pa.array([*vocabulary, None], pa.string()), pa.array([*total.tolist(), rows_seen])], names=["word", "n"])


def build_index(docs: DataFrame, base: tuple[Template, ...] = BASE, notices: tuple[Template, ...] = NOTICES) -> Index:
    """The index with the document frequencies of all rows of ``docs``; the driver gets one number for each word."""
    vocabulary = Index(base, notices).vocabulary
    counts = docs.select(text_or_empty().alias("text")).mapInArrow(partial(_count, vocabulary=vocabulary), "word string, n long")
    found = {r["word"]: r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return Index(base, notices, found, found.get(None, 0))


def _scan(batches: Iterable[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    values = pa.array(index.vocabulary, pa.large_string())
    for rows in byte_slices(batches):
        codes, owner, place, counts = _coded(rows.column("text"), values)
        texts, templates, begins = index.alignments(codes, owner, place)
        bounds = np.searchsorted(owner, np.arange(rows.num_rows + 1))
        found: list[list[dict]] = [[] for _ in range(rows.num_rows)]
        last, words = -1, {}
        for text, template, begin in zip(texts.tolist(), templates.tolist(), begins.tolist()):
            if text != last:
                own = slice(bounds[text], bounds[text + 1])
                last, words = text, dict(zip(place[own].tolist(), codes[own].tolist()))
            share = index.findings(words, template, begin)
            if share is not None:
                found[text].append({"start": begin, "words": len(index.words[template]), "label": index.templates[template].label, "base": template < index.n_base, "share": round(share, 6)})
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(counts), pa.array(found, pa.list_(_FOUND))], names=["doc_id", "n_words", "found"])


def scan(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """doc_id, n_words and found of every row of ``docs``.

    ``found`` lists start (a word's number; a notice may begin a few words outside the text, where its own beginning is
    missing), words (the template's), label, base and share (of the template's weight that stands there word for word).
    Words are lower-cased stretches of ASCII letters and digits and of any character outside ASCII. A null text counts
    as empty; empty texts have no words and no findings. Null and repeated ids stay as they are, row by row. An empty
    table gives no rows. Columns besides doc_id and text are not looked at.
    """
    index = index or build_index(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return texts.mapInArrow(partial(_scan, index=index), f"doc_id long, n_words long, found array<{FOUND}>")
