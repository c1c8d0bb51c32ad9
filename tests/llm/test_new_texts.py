"""Runs, fill-in-the-middle and licence scans against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from stratusqc.llm import fill_middle, licenses, queries, runs
from stratusqc.llm.common import text_bytes
from stratusqc.llm.word_arrays import BLANKS, joined_by_blank, split_words
from llm_fixtures import as_docs, folk, messy  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_runs(w, least=6, repeats=4, longest=10_000):
    """By definition: every maximal stretch of every period up to ``longest`` whose smallest period that is."""
    out = set()
    for q in range(1, min(longest, len(w) // repeats) + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, repeats * q):
                stretch = w[i : i + length]
                if not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                    out.add((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(rng):
    words = []
    for _ in range(rng.randint(0, 6)):
        part = [rng.choice("abcé") for _ in range(rng.randint(1, 9))]
        words += part * rng.choice([1, 1, 2, 4, 5, 7]) + part[: rng.randint(0, len(part))]
    return words


def test_runs_are_those_of_the_definition(as_docs):
    rng = random.Random(3)
    texts = {i: repetitive(rng) for i in range(400)}
    texts |= {1000: ["x"] * 3000, 1001: ["x", "y"] * 500 + ["x"], 1002: list("ab" * 4 + "ba" * 4), 1003: ["x"] * 5, 1004: ["x"] * 6}
    found = {r["doc_id"]: r for r in runs.find_runs(as_docs([(i, " \n".join(w)) for i, w in texts.items()])).collect()}
    assert len(found) == len(texts)
    for i, w in texts.items():
        expected = plain_runs(w)
        assert [tuple(r) for r in found[i]["runs"]] == expected, (i, w)
        assert found[i]["collapsed"] == collapsed(w, expected)
        assert found[i]["n_words"] == len(w)
    assert sum(bool(r["runs"]) for r in found.values()) > 100


def test_more_repeats_may_be_asked_for(as_docs):
    rng = random.Random(4)
    texts = {i: repetitive(rng) for i in range(100)}
    docs = as_docs([(i, " ".join(w)) for i, w in texts.items()])
    for r in runs.find_runs(docs, least=9, repeats=5).collect():
        assert [tuple(x) for x in r["runs"]] == plain_runs(texts[r["doc_id"]], 9, 5)
    with pytest.raises(ValueError):
        runs.find_runs(docs, repeats=3)


def test_proposals_of_one_run_are_few():
    """A long run is proposed a few times at each length, not once at every place."""
    factors = runs.Factors(np.tile(np.arange(7), 3000), np.array([21000]))
    assert sum(len(at) for at, _ in factors.proposals) < 100
    assert [x.tolist() for x in factors.runs(6, 4)] == [[0], [21000], [7]]


def test_runs_of_messy_rows(spark, as_docs, messy):
    got = runs.find_runs(as_docs(messy)).collect()
    assert len(got) == len(messy)
    for i in {i for i, _ in messy}:
        # The long text is random: it has runs of a few words only.
        words = [WORD.findall(t or "") for j, t in messy if j == i]
        expected = sorted((len(w), collapsed(w, plain_runs(w, longest=30))) for w in words)
        assert sorted((r["n_words"], r["collapsed"]) for r in got if r["doc_id"] == i) == expected
    assert runs.find_runs(spark.createDataFrame([], "doc_id long, text string, runs int")).count() == 0


def test_tails_of_the_query_repeat(as_docs, folk):
    for i, text in queries.with_periodic_tails(as_docs([*folk, (10, ""), (None, "a b")])).collect():
        original = dict(folk).get(i, "a b" if i is None else "")
        w = WORD.findall(original)
        h = crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            assert text == " ".join(w[:a] + [w[a + (k - a) % p] for k in range(a, len(w))])
        else:
            assert text == original


def test_words_and_joins_keep_every_byte():
    texts = pa.array(["", " é  中文 b\n", "\t", "one", "a b a", ""])
    words = split_words(texts, BLANKS)
    assert words.counts.tolist() == [0, 3, 0, 1, 3, 0]
    assert words.strings().to_pylist() == ["é", "中文", "b", "one", "a", "b", "a"]
    kept = np.array([True, False, True, False, True, True, True])
    assert joined_by_blank(words, kept).to_pylist() == ["", "é b", "", "", "a b a", ""]


UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plain_fill(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    x = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(x[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd_texts():
    rng = random.Random(8)
    passage = "".join(rng.choice("abc de, é中\n") for _ in range(9000))
    rows = [(i, "".join(rng.choice(["ab", "Z", " ", "é", "中", "<", "P>", "<M", "\n", "😀"]) for _ in range(rng.randint(0, 300)))) for i in range(300)]
    rows += [(400 + i, f"{i} start {passage} end" * rng.randint(1, 3)) for i in range(60)]
    rows += [(500, "x" * 100_000), (501, "中" * 30_000), (502, "a<P>b"), (503, "<"), (504, "aé" * 20_000), (505, "x" * 9000 + " " + "y" * 9000)]
    return rows


def test_fill_in_middle_of_odd_texts(as_docs, messy):
    rows = [*odd_texts(), *[(600 + k, t) for k, (_, t) in enumerate(messy)], (None, "some text")]
    made = fill_middle.fill_in_middle(as_docs(rows))
    made = made.withColumn("restored", fill_middle.restored(made["output"], made["form"])).collect()
    assert len(made) == len(rows)
    texts = dict(rows)
    for r in made:
        expected = plain_fill(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == expected
        assert r["restored"] == (texts[r["doc_id"]] or "")
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}


def test_chunks_follow_the_content():
    """A passage gives the same chunks wherever it stands, so that the table counts it once."""
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefg hijk\n") for _ in range(60_000))
    table = fill_middle.ChunkTable()
    for k in range(5):
        text = "".join(rng.choice("xyz ") for _ in range(100 * k)) + passage
        raw, starts = text_bytes(pa.array([text]))
        counted = fill_middle.Counted(raw, starts, table)
        assert counted.counts.tolist() == [len(UNIT.findall(text))]
        units = np.array([0, 1, 77, len(UNIT.findall(text)) - 1, len(UNIT.findall(text)) + 5])
        places, chars = counted.cut(np.zeros(5, np.int64), units)
        assert [text[:c] for c in places.tolist()] == ["".join(UNIT.findall(text)[:u]) for u in units.tolist()]
        assert chars.tolist() == places.tolist()
    assert table.counted < 0.35 * table.met


def test_chunks_are_bounded_and_whole():
    rng = random.Random(10)
    for text in ["", "a", "é" * 40_000, "".join(rng.choice("ab ") for _ in range(50_000)), "ab" * 30_000]:
        raw, starts = text_bytes(pa.array(["before " * 30, text, "behind"]))
        bounds = fill_middle.chunk_starts(raw, starts)
        assert set(starts.tolist()) <= set(bounds.tolist())
        assert (np.diff(bounds) > 0).all() and np.diff(bounds).max() <= fill_middle.MOST


def test_chunk_table_starts_anew(monkeypatch):
    monkeypatch.setattr(fill_middle, "REMEMBERED", 1000)
    table = fill_middle.ChunkTable()
    rng = random.Random(12)
    for _ in range(5):
        text = "".join(rng.choice("ab é") for _ in range(5000))
        raw, starts = text_bytes(pa.array([text]))
        assert fill_middle.Counted(raw, starts, table).counts.tolist() == [len(UNIT.findall(text))]
        assert table.size < 10_000


TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LICENCED = [
    (1, "Some code.\nReleased under the MIT License."),
    (2, "MIT license, mit-license and MIT\n  LICENSE; mit licenses"),
    (3, "Licensed under the Apache License, Version 2.0 (the thing)"),
    (4, "This work is licensed under the GNU General Public License, version 3."),
    (5, "This work is licensed under the GNU General Public License, version 2 or later."),
    (6, "Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0."),
    (7, "the general public likes the license of the public"),
    (8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this thing and associated documentation files"),
    (9, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    (10, "Version 2.0 of nothing; cc by chance 4 0"),
    (11, "MIT Lıcense MİT License émit license"),
    (12, "SPDX-License-Identifier: GPL-3.0"),
    (13, "Licensed under the GNU Lesser General Public License"),
]


def plain_scan(index, text):
    """Every template at every place of the text."""
    w = TOKEN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = []
    for k, t in enumerate(index.templates):
        own = t.words.split()
        weight = {x: index.weight[index.vocabulary.index(x)] for x in own}
        at = lambda i: w[i] if 0 <= i < len(w) else None
        anchors = range(len(own)) if k < index.n_base else sorted(range(len(own)), key=lambda i: (-weight[own[i]], i))[: licenses.ANCHORS]
        total, need = sum(weight[own[i]] for i in anchors), 1.0 if k < index.n_base else licenses.ENOUGH
        for begin in range(-len(own), len(w)):
            if sum(weight[own[i]] for i in anchors if at(begin + i) == own[i]) < need * total - 1e-9:
                continue
            near = " ".join(w[max(0, begin - licenses.SLACK) : begin + len(own) + licenses.SLACK]).split()
            has = lambda p: any(near[i : i + len(p)] == p for i in range(len(near)))
            if k < index.n_base or all(has(p.split()) for p in t.phrases):
                share = sum(weight[own[i]] for i in range(len(own)) if at(begin + i) == own[i]) / sum(weight[x] for x in own)
                out.append((begin, len(own), t.label, k < index.n_base, round(share, 6)))
    return sorted(out), len(w)


def test_licences_as_at_every_place(as_docs, messy):
    docs = as_docs([*LICENCED, *[(100 + k, t) for k, (_, t) in enumerate(messy)]])
    index = licenses.build_index(docs)
    texts = {**dict(LICENCED), **{100 + k: t for k, (_, t) in enumerate(messy)}}
    got = licenses.scan(docs, index).collect()
    assert len(got) == len(texts)
    for r in got:
        found, n = plain_scan(index, texts[r["doc_id"]])
        assert sorted(tuple(f) for f in r["found"]) == found, r["doc_id"]
        assert r["n_words"] == n


def test_licence_labels(as_docs):
    labels = {r["doc_id"]: {f["label"] for f in r["found"]} for r in licenses.scan(as_docs(LICENCED)).collect()}
    assert labels[3] == {"apache", "apache-2.0"}
    assert labels[4] == {"gpl", "gpl-3.0"} and labels[5] == {"gpl", "gpl-2.0"}
    assert labels[6] == {"cc-by-nc-4.0", "cc-by-4.0"}
    assert labels[7] == labels[10] == set()
    assert labels[8] == {"mit"} and labels[9] == {"isc"} and labels[12] == {"gpl-3.0"}
    assert labels[13] == {"gpl", "lgpl"}


def test_frequencies_count_all_documents(spark, as_docs):
    docs = as_docs([(i, "mit mit license" if i % 2 else "license") for i in range(30)])
    index = licenses.build_index(docs)
    weight = dict(zip(index.vocabulary, index.weight))
    assert weight["license"] == pytest.approx(1) and weight["mit"] == pytest.approx(1 + np.log(31 / 16))
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string, found int, words int")).count() == 0


def test_licence_query_counts_every_place(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = queries.op13_license_index(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = TOKEN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]]))
        places = [(i, t.label) for t in licenses.BASE for i in range(len(w)) if w[i : i + len(t.words.split())] == t.words.split()]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
