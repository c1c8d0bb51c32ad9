"""Word tables, packing, coding and token files against the tokenizer itself."""

from __future__ import annotations

import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from stratusqc.llm import bpe, packing, queries, token_files
from stratusqc.llm.wordcodes import WordCodes
from llm_fixtures import as_docs, folk, messy  # noqa: F401
SF = "/root/testdata/sf0.001"

PIECES = ["'s", "'S", "'LL", " ", "  ", "\n", "\t", "a", "Bc", "é", "ß", "9", "42", "!", "--", "<|endoftext|>", "é", "ſ", "\x1c", "中", "Ā", "’", "\x00", "·", "ª", " ", "İ", "K"]


@pytest.fixture(scope="module", params=[queries.BYTE_TOKENIZER, queries.LOWER_TOKENIZER])
def path(request):
    return request.param


def plain(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_words_give_the_ids_of_the_text(path):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    codes = WordCodes(path)
    for _ in range(2):  # the second time from the table
        ids, counts = codes.texts(texts)
        got = [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [e.ids for e in codes.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_table_starts_anew(path, monkeypatch):
    monkeypatch.setattr("stratusqc.llm.wordcodes.MOST_WORDS", 5)
    codes = WordCodes(path)
    for text in ("one two three four five six seven", "eight nine one two", "one"):
        assert codes.texts([text])[0].tolist() == plain(path, text)
    assert len(codes.index) < 15


def joined(pieces):
    """Ids of each document from its pieces, and lengths by sequence; checks both are gapless."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4")
        assert len(ids) == p["length"] > 0
        by_doc[p["doc_id"]].append((p["start"], p["doc_tokens"], ids.tolist()))
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    return by_doc, {s: sum(n for _, n in parts) for s, parts in by_sequence.items()}


def whole(parts):
    out = []
    for start, total, ids in sorted(parts):
        assert start == len(out)
        out += ids
    assert len(out) == parts[0][1]
    return out


@pytest.mark.parametrize("window", [64, 2048])
def test_packing_loses_no_id(as_docs, folk, window):
    pieces = packing.pack_documents(as_docs(folk), queries.LOWER_TOKENIZER, window).collect()
    by_doc, lengths = joined(pieces)
    assert {i: whole(p) for i, p in by_doc.items()} == {i: [*plain(queries.LOWER_TOKENIZER, t), 1] for i, t in folk}
    assert all(n <= window and n & (n - 1) == 0 for n in lengths.values())


def test_packing_of_messy_rows(as_docs, messy):
    pieces = packing.pack_documents(as_docs(messy), queries.LOWER_TOKENIZER).collect()
    by_doc, _ = joined(pieces)
    for i in (1, 2, 3, 4, 5, 6, 8):
        assert whole(by_doc[i]) == [*plain(queries.LOWER_TOKENIZER, dict(messy)[i]), 1]
    # Rows with one id, or none, are documents of their own.
    assert sum(p["start"] == 0 for p in pieces) == len(messy)
    assert packing.pack_documents(as_docs([]), queries.LOWER_TOKENIZER).collect() == []


def test_level_has_the_least_sum_of_squares():
    rng = np.random.default_rng(3)
    packer = packing.Packer(32, 0)
    for _ in range(400):
        length = int(rng.integers(1, 32))
        counts = {k: len(w) for k, w in enumerate(packer.windows) if w}

        def squares(level, counts=counts, length=length):
            after = dict(counts)
            if level:
                after[level] -= 1
            if level + length < 32:
                after[level + length] = after.get(level + length, 0) + 1
            return sum(n * n for n in after.values())

        levels = [k for k in [0, *counts] if k + length <= 32]
        best = min(map(squares, levels))
        chosen = packer.level_for(length)
        assert squares(chosen) == best and chosen == max(k for k in levels if squares(k) == best)
        packer.add(0, np.arange(length))


def test_packing_closes_too_many_windows(monkeypatch):
    monkeypatch.setattr(packing, "MOST_OPEN", 3)
    packer = packing.Packer(64, 0)
    for k in range(50):
        packer.add(k, np.arange(40))
        assert packer.open <= 4
    packer.finish()
    assert sum(r[2] for r in packer.rows) == 2000


def test_placements_stay(spark):
    """Few tokens are moved when a partition ends: the emptiest windows fill the gaps of the others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    codes = WordCodes(queries.LOWER_TOKENIZER)
    lengths = (codes.texts([r["text"] or "" for r in docs])[1] + 1).tolist()
    packer = packing.Packer(2048, 0)
    for k, n in enumerate(lengths):
        packer.add(k, np.full(n, k, np.uint32))
    placed = [{p[0] for p in held} for level in packer.windows for held in level]
    packer.finish()
    assert len(lengths) == 1000 and packer.moved <= 0.05 * sum(lengths)
    sequences = defaultdict(set)
    for doc, *_, sequence, _, _ in packer.rows:
        sequences[sequence].add(doc)
    kept = sum(any(p <= s for s in sequences.values()) for p in placed)
    assert kept >= 0.85 * len(placed)


@pytest.mark.parametrize("seed", range(5))
def test_closing_fills_every_window(seed):
    rng = np.random.default_rng(seed)
    packer, given = packing.Packer(64, 0), {}
    for k in range(int(rng.integers(0, 120))):
        given[k] = int(rng.integers(1, 90))
        packer.add(k, np.arange(given[k]))
    packer.finish()
    fills, pieces = defaultdict(int), defaultdict(list)
    for doc, start, length, total, sequence, offset, ids in packer.rows:
        assert offset == fills[sequence]
        fills[sequence] += length
        pieces[doc].append((start, total, np.frombuffer(ids, "<u4").tolist()))
    assert sum(n < 64 for n in fills.values()) <= 6 and all(n & (n - 1) == 0 for n in fills.values())
    assert {k: whole(p) for k, p in pieces.items()} == {k: list(range(n)) for k, n in given.items()}
    assert not packer.open and not any(packer.windows)


def test_coding_is_the_tokenizers(as_docs, messy, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 4)  # many blocks
    t = Tokenizer.from_file(queries.BYTE_TOKENIZER)
    rng = random.Random(2)
    rows = [*messy, *[(100 + k, "".join(rng.choice(PIECES) for _ in range(30))) for k in range(60)]]
    got = bpe.encode_decode(as_docs(rows), queries.BYTE_TOKENIZER).collect()
    wanted = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        wanted.append((i, ids, t.decode(ids, skip_special_tokens=False)))
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got), key=order) == sorted(wanted, key=order)
    assert bpe.encode_decode(as_docs([]), queries.BYTE_TOKENIZER).collect() == []


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
@pytest.mark.parametrize("most", [1, 2, 300, 50257, 2**32 - 1])
def test_segments_round_trip(n, most):
    rng = np.random.default_rng(n + most)
    ids = (rng.zipf(1.3, n) % most).astype(np.uint32)
    segment = token_files.Segment(token_files.encode_segment(np.array([5]), np.array([False]), np.array([n]), ids))
    assert (segment.ids() == ids).all() and segment.doc_ids.tolist() == [5]
    for _ in range(5):
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert (segment.ids(a, b) == ids[a:b]).all()


def test_token_files(spark, as_docs, messy, folk, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", 2000)
    rows = [*messy, *folk]
    token_files.write_tokens(as_docs(rows), str(tmp_path / "t"), queries.BYTE_TOKENIZER)
    assert spark.read.parquet(str(tmp_path / "t")).count() > 0
    read = sorted(token_files.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in read] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at, texts = 0, defaultdict(list)
    for i, text in rows:
        texts[i].append([*plain(queries.BYTE_TOKENIZER, text), 0])
    for r in read:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == at and r["n_tokens"] == len(ids)
        at += len(ids)
        texts[r["doc_id"]].remove(ids)
    assert not any(texts.values())


def test_token_files_of_nothing(spark, as_docs, tmp_path):
    token_files.write_tokens(as_docs([]), str(tmp_path / "e"), queries.BYTE_TOKENIZER)
    assert token_files.read_tokens(spark, str(tmp_path / "e")).collect() == []


def test_queries_against_the_tokenizer(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    raw = lambda ids: np.array(ids, "<u4").tobytes()
    at, wanted = 0, []
    for i, text in docs:
        ids = [*plain(queries.BYTE_TOKENIZER, text), 0]
        wanted.append((i, at, len(ids), crc32(raw(ids))))
        at += len(ids)
    assert sorted(map(tuple, queries.op6_patched_frames(spark, SF).collect())) == wanted
    lower = {i: [*plain(queries.LOWER_TOKENIZER, text), 1] for i, text in docs}
    pieces = queries.op2_pack_sum_of_squares(spark, SF).collect()
    for p in pieces:
        assert crc32(raw(lower[p["doc_id"]][p["start"] : p["start"] + p["length"]])) == p["ids_crc32"]
    assert sum(p["length"] for p in pieces) == sum(map(len, lower.values()))
