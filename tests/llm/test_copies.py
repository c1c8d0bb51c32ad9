"""Exact copies and similar documents against brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratusqc.llm import components, exact_dedup, fuse_filter, ngram_join
from stratusqc.llm.shingles import shingle_sets
from llm_fixtures import as_docs, folk, messy  # noqa: F401


def key(i):
    return (i is None, i or 0)


@pytest.mark.parametrize("n", [0, 1, 2, 10, 1000, 50_000])
def test_filter_finds_all_and_little_else(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, 2 * n + 1000, dtype=np.uint64)
    built = fuse_filter.build(np.concatenate([keys[:n], keys[: n // 2]]))
    assert fuse_filter.contains(built, keys[:n]).all()
    assert fuse_filter.contains(built, keys[n:]).mean() < 0.02
    assert n < 50_000 or len(built[3]) < 1.25 * n


@pytest.mark.parametrize("is_new", ["false", "true", "doc_id > 5", "doc_id % 2 = 0"])
def test_copies(as_docs, messy, folk, is_new):
    rows = [*messy, *folk]
    got = exact_dedup.find_copies(as_docs(rows), F.expr(is_new)).collect()
    digest = lambda t: hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", t or "").encode()).hexdigest()
    groups = {}
    for i, t in rows:
        groups.setdefault(digest(t), []).append(i)
    wanted = [(i, min(groups[digest(t)], key=key), len(groups[digest(t)]), digest(t)) for i, t in rows]
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == sorted(wanted, key=repr)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert sorted(kept) == sorted(groups)


def test_dropping_keeps_columns_and_one_row_each(as_docs, messy):
    docs = as_docs(messy)
    out = exact_dedup.drop_copies(docs, exact_dedup.halves(docs))
    assert out.columns == docs.columns
    texts = [re.sub("[\x20\x09-\x0d]+", " ", r["text"] or "") for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in messy})
    unique = as_docs([(1, "a"), (2, "a "), (3, "a")])
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(unique, F.lit(True)).collect()) == [1, 2]


def test_no_copies_of_nothing(as_docs):
    empty = as_docs([])
    assert exact_dedup.find_copies(empty, exact_dedup.halves(empty)).collect() == []
    assert exact_dedup.drop_copies(empty, exact_dedup.halves(empty)).collect() == []


def test_two_texts_under_one_digest_are_an_error(as_docs, monkeypatch):
    docs = as_docs([(1, "a"), (2, "b")])
    copies = exact_dedup.find_copies(docs, F.lit(True)).withColumn("group_size", F.lit(2))
    exact_dedup._check_bytes(docs, copies)
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, bits: F.lit("same"))
    with pytest.raises(RuntimeError, match="digest"):
        exact_dedup._check_bytes(docs, copies)


def words_of(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles_of(text, n):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, num, den):
    sets = [shingles_of(t, n) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                old = label[a]
                label = [label[b] if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label):
        least[x] = min(least.get(x, i), i, key=key)
    return sorted(((i, len(s), least[x]) for (i, _), s, x in zip(rows, sets, label)), key=repr)


@pytest.mark.parametrize("n", [1, 4, 5])
def test_shingle_sets(messy, n):
    texts = [t or "" for _, t in messy]
    hashes, counts = shingle_sets(pa.array(["skipped", *texts]).slice(1), n)
    assert counts.tolist() == [len(shingles_of(t, n)) for t in texts]
    ends = np.cumsum(counts)
    sets = [set(hashes[e - c : e].tolist()) for e, c in zip(ends, counts)]
    assert sets[0] == sets[4] == sets[7] and not sets[0] & sets[6]


@pytest.mark.parametrize(("n", "num", "block", "held"), [(4, 85, 4096, 6_000_000), (5, 80, 3, 500), (2, 50, 7, 2000)])
def test_components(as_docs, messy, folk, monkeypatch, n, num, block, held):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "MOST_HELD", held)
    rows = [*messy, *folk]
    got = ngram_join.components(as_docs(rows), n, num, 100).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows, n, num, 100)
    assert len({r["component_id"] for r in got}) < len(rows)


def test_components_of_nothing(as_docs):
    assert ngram_join.components(as_docs([])).collect() == []
    assert ngram_join.components(as_docs([(1, None)])).collect()[0].asDict() == {"doc_id": 1, "n_shingles": 0, "component_id": 1}


def test_one_of_each_component_stays(as_docs, folk):
    docs = as_docs(folk)
    out = ngram_join.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({c for _, _, c in brute(folk, 5, 80, 100)})


def test_prefix_tree_against_all_pairs():
    rng = np.random.default_rng(4)
    tree, sets, linked = ngram_join.PrefixTree(70, 100), [], []
    for k in range(200):
        s = sorted(set(rng.integers(0, 40, int(rng.integers(5, 30))).tolist())) if k % 2 == 0 else [g for g in sets[int(rng.integers(len(sets)))] if rng.random() > 0.1]
        sets.append(s)
        linked.append(tree.add(s, len(s)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(set(sets[a]) & set(sets[b]))
            if sets[a] and 100 * both >= 70 * (len(sets[a]) + len(sets[b]) - both):
                assert tree.find(a) == tree.find(b)
    assert all(100 * len(set(sets[a]) & set(sets[b])) >= 70 * len(set(sets[a]) | set(sets[b])) for a, ls in enumerate(linked) for b in ls)


def test_connected(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 100), (201, 200), (202, 201), (202, 201)]
    labels = {r["node"]: r["label"] for r in components.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert labels == {**{k: 0 for k in range(61)}, 100: 100, 200: 200, 201: 200, 202: 200}
    assert components.connected(spark.createDataFrame([], "a long, b long")).collect() == []
