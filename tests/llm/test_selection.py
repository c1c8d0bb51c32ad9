"""Quality rules, importance resampling and toxicity."""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from stratusqc.llm import quality_classifier, quality_rules, queries, toxicity
from llm_fixtures import as_docs, folk, messy  # noqa: F401

SF = "/root/testdata/sf0.001"


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


def verdict(text):
    n, chars, symbols, doubled, repeats, lines = measures(text)
    failed = n < 20 or 100 * repeats > 30 * n
    capitals = len(re.findall("[A-ZÀ-ÖØ-Þ]", text or ""))
    urls = len(re.findall("https?://", text or ""))
    return failed, not (failed or 10 * symbols > n or 2 * doubled > lines or chars > 20 * n or chars < 2 * n or 2 * capitals > chars or 3 * urls > n)


JUNK = [
    (31, "spam eggs ham " * 40),
    (32, "one line of text here\n" * 30),
    (33, " ".join(f"w{i}|" for i in range(50))),
    (34, " ".join(f"WORD{i}" for i in range(50))),
    (35, " ".join(f"a b{i}" for i in range(30)) + " x1 x2 x3 x4 x5 x6 x7 x8 mid x1 x2 x3 x4 x5 x6 x7 x8 x1 x2"),
]


def test_rules(as_docs, messy, folk):
    rows = [*messy, *folk, *JUNK]
    got = [tuple(r) for r in quality_rules.judge(as_docs(rows)).collect()]
    assert sorted(got, key=repr) == sorted(((i, *measures(t)[:5], *verdict(t)) for i, t in rows), key=repr)
    assert quality_rules.judge(as_docs([])).collect() == []


def test_order_of_rules_changes_no_verdict(as_docs, folk, monkeypatch):
    docs = as_docs([*folk, *JUNK])
    assert sorted(quality_rules.order_rules(docs)) == sorted(quality_rules.RULES)
    first = sorted(map(tuple, quality_rules.judge(docs).collect()))
    monkeypatch.setattr(quality_rules, "order_rules", lambda docs, rules: sorted(rules, reverse=True))
    assert sorted(map(tuple, quality_rules.judge(docs).collect())) == first


def test_rules_run_without_python(spark):
    plan = quality_rules.measured(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def grams_of(text):
    raw = re.sub(rb"[0-9]", b"0", (text or "").encode())
    return [int.from_bytes(raw[i : i + 4], "little") * 2654435761 % 2**32 >> 16 for i in range(len(raw) - 3)]


def test_importance_is_the_ratio_of_two_models(as_docs, messy, folk, spark):
    rows = [*messy, *folk, *JUNK]
    good = {i for i, _ in folk[:60]}
    labels = spark.createDataFrame([*((i, 1) for i in good), (31, 0), (32, 0), (None, 1), (5, None)], "doc_id long, quality int")
    chosen = quality_classifier.select(as_docs(rows), labels)
    raw, target = np.zeros(1 << 16), np.zeros(1 << 16)
    for i, t in rows:
        for g in grams_of(t):
            raw[g] += 1
            target[g] += i in good
    log = lambda v: np.log((v + 0.5) / (v.sum() + 0.5 * len(v)))
    ratios = log(target) - log(raw)
    assert np.allclose(chosen.ratios, ratios)
    scored = chosen.scored(as_docs(rows), "imp", "k").collect()
    wanted = sorted(round(float(ratios[grams_of(t)].sum()) / (len(grams_of(t)) + 1), 9) for _, t in rows)
    assert sorted(round(r["imp"], 9) for r in scored) == wanted
    # As many are sampled as lie above the cut, and they have the largest keys.
    cut = np.quantile([r["imp"] for r in scored if r["doc_id"] in good], 1 - quality_classifier.KEEP_TARGET)
    k = sum(r["imp"] >= cut for r in scored)
    assert chosen.threshold == sorted((r["k"] for r in scored), reverse=True)[k - 1]
    kept = chosen.keep(as_docs(rows))
    assert kept.columns == as_docs(rows).columns
    assert len(good - {r["doc_id"] for r in kept.collect()}) <= 1
    assert not {31, 33, 34} & {r["doc_id"] for r in kept.collect()}
    assert quality_classifier.select(as_docs(rows, parts=7), labels).threshold == chosen.threshold


def test_selection_without_labels_or_documents(as_docs, folk, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_classifier.select(as_docs(folk), none).keep(as_docs(folk)).count() == len(folk)
    assert quality_classifier.select(as_docs([]), none).keep(as_docs([])).count() == 0


@pytest.mark.parametrize("k", [1, 2, 500, 999, 1000])
def test_kth_largest(spark, k):
    rng = np.random.default_rng(k)
    values = np.concatenate([rng.normal(size=600), np.full(400, 0.25)])
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert quality_classifier.largest(frame, "v", k, bins=7) == sorted(values, reverse=True)[k - 1]


@pytest.fixture(scope="module")
def machine():
    rng = np.random.default_rng(0)
    syllables = ["an", "on", "the", "er", "ti", "nd", "re", "ou", "in", "ea", "st", "wh"]
    insults = ["idiot", "moron", "pathetic", "loweichen", "loweisp", "loweiung"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    sentences, document, toxic = [], [], []
    for d in range(400):
        toxic.append(d % 3 == 0)
        for s in range(6):
            words = [word() for _ in range(12)]
            if toxic[-1] and s == d % 6:
                words[5] = insults[rng.integers(len(insults))]
            sentences.append(" ".join(words) + ".")
            document.append(d)
    return toxicity.train(pa.array(sentences), np.array(document), np.array(toxic))


def test_insults_are_found_also_in_disguise(machine):
    said = lambda w: float(machine.scores(pa.array([f"Onthe ea, {w} whin the ti."]))[0])
    for w in ("idiot", "Moron!", "pathetic", "loweisp", "i d i o t", "m-o-r-o-n", "i.d.i.o.t", "path*etic"):
        assert said(w) >= 0.7, w
    for w in ("", "onthe", "whinstea", "12345", "..."):
        assert said(w) < 0.3, w


def test_scores_of_messy_rows(as_docs, messy, machine):
    got = toxicity.score(as_docs(messy), machine).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in got)) == sorted((i is None, i or 0) for i, _ in messy)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3, 4)}) == 1
    assert toxicity.score(as_docs([]), machine).collect() == []


def test_training_without_labels(as_docs, folk, spark):
    for labels in ([], [(1000, 1)], [(1000, 0), (999, None)]):
        m = toxicity.fit(as_docs(folk), spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert all(0 <= r["score"] <= 1 for r in toxicity.score(as_docs(folk), m).collect())


def test_stretches_cover_long_words():
    raw, first, last, owner = toxicity._stretches(pa.array(["x" * 100, "a b", ""]))
    parts = {bytes(raw[f:e]) for f, e, o in zip(first, last, owner) if o == 0}
    assert all(len(p) <= toxicity.WIDTH for p in parts) and len(first[owner == 0]) >= 100 // toxicity.WIDTH
    assert sorted(bytes(raw[f:e]) for f, e, o in zip(first, last, owner) if o == 1) == [b"a", b"b"]


def test_held_out_accuracy(spark):
    """On the mid-sized tables: the labels of a third of the documents are never seen."""
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op4_subsequence_svm(spark, sf).collect()
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)
    seen = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    hit = sum(p and t for p, t in seen)
    assert hit / sum(p for p, _ in seen) > 0.9 and hit / sum(t for _, t in seen) > 0.65
    assert sum(p == t for p, t in seen) / len(seen) > 0.95
