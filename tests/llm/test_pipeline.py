"""Every stage of the pipeline against a brute-force version of its own input."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stratusqc.llm import pii, quality_classifier
from stratusqc.llm.queries import LOWER_TOKENIZER, PII_KEY
from test_copies import brute
from test_selection import grams_of
from llm_fixtures import as_docs, messy  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The result of each stage, written and read again."""
    at = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(str(at / str(k)))
        out.append(spark.read.parquet(str(at / str(k))))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "PII", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_quality(spark, stages):
    before, after = rows(stages[0]), rows(stages[1])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {i for i in before if labels.get(i) == 1}
    target, raw = np.zeros(quality_classifier.BUCKETS), np.zeros(quality_classifier.BUCKETS)
    grams = {i: np.array(grams_of(r["text"]), int) for i, r in before.items()}
    for i, g in grams.items():
        np.add.at(raw, g, 1)
        if i in good:
            np.add.at(target, g, 1)
    log = lambda v: np.log((v + 0.5) / (v.sum() + 0.5 * len(v)))
    ratios = log(target) - log(raw)
    weight = {i: ratios[g].sum() / (len(g) + 1) for i, g in grams.items()}
    cut = np.quantile([weight[i] for i in good], 1 - quality_classifier.KEEP_TARGET)
    assert len(after) == sum(w >= cut for w in weight.values())
    # The draw only decides between documents near the cut.
    assert all(weight[i] > cut - 0.03 for i in after) and all(weight[i] < cut + 0.03 for i in set(before) - set(after))
    assert all(after[i] == before[i] for i in after)


def test_exact(stages):
    before, after = rows(stages[1]), rows(stages[2])
    first = {}
    for i in sorted(before):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", before[i]["text"] or ""), i)
    assert set(after) == set(first.values()) and all(after[i] == before[i] for i in after)


def test_similar(stages):
    before, after = rows(stages[2]), rows(stages[3])
    found = brute([(i, r["text"]) for i, r in before.items()], 5, 80, 100)
    assert set(after) == {c for _, _, c in found} and all(after[i] == before[i] for i in after)


def test_personal_data(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(after) == set(before)
    for i, r in after.items():
        assert r["text"] == pii.replace(before[i]["text"], PII_KEY)[0] and r["n_chars"] == len(r["text"])
        assert (r["lang"], r["source"]) == (before[i]["lang"], before[i]["source"])


def test_packed(stages):
    tokenizer, docs = Tokenizer.from_file(LOWER_TOKENIZER), defaultdict(list)
    for p in stages[5].collect():
        docs[p["doc_id"]].append((p["start"], np.frombuffer(p["ids"], "<u4").tolist()))
    got = {i: [x for _, ids in sorted(parts) for x in ids] for i, parts in docs.items()}
    assert got == {i: [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1] for i, r in rows(stages[4]).items()}


def test_run_is_the_stages_in_turn(spark, stages):
    run = corpus_pipeline.run(spark, SF)
    sums = [F.count("*"), F.sum("length"), F.sum(F.crc32("ids"))]
    assert run.schema == stages[5].schema and run.agg(*sums).first() == stages[5].agg(*sums).first()


def test_messy_documents_go_through(spark, as_docs, messy, tmp_path):
    """Nulls, long texts, ties, repeated rows, no rows, and further columns."""
    labels = spark.createDataFrame([(1, 1), (5, 1), (8, 0), (None, 1)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for given in (messy, []):
        docs = as_docs(given)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{len(given)}-{k}")
            stage(spark, docs, str(tmp_path)).write.parquet(path)
            docs = spark.read.parquet(path)
        assert bool(docs.count()) == bool(given)
