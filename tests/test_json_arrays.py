from __future__ import annotations

import json
import random

import pytest

from stratusqc.sources import json_arrays as JA
from stratusqc.sources import readers as RD

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def tiny_splits(spark):
    before = spark.conf.get(SPLIT)
    yield lambda n: spark.conf.set(SPLIT, str(n))
    spark.conf.set(SPLIT, before)


def objects(spark, path):
    return sorted(json.dumps(json.loads(r["text"]), sort_keys=True) for r in JA.read_json_objects(spark, str(path)).collect())


def expected(rows):
    return sorted(json.dumps(r, sort_keys=True) for r in rows if isinstance(r, dict))


def awkward(rng, n):
    """Rows with braces, quotes, brackets and backslashes in texts and keys, nested values, empty and long ones."""
    texts = ["", "}", "{", '"', "\\", '\\"', '"readings": [{', "}, {", "]}", "a" * 300, "ü}é", '{"readings":[]}', "\n", "x}\\"]
    out = []
    for i in range(n):
        row = {"station_code": f"S{i}", "temperature": rng.random(), rng.choice(["note", "n}", 'q"', "readings"]): rng.choice(texts)}
        if rng.random() < 0.3:
            row["more"] = {"readings": [{"a": rng.choice(texts)}, {}], "b": [[], [{"c": {}}]]}
        out.append(row if rng.random() < 0.9 else rng.choice([1, None, "}", [{"deep": 1}], {}]))
    return out


@pytest.mark.parametrize("split,n,indent", [(61, 14, None), (97, 10, 2), (700, 60, None), (701, 60, 2), (10**8, 60, None)])
def test_arrays_and_objects_equal_the_parser(spark, tmp_path, tiny_splits, split, n, indent):
    rng = random.Random(split)
    rows, other = awkward(rng, n), awkward(rng, n // 4)
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=indent), encoding="utf-8")
    before = {"kind": "}", "others": other, "meta": {"readings": other}, "readings": rows, "after": other, "end": {"a": {}}}
    (tmp_path / "object.json").write_text("﻿ " + json.dumps(before, indent=indent, ensure_ascii=False) + "\n", encoding="utf-8")
    tiny_splits(split)
    assert objects(spark, tmp_path / "array.json") == expected(rows)
    assert objects(spark, tmp_path / "object.json") == expected(rows)


def test_objects_longer_than_splits(spark, tmp_path, tiny_splits):
    rows = [{"a": [{"b": "}" * 50} for _ in range(30)]}, {"c": "{}" * 400}, {}, {"d": {"e": {"f": {"g": 1}}}}] * 3
    (tmp_path / "a.json").write_text(json.dumps(rows))
    tiny_splits(40)
    assert objects(spark, tmp_path / "a.json") == expected(rows)


def test_one_file_is_read_by_many_tasks(spark, tmp_path, tiny_splits):
    rows = [{"station_code": f"S{i % 7}", "timestamp": "2024-01-01 00:00:00", "temperature": i, "note": "x" * (i % 90)} for i in range(40_000)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    tiny_splits(1 << 18)
    assert JA.split_states(spark, str(tmp_path / "a.json")).count() >= 10
    got = RD.typed_readings(RD.harmonize_map(RD.read_readings_json(spark, str(tmp_path / "a.json"))))
    assert got.count() == 40_000
    assert got.agg({"temperature": "sum"}).first()[0] == sum(range(40_000))


@pytest.mark.parametrize("text,rows", [("", 0), (" \n", 0), ("[]", 0), ("{}", 0), ('{"readings": []}', 0), ('{"readings": {"a": {}}}', 0),
                                       ('{"readings": [{}]}', 1), ("[{}]", 1), ("[1, null]", 0)])
def test_small_files(spark, tmp_path, text, rows):
    (tmp_path / "a.json").write_text(text)
    assert JA.read_json_objects(spark, str(tmp_path / "a.json")).count() == rows


@pytest.mark.parametrize("text", ["hello", '[{"a": 1}', '[{"a": "x}]', '{"readings": [{}]', "[{]"])
def test_broken_files_are_named(spark, tmp_path, text):
    (tmp_path / "broken.json").write_text(text)
    with pytest.raises(Exception, match="broken.json"):
        JA.read_json_objects(spark, str(tmp_path / "broken.json")).count()


def test_bytes_that_are_not_utf8_are_replaced(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b'[{"a": "\xff}"}, {"b": 1}]')
    assert objects(spark, tmp_path / "a.json") == expected([{"a": "�}"}, {"b": 1}])
