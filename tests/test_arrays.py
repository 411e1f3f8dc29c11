"""JSON arrays read by many tasks against one task's reading."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyweave.sources import arrays

SCHEMA = "id long, text string, tags array<string>, deep struct<a: array<struct<b: string>>>"


def rows(n, seed):
    rng = random.Random(seed)
    pool = ['"', "\\", "{", "}", "[", "]", ",", ":", "\n", "é", "漢", "a", " ", '\\"', '"}', "},{", "\\\\"]
    text = lambda k: "".join(rng.choice(pool) for _ in range(rng.randrange(k)))
    return [{"id": i, "text": text(60), "tags": [text(8) for _ in range(rng.randrange(4))], "deep": {"a": [{"b": text(5)} for _ in range(rng.randrange(3))]}} for i in range(n)]


@pytest.mark.parametrize(("indent", "size"), [(None, "600b"), (2, "1k"), (None, "7b"), (None, "128m")])
def test_pieces_of_a_file(spark, tmp_path, indent, size):
    made = rows(60 if size == "7b" else 400, 1)
    (tmp_path / "a.json").write_text(json.dumps(made, indent=indent, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "b.json").write_text(" [ ] \n", encoding="utf-8")
    (tmp_path / "c.json").write_text(json.dumps([{"id": -1, "text": "x" * 5000, "tags": [], "deep": {"a": []}}]), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        parts = arrays._ranges(spark, f"file://{tmp_path}").select("start", F.input_file_name().alias("f")).distinct().count()
        got = arrays.read_array(spark, f"file://{tmp_path}", SCHEMA).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = spark.read.schema(SCHEMA).json(f"file://{tmp_path}", multiLine=True).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) == len(made) + 1
    assert parts > 20 or size == "128m"


def test_arrays_that_do_not_end(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": 2, "text": "}"}, {"id": 3, "text": "x', encoding="utf-8")
    assert sorted(r["id"] for r in arrays.read_array(spark, f"file://{tmp_path}", "id long").collect()) == [1, 2]


def test_fold():
    rng = random.Random(2)
    for _ in range(500):
        text = json.dumps(rows(3, rng.random()), ensure_ascii=False)
        a, b = sorted((rng.randrange(len(text)), rng.randrange(len(text))))
        first = arrays.fold(text[:a], False, False)
        second = arrays.fold(text[a:b], *first[:2]) if b > a else (*first[:2], 0)
        both = arrays.fold(text[:b], False, False)
        assert (*second[:2], first[2] + second[2]) == both
        assert arrays.fold(text, False, False) == (False, False, 0)
