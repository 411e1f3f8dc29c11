"""Scans, sinks and the streaming ledger."""

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import ledger as L
from tallyweave.sources import render, scans
from tallyweave.streaming import ledger_stream as T


def test_source_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.SQL").write_text("SELECT 1\nFROM t")
    (tmp_path / "sub" / "b.cs").write_text("class A {}")
    got = {r["path"].rsplit("/", 1)[1]: r for r in scans.source_files(spark, str(tmp_path)).collect()}
    assert {k: r["language"] for k, r in got.items()} == {"a.SQL": "sql", "b.cs": "csharp"}
    assert got["a.SQL"]["content"] == "SELECT 1\nFROM t" and len(got["b.cs"]["content_sha256"]) == 64
    assert scans.source_texts(spark, {"x.unknown": ""}).first()["language"] == "unknown"


def test_vectors(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"id": "v1", "tags": ["a"], "input": {"id": "x", "points": [{"lat": 1.0, "lon": 2.0}]}, "reference_output": "{}", "baseline_output": "{}", "expected_divergent": true}]')
    row = scans.vectors(spark, str(tmp_path / "c.json")).first()
    assert row["id"] == "v1" and row["input"]["points"][0]["lon"] == 2.0 and row["expected_divergent"]


@pytest.mark.parametrize("text,parsed,total", [('{"id": "a", "total": 1.5}', True, 1.5), ("{broken", False, 0.0), (None, False, 0.0), ('{"id": "a"}', True, 0.0), ("[]", False, 0.0)])
def test_tolerant_result(spark, text, parsed, total):
    got = spark.createDataFrame([(text,)], "j string").select(scans.tolerant_result(F.col("j")).alias("r")).first()["r"]
    assert got["parsed"] is parsed and got["total"] == total and got["messages"] == []


def test_array_length(spark):
    df = spark.createDataFrame([('{"p": [1, 2]}',), ('{"p": 3}',), ("x",), (None,)], "j string")
    assert [r[0] for r in df.select(scans.array_length(F.col("j"), "$.p")).collect()] == [2, 0, 0, 0]


def test_upsert_and_points(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([("z", 2), ("n", 3)], "v string, k int")
    assert {tuple(r) for r in scans.upsert(t, s, "k").collect()} == {(1, "a"), (2, "z"), (3, "n")}
    blob = spark.createDataFrame([(1, "1,2;x,3;;4")], "k int, b string")
    assert [tuple(r) for r in scans.points_of_blob(blob, "k", "b").orderBy("seq").collect()] == [(1, 0, 1.0, 2.0), (1, 1, None, 3.0), (1, 3, 4.0, None)]


@pytest.mark.parametrize("path", ["../x", "/etc/x", "a/../../x", "file:///x"])
def test_writes_stay_below_the_base(spark, tmp_path, path):
    with pytest.raises(ValueError):
        scans.write_below(spark.range(1), str(tmp_path), path)


def test_write_below(spark, tmp_path):
    where = scans.write_below(spark.range(3), str(tmp_path), "a/b")
    assert spark.read.json(where).count() == 3


def test_recorded_results(spark):
    tasks = spark.createDataFrame([("u", "l", "s")], "unit string, language string, stack string")
    key = tasks.select(F.sha2(F.concat_ws("|", "unit", "language", "stack"), 256).alias("key"), F.lit("done").alias("result"))
    assert scans.attach_recorded(tasks, key).first()["result"] == "done"
    assert scans.attach_recorded(tasks, key.where("false"), missing="null").first()["result"] is None
    with pytest.raises(Exception, match="no record"):
        scans.attach_recorded(tasks, key.where("false")).collect()


def test_bill_of_materials(spark):
    parts = spark.createDataFrame([("b", "1"), ("a", "2")], "name string, version string")
    doc = render.bill_of_materials(parts, "x", "1", "seed")
    assert doc.select(render.is_bill_of_materials(F.col("doc"))).first()[0]
    assert doc.first() == render.bill_of_materials(parts.orderBy("name"), "x", "1", "seed").first()
    assert not spark.createDataFrame([("{}",)], "doc string").select(render.is_bill_of_materials(F.col("doc"))).first()[0]


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.range(10).select(F.col("id").alias("event_id"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(hours=F.col("id").cast("int") * 5)).alias("ts"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"))
    df.repartition(2).write.parquet(src)
    ledger, mark = str(tmp_path / "ledger"), str(tmp_path / "mark")
    T.append_to_ledger(T.event_stream(spark, src, df.schema), ledger, mark).awaitTermination()
    first = spark.read.parquet(ledger)
    n = first.count()
    assert n >= 1
    df.write.mode("append").parquet(src)
    T.append_to_ledger(T.event_stream(spark, src, df.schema), ledger, mark).awaitTermination()
    entries = spark.read.parquet(ledger).withColumn("k", F.lit(1))
    assert entries.count() > n and L.verify_chain(entries, "k").first()["valid"]
    query = T.windowed_counts(T.event_stream(spark, src, df.schema)).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == 20
