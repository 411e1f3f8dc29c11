"""Ledgers that refuse a second writer, and chains that are verified as they arrive."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import ledger as L
from tallyweave.streaming import ledger_stream as T


def test_a_second_writer_is_refused(spark, tmp_path):
    one, two = (T.GuardedLedger(spark, f"file://{tmp_path}/ledger") for _ in range(2))
    seen = one.head()[:2]
    assert seen == (0, L.GENESIS)
    one.append("A", "me", "00", seen)
    with pytest.raises(T.HeadMoved):
        two.append("B", "you", "11", seen)
    two.append("B", "you", "11", two.head()[:2])
    assert one.head()[0] == 2 and [r["action"] for r in one.entries().orderBy("seq").collect()] == ["A", "B"]
    checked = L.verify_chain(one.entries().withColumn("chain", F.lit("c")), "chain").first()
    assert checked["valid"] and checked["n"] == 2


def test_a_place_is_taken_once_even_at_the_same_moment(spark, tmp_path, monkeypatch):
    one, two = (T.GuardedLedger(spark, f"file://{tmp_path}/ledger") for _ in range(2))
    seen = one.head()[:2]
    monkeypatch.setattr(two, "head", lambda: (*seen, {}))  # has looked before the other wrote
    one.append("A", "me", "00", seen)
    with pytest.raises(T.HeadMoved):
        two.append("B", "you", "11", seen)
    assert one.head()[0] == 1


def test_batches_go_to_a_guarded_ledger(spark, tmp_path):
    df = spark.range(30).select("id", (F.col("id") * 2).alias("v"))
    for part in range(3):
        df.where(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    ledger = T.GuardedLedger(spark, f"file://{tmp_path}/ledger")
    run = lambda mark: T.append_to_guarded(T.event_stream(spark, f"file://{tmp_path}/in", df.schema), ledger, f"file://{tmp_path}/{mark}").awaitTermination()
    run("mark")
    assert ledger.head()[0] == 3
    run("mark")
    assert ledger.head()[0] == 3  # nothing new
    run("lost-mark")  # batches are run again: their entries are there
    assert ledger.head()[0] == 3
    assert L.verify_chain(ledger.entries().withColumn("chain", F.lit(1)), "chain").first()["valid"]


def test_chains_are_verified_as_they_arrive(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"c{c}", i, rng.choice(["Add", "Drop"]), f"a{i % 3}", f"payload {c} {i}") for c in range(6) for i in range(12)]
    entries = L.append_chain(spark.createDataFrame(rows, "chain string, o int, action string, actor string, payload string"), "chain", "o", "action", "actor", "payload")
    kept = {(r["chain"], r["seq"]): r.asDict() for r in entries.collect()}
    kept["c1", 4]["payload_sha"] = "0" * 64  # changed
    kept["c2", 7]["prev_hash"] = "1" * 64  # cut from the one before
    del kept["c3", 5]  # lost
    kept["c4", "twice"] = {**kept["c4", 6], "actor": "another"}  # a second writer took the place too
    folder = f"{tmp_path}/in"
    schema = entries.schema
    query = None
    for batch in range(3):  # four entries of each chain at a time
        part = [tuple(r[c] for c in schema.names) for r in kept.values() if 4 * batch <= r["seq"] < 4 * batch + 4]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        found = T.verify_stream(T.event_stream(spark, f"file://{folder}", schema, 100), "chain")
        seen = []
        query = found.writeStream.foreachBatch(lambda df, _, seen=seen: seen.extend(df.collect())).outputMode("update").option("checkpointLocation", f"file://{tmp_path}/mark").trigger(availableNow=True).start()
        query.awaitTermination()
        if batch == 0:
            assert all(r["valid"] and r["n"] == 4 for r in seen)
    last = {r["chain"]: (r["n"], r["valid"], r["first_break"], r["reason"]) for r in seen}
    assert last == {"c0": (12, True, None, None), "c1": (12, False, 4, "entryhash"), "c2": (12, False, 7, "prevhash"), "c3": (11, False, 5, "sequence"), "c4": (13, False, last["c4"][2], last["c4"][3]), "c5": (12, True, None, None)}
    assert last["c4"][2] in (6, 7) and not json.dumps(last["c4"]).count("true")
