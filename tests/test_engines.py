"""Queries against their SQL where engines read texts and times in different ways."""

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tallyweave.functions import scalars as S
from tallyweave.plans import registry

TEXTS = ["éDES and 3DESü", "x\nßMD5ñ SHA1\nRC4_ DES1", "la DESÉ RSÁ", "mípassword = 'abcdef'", "-- DES", None, "DES"]


def same_as_sql(spark, folder, name):
    df = registry.queries()[name](spark, str(folder))
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for f in folder.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cursor = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == want
    return want


@pytest.mark.parametrize("name", ["algo_findings", "secret_findings", "finding_disposition", "whole_text_secrets"])
def test_words_between_letters_beyond_ascii(spark, tmp_path, name):
    n = len(TEXTS)
    pq.write_table(pa.table({"doc_id": range(n), "text": TEXTS, "lang": ["en", "de", "fr", "en", None, "en", "de"]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": ["éDESé"]}), tmp_path / "benchmark.parquet")
    assert same_as_sql(spark, tmp_path, name)


def test_boundaries_only():
    assert S.ascii_words(r"a\\b\.\w") == r"a\\b\.\w"
    assert r"\b" not in S.ascii_words(r"\bDES\b")


def test_events_just_before_midnight(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, 23, 59, 58)
    offsets = [0.2, 1.4, 1.5, 1.500001, 1.7, 2.5, 86401.9, 86402.4, 3 * 86400 + 1.6]
    ts = pa.array([start + dt.timedelta(seconds=s) for s in offsets], pa.timestamp("us"))
    pq.write_table(pa.table({"event_id": range(len(ts)), "user_id": [k % 2 for k in range(len(ts))], "ts": ts}), tmp_path / "events.parquet")
    same_as_sql(spark, tmp_path, "days_crossed")


def test_partitions_grow_with_the_rows(spark):
    from tallyweave.operators import lineage

    few, many = (lineage.dealt(n, (spark.range(10), "id"))[0].rdd.getNumPartitions() for n in (10, 50 * lineage.PART_ROWS))
    assert few == int(spark.conf.get("spark.sql.shuffle.partitions")) and many == 50


def test_an_upsert_makes_its_source_once(spark):
    from tallyweave.sources import scans

    seen = spark.sparkContext.accumulator(0)

    def scan(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    target = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k long, v string")
    source = spark.createDataFrame([(1, "x"), (3, "y")], "k long, v string")
    got = scans.upsert(target, source.mapInArrow(scan, source.schema), "k")
    assert sorted((r["k"] or 0, r["v"]) for r in got.collect()) == [(0, "d"), (1, "x"), (2, "c"), (3, "y")]
    assert seen.value == 2


def test_exact_sums_read_the_rows_once(spark):
    from tallyweave.operators import exact

    seen = spark.sparkContext.accumulator(0)

    def scan(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    inf, nan = float("inf"), float("nan")
    rows = [(1, 0.1), (1, 1e300), (1, -1e300), (2, None), (3, inf), (3, 1.0), (4, inf), (4, -inf), (5, 0.0), (6, -5e-324), (6, None), (None, 2.5), (None, -0.5)]
    df = spark.createDataFrame(rows, "k long, x double")
    got = {r["k"]: r["total"] for r in exact.exact_sum(df.mapInArrow(scan, df.schema), "x", "k").collect()}
    assert repr(got.pop(4)) == repr(nan)
    assert got == {1: 0.1, 2: None, 3: inf, 5: 0.0, 6: -5e-324, None: 2.0}
    assert seen.value == len(rows)
