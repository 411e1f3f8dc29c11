"""Parents and children published together."""

import pytest
from pyspark.sql import functions as F

from tallyweave.sources import scans
from tallyweave.sources.published import PUBLISHED, SKIPPED, Publication


@pytest.fixture
def books(spark, tmp_path):
    return Publication(spark, f"file://{tmp_path}/books", "key")


def parents(spark, *rows):
    return spark.createDataFrame(list(rows), "key long, name string")


def children(spark, *rows):
    return spark.createDataFrame(list(rows), "key long, seq long")


def state(books):
    return tuple(sorted(map(tuple, t.collect())) for t in books.tables())


def test_later_runs_replace_parents_and_all_their_children(spark, books):
    assert books.publish(parents(spark, (1, "a"), (2, "b")), children(spark, (1, 0), (1, 1), (2, 0)), "one") == (PUBLISHED, "")
    assert books.publish(parents(spark, (1, "c"), (3, "d")), children(spark, (1, 7)), "two") == (PUBLISHED, "")
    assert state(books) == ([(1, "c"), (2, "b"), (3, "d")], [(1, 7), (2, 0)])
    assert books.publish(parents(spark, (9, "never")), children(spark), "one") == (PUBLISHED, "")  # a run's id counts once
    assert len(books.runs()) == 2 and state(books)[0][-1] == (3, "d")


def test_a_failed_task_leaves_both_tables(spark, books):
    books.publish(parents(spark, (1, "a")), children(spark, (1, 0)), "one")
    before = state(books)
    broken = children(spark, (1, 5), (2, 6)).withColumn("seq", F.when(F.col("key") == 2, F.raise_error(F.lit("no disk")).cast("long")).otherwise(F.col("seq")))
    answer, why = books.publish(parents(spark, (1, "x"), (2, "y")), broken, "two")
    assert answer == SKIPPED and why and state(books) == before
    assert books.publish(parents(spark, (1, "x"), (2, "y")), children(spark, (2, 6)), "two") == (PUBLISHED, "")  # the run may be tried again
    assert state(books) == ([(1, "x"), (2, "y")], [(2, 6)])


def test_what_is_refused(spark, books):
    assert books.publish(parents(spark, (1, "a"), (1, "b")), children(spark), "one")[0] == SKIPPED
    assert books.publish(parents(spark, (None, "a")), children(spark), "one")[0] == SKIPPED
    assert "without a parent" in books.publish(parents(spark, (1, "a")), children(spark, (2, 0)), "one")[1]
    assert books.runs() == []
    with pytest.raises(FileNotFoundError):
        books.tables()


def test_two_writers(spark, books, monkeypatch):
    """Another run commits while this one is about to: both count, in the order of their commits."""
    other = Publication(spark, books.path, "key")
    runs, once = books.runs, []

    def overtaken():
        done = runs()
        if len(once) == 1:  # between this writer's look and its commit
            once.append(other.publish(parents(spark, (1, "other"), (2, "other")), children(spark), "other"))
        once.append(None) if not once else None
        return done

    monkeypatch.setattr(books, "runs", overtaken)
    assert books.publish(parents(spark, (1, "own")), children(spark, (1, 3)), "own") == (PUBLISHED, "")
    monkeypatch.undo()
    assert [r["run"] for r in books.runs()] == ["other", "own"]
    assert state(books) == ([(1, "own"), (2, "other")], [(1, 3)])


def test_upsert_refuses_keys_that_repeat(spark):
    target, source = parents(spark, (1, "a"), (2, "b")), parents(spark, (2, "c"), (3, "d"))
    assert sorted(map(tuple, scans.upsert(target, source, "key").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(ValueError, match="repeats"):
        scans.upsert(target, source.unionByName(parents(spark, (3, "e"))), "key")
