"""Invariants of the generated corpus and of the reviews of small sources."""

import math

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import corpus as C
from tallyweave.operators import differential as D
from tallyweave.operators import review as V
from tallyweave.sources import scans


@pytest.fixture(scope="module")
def vectors(spark):
    return C.evaluate(C.routes(spark), F.lit(False)).cache()


def test_counts_and_shares(spark, vectors):
    got = {r["tag"]: (r["n"], r["divergent"]) for r in C.by_tag(vectors).collect()}
    assert {k: n for k, (n, _) in got.items()} == C.TAG_COUNTS
    assert got["anti-meridian"] == (150, 150) and got["nominal"][1] == 0
    share = C.checked_share(C.by_tag(vectors)).first()["share"]
    assert 0.10 <= share <= 0.25
    with pytest.raises(Exception, match="leaves its band"):
        C.checked_share(C.by_tag(vectors), 0.5, 0.6).collect()
    assert sorted(C.routes(spark).collect()) == sorted(C.routes(spark).repartition(7).collect())


def test_shapes_of_routes(vectors):
    rows = vectors.select("tag", "launch", "late", "points", "n_far", "ref_legs", "ref_eta", "desired").collect()
    by = {}
    for r in rows:
        by.setdefault(r["tag"], []).append(r)
        assert all(abs(p["lat"]) <= 85 and abs(p["lon"]) <= 180 for p in r["points"])
        assert r["desired"] - r["ref_eta"] == (120 if r["late"] else 0)
    assert all(10 <= len(r["ref_legs"]) <= 30 for r in by["precision-drift"])
    assert any(r["n_far"] for r in by["degenerate-route"]) and any(not any(r["ref_legs"]) for r in by["degenerate-route"])
    assert all(min(p["lon"] for p in r["points"]) < 0 < max(p["lon"] for p in r["points"]) for r in by["anti-meridian"])
    assert all(any(r["launch"] < e <= r["ref_eta"] for e in (10**9, 11 * 10**8, 12 * 10**8, 2 * 10**9, 4 * 10**9)) for r in by["leap-second"])
    assert all(r["launch"] < 2**32 <= r["ref_eta"] for r in by["overflow"])


def test_recorded_outputs_are_replayed(vectors):
    recorded = C.record(vectors, "base")
    assert C.replay_mismatches(recorded, "base").count() == 0
    off = C.flipped(C.perturbed(recorded, "base_total", 1 + 1e-6, F.col("id") == 3), "base_go", F.col("id") == 4)
    assert sorted(tuple(r) for r in C.replay_mismatches(off, "base").collect()) == [(3, "distances"), (4, "go")]
    short = recorded.withColumn("base_legs", F.when(F.col("id") == 9, F.slice("base_legs", 1, F.size("base_legs") - 1)).otherwise(F.col("base_legs")))
    assert C.divergent is not None and short.where("id = 9").select(C.distance_error("base", "ref")).first()[0] == math.inf


def test_a_candidate_that_keeps_everything_passes(vectors):
    r = D.oracle_report(D.vector_votes(vectors, C.oracles(), "id")).first()
    assert (r["vectors_passed"], r["total_violations"]) == (2000, 0)
    assert r["bound"] == pytest.approx(math.log(20) / 2000) and r["secondary_bound"] == pytest.approx(math.log(1000) / 2000)


def test_a_candidate_that_repairs_everything_gives_findings_only(spark):
    r = D.oracle_report(D.vector_votes(C.evaluate(C.routes(spark), F.lit(True)), C.oracles(), "id")).first()
    assert r["total_violations"] == 0 and r["intentional_vectors"] > 150


def test_mutants_are_caught(vectors):
    bad = C.perturbed(vectors, "cand_total", 1 + 1e-6, (F.col("id") == 5) & (F.col("cand_total") > 0))
    r = D.oracle_report(D.vector_votes(bad, C.oracles(), "id")).first()
    assert r["violating_vectors"] == 1 and r["total_violations"] == 1
    flipped = vectors.withColumn("cand_feasible", F.when(F.col("id") == 7, ~F.col("cand_feasible")).otherwise(F.col("cand_feasible")))
    assert D.oracle_report(D.vector_votes(flipped, C.oracles(), "id")).first()["total_violations"] == 1


AFTER = {"new/Store.cs": "class Store {\n  // TrustServerCertificate = true\n  string c = \"Server=db;Integrated Security=true\";\n}", "new/a.js": "// innerHTML = a"}


def test_comments_are_skipped_by_language(spark):
    files = scans.source_texts(spark, AFTER)
    rules = lambda **k: {r["rule"] for r in V.security_findings(files, **k).collect()}
    assert rules() == {"hardcoded-credentials", "certificate-validation"}
    assert rules(skip_comments=("csharp",)) == {"hardcoded-credentials", "output-encoding"}
    assert rules(skip_comments=()) == {"hardcoded-credentials", "certificate-validation", "output-encoding"}


def test_look_ahead_ends(spark):
    text = "new SqlCommand(\n" + "\n" * 4 + '"a" +'
    count = lambda t: V.security_findings(scans.source_texts(spark, {"a.cs": t})).where("rule = 'sql-injection'").count()
    assert count(text) == 1 and count(text.replace("\n\n", "\n\n\n", 1)) == 0


def test_routes_of_a_small_file_are_made_by_all_tasks(spark):
    rows = spark.range(4000, numPartitions=1).withColumnRenamed("id", "k")
    sizes = C.evaluate(C.routes_of(rows, "k"), F.lit(False)).groupBy(F.spark_partition_id().alias("p")).count().collect()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(sizes) == n and max(r["count"] for r in sizes) < 2 * 4000 / n
